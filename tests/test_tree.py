"""Walks and reads of file trees: whatever is wrong with a file is a row."""

from __future__ import annotations

import hashlib
import os
import zipfile

import pytest

from scriptorium.sources import extract, files, tree


def paths(df):
    return sorted((r.path, r.size, r.error) for r in df.collect())


def test_walk_never_lists_what_is_left_out(spark, tmp_path):
    for name in ("a.txt", "sub/b.md", "sub/deep/er/c.html", ".hidden/no.txt", "sub/.no.txt", "skip/no.txt", "skip/below/no.txt", "n.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nowhere")
    want = sorted((f"{tmp_path}/{n}", len(n), None) for n in ("a.txt", "sub/b.md", "sub/deep/er/c.html"))
    # Whether folders are handed back or gone into, the result is the same.
    for most in (1, 3, 1000):
        assert paths(tree.walked(spark, [str(tmp_path)], [f"{tmp_path}/skip"], most)) == want
    assert [p.removeprefix("file://") for p, _, _ in paths(tree.walked(spark, [f"file://{tmp_path}/"], [f"file://{tmp_path}/skip"]))] == [p for p, _, _ in want]
    listed, left = tree._listing(str(tmp_path), frozenset([f"{tmp_path}/skip"]), 10**6)
    assert not left and not any("skip" in f[0] or "hidden" in f[0] for f in listed)
    assert tree.walked(spark, [], []).count() == 0 and tree.walked(spark, [str(tmp_path)], [str(tmp_path)]).count() == 0


def test_roots_that_are_not_there(spark, tmp_path):
    (row,) = tree.walked(spark, [f"{tmp_path}/none"], []).collect()
    assert row.path == f"{tmp_path}/none" and row.size is None and row.error.startswith("folder not read: ")


def test_names_that_are_not_utf8(spark, tmp_path):
    with open(os.fsencode(str(tmp_path)) + b"/bad\xff.txt", "wb") as f:
        f.write(b"x")
    (row,) = tree.walked(spark, [str(tmp_path)], []).collect()
    assert row.error == "stat failed: the name is not UTF-8"


@pytest.fixture
def troubled(tmp_path):
    """A tree with a huge file, a broken one and good ones; the path of one more that will be gone."""
    root = tmp_path / "lib"
    root.mkdir()
    with open(root / "huge.txt", "wb") as f:
        f.truncate(2_200_000_000)
    (root / "locked.txt").symlink_to("/proc/self/mem")  # opens, and can't be read
    for name in ("good.txt", "going.txt"):
        (root / name).write_text(f"{name} words")
    (root / "broken.epub").write_bytes(b"no archive")
    return root


def test_refresh_goes_on_where_files_cannot_be_read(spark, troubled):
    where = files.Roots.from_text(str(troubled))
    listing = files.listed(spark, where)
    (troubled / "going.txt").unlink()  # after it was listed
    docs, counts = files.refreshed(spark, files.empty_documents(spark), where, listing=listing)
    rows = {r.filename: r for r in docs.collect()}
    c = counts.first()
    assert set(rows) == {"huge.txt", "locked.txt", "good.txt", "going.txt", "broken.epub"}
    assert (c.indexed, c.written, c.text_extracted, c.metadata_only, c.error_count, c.limited) == (5, 5, 1, 4, 2, False)
    assert [(e.relative_path, e.error[:24]) for e in c.errors] == [("going.txt", "error: file read failed:"), ("locked.txt", "error: file read failed:")]
    held = {r.filename: r for r in listing.withColumn("filename", files.T.file_name(listing.path)).collect()}
    for name in ("locked.txt", "going.txt"):
        row, seen = rows[name], held[name]
        assert row.content_hash == "unreadable:" + hashlib.sha256(f"unreadable\0{row.path}\0{seen.size}\0{seen.modified}".encode()).hexdigest()
        assert row.text_hash is None and row.text == "" and row.extraction_status.startswith("error: file read failed: ")
    zeros, piece = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2_200_000_000 >> 20):
        zeros.update(piece)
    zeros.update(bytes(2_200_000_000 % (1 << 20)))
    assert rows["huge.txt"].content_hash == zeros.hexdigest() and rows["huge.txt"].extraction_status == "error: text too large"
    assert rows["broken.epub"].extraction_status == "error: bad zip" and rows["good.txt"].text == "good.txt words"


def test_rows_of_what_cannot_be_looked_at_are_kept(spark, tmp_path):
    for name in ("a/x.txt", "a/deep/y.txt", "b/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    where = files.Roots.from_text(str(tmp_path))
    first, _ = files.refreshed(spark, files.empty_documents(spark), where)
    first = spark.createDataFrame(first.collect(), files.DOCUMENTS)
    listing = files.listed(spark, where)
    away = listing.where(f"path = '{tmp_path}/a/x.txt'").selectExpr("root_ord", "source_root", f"'{tmp_path}/a' AS path", "CAST(NULL AS BIGINT) AS size", "CAST(NULL AS TIMESTAMP) AS mtime", "CAST(NULL AS DOUBLE) AS modified", "'folder not read: gone' AS error")
    docs, counts = files.refreshed(spark, first, where, listing=away)
    c = counts.first()
    assert {r.rel_path for r in docs.collect()} == {"a/x.txt", "a/deep/y.txt"} and (c.deleted, c.kept, c.error_count) == (1, 2, 1)


def test_prefixes_and_hashes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("body")
    (tmp_path / "b.txt").write_text("body")
    prefixes = spark.createDataFrame([(f"{tmp_path}/a.txt", "[Head]")], "path string, prefix string")
    docs, _ = files.refreshed(spark, files.empty_documents(spark), files.Roots.from_text(str(tmp_path)), prefixes=prefixes)
    a, b = docs.orderBy("path").collect()
    assert (a.text, b.text) == ("[Head]\n\nbody", "body") and a.text_hash == b.text_hash


def test_archives_are_read_from_open_files(tmp_path, monkeypatch):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(5):
            z.writestr(f"{k}.txt", "x" * 1000)
        z.writestr("big.txt", "y" * 5000)
    monkeypatch.setattr(extract, "MOST_TEXT", 4500)
    with open(path, "rb") as f:
        assert extract.extract("a.zip", f) == ("", "error: text too large")
    monkeypatch.setattr(extract, "MOST_TEXT", 6000)
    with open(path, "rb") as f:
        assert extract.extract("a.zip", f)[1] == "error: text too large"  # of all members together
    monkeypatch.setattr(extract, "MOST_TEXT", 1 << 20)
    with open(path, "rb") as f:
        text, status = extract.extract("a.zip", f)
    assert status == "ok" and len(text) == 5 * 1001 + 5000
    assert extract.extract("a.zip", b"no archive") == ("", "error: bad zip")
