"""Merkle manifests against a plain tree in memory."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from scriptorium.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text: str | None) -> str | None:
    return text and "".join(c.lower() if c.isascii() else c for c in text)


def climb(nodes: list[str], at: int, fanout: int) -> tuple[list[tuple[list[str], list[str]]], str]:
    """What lies beside a node on each level, and the root."""
    path = []
    while len(nodes) > 1:
        start = at // fanout * fanout
        path.append((nodes[start:at], nodes[at + 1 : start + fanout]))
        nodes, at = [h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)], at // fanout
    return path, nodes[0]


def expected(rows: list[tuple], fanout: int = 8) -> list[tuple]:
    leaves = [(r[2], r, h(*map(field, r))) for r in rows]
    order = lambda x: (x[1][0] is not None, x[1][0] or 0, x[2])
    langs = sorted({x[0] for x in leaves}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted((x for x in leaves if x[0] == lang), key=order) for lang in langs}
    subroots = [climb([x[2] for x in trees[lang]], 0, fanout)[1] for lang in langs]
    out = []
    for k, lang in enumerate(langs):
        upper, root = climb(subroots, k, fanout)
        for at, (_, row, own) in enumerate(trees[lang]):
            path = climb([x[2] for x in trees[lang]], at, fanout)[0] + upper
            digest = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                digest = h(*map(field, (*row[:4], lower(row[4]))))
            for before, after in path:
                digest = h(*before, digest, *after)
            out.append((row[0], own, subroots[k], root, h(*[d for before, after in path for d in before + after]), digest, digest == root))
    return out


def rows_of(df) -> list[tuple]:
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_equals_plain_tree(spark, n):
    langs = [None, "en", "en", "en", "é", "", "zz"]
    rows = [(k * 7 % 1009, f"s{k % 3}" if k % 5 else None, langs[k % 7], k if k % 4 else None, f"Text {k} É" if k % 6 else None) for k in range(n)]
    got = merkle.report(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(got) == sorted(map(repr, expected(rows)))


def test_repeats_nulls_and_many_languages(spark):
    rows = [(None, "s", None, None, "A"), (None, "s", None, None, "A"), (None, None, "x", 1, ""), (5, "s", "x", 1, None), (5, "s", "x", 1, "Two"), (5, "s", "x", 1, "Two")]
    rows += [(k, "s", f"l{k % 75}", 3, "Abc " * (k % 9)) for k in range(300)]
    assert rows_of(merkle.report(spark.createDataFrame(rows, SCHEMA))) == sorted(map(repr, expected(rows)))


def test_other_fanout_and_clashing_columns(spark):
    rows = [(k, "s", "en" if k % 3 else "fr", k, f"T{k}") for k in range(40)]
    extra = ["tree", "leaf", "at", "nodes", "digest", "path", "root", "run", "member", "part", "rest", "tampered"]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + "".join(f", {c} string" for c in extra))
    assert rows_of(merkle.report(docs, 3)) == sorted(map(repr, expected(rows, 3)))


def test_long_text_and_further_columns(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "Ab " * 400_000), (2, "s", "en", 1, "b")], SCHEMA)
    assert merkle.report(docs).where("doc_id = 1").first().leaf == h("1:1", "1:s", "2:en", "1:1", field("Ab " * 400_000))
    made = merkle.manifest(docs.selectExpr("lang AS tree", "doc_id", "unhex(sha2(text, 256)) AS leaf", "source AS held"))
    assert {(r.doc_id, r.held, len(r.path)) for r in made.collect()} == {(1, "s", 1), (2, "s", 1)}


def test_any_change_is_seen(spark):
    rows = [(k, "s", "en", k, f"text {k}") for k in range(100)]
    made = merkle.report(spark.createDataFrame(rows, SCHEMA))
    assert made.where("verified").count() == 100  # there is nothing to lower-case
    upper = merkle.report(spark.createDataFrame([(a, b, c, d, e.upper()) for a, b, c, d, e in rows], SCHEMA))
    assert {r.doc_id for r in upper.where("not verified").collect()} == {k for k in range(100) if zlib.crc32(str(k).encode()) % 3 == 0}
