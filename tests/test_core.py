"""Operators over literal rows, against plain Python where the rules are intricate."""

import io
import math
import os
import random
import re
import tarfile
import unicodedata
import zipfile

import bz2
import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from scriptorium import queries, queries_tables  # noqa: F401
from scriptorium.functions import text as T
from scriptorium.operators import citations, dedupe, library, notes, parallels, passages, runlog, search
from scriptorium.operators.graph import components
from scriptorium.plans import match as M
from scriptorium.sources import extract as E
from scriptorium.sources import files


def test_match_grammar():
    assert M.parse("a b") == M.Logic("and", (M.Unit(("a",)), M.Unit(("b",))))
    assert M.parse("a AND b OR c") == M.Logic("or", (M.Logic("and", (M.Unit(("a",)), M.Unit(("b",)))), M.Unit(("c",))))
    assert M.parse('"Dhammā cakka" pre*') == M.Logic("and", (M.Unit(("dhamma", "cakka")), M.Unit(("pre",), prefix=True)))
    assert M.parse("a + b") == M.Unit(("a", "b")) and M.parse("^x") == M.Unit(("x",), first=True)
    assert M.parse("NEAR(a b, 3)") == M.Near((M.Unit(("a",)), M.Unit(("b",))), 3)
    assert M.parse("text:x") == M.parse("{text}:x") == M.Unit(("x",))
    assert M.parse("a NOT b").kind == "not" and M.parse("and") == M.Unit(("and",))
    assert M.parse("dham*only") == M.Logic("and", (M.Unit(("dham",), prefix=True), M.Unit(("only",))))
    for bad in ("a-b", "x:y", "it's", "a/b", "a.", "*", '"', "", "a AND", "(a"):
        with pytest.raises(M.MatchError):
            M.parse(bad)
    assert M.parse_or_quote("a-b") == M.Logic("and", (M.Unit(("a",)), M.Unit(("b",)))) and M.parse_or_quote("") is None


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_fold_is_idempotent_and_parser_is_total(text):
    terms = M.fold(text)
    assert M.fold(" ".join(terms)) == terms
    M.parse_or_quote(text)


def test_text_functions(spark):
    rows = ["<p>a &amp;lt; b</p>\n c", "su<pb n='1'/>taṁ  ŊA", "", None, "ÀÉ ß Ǆ", "12-3 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r for r in df.select("i", T.stripped_markup(F.col("t")).alias("s"), T.match_form(F.col("t")).alias("m"), T.folded(F.col("t")).alias("f"), T.text_hash(F.col("t")).alias("h"), T.leading_int(F.col("t")).alias("n")).collect()}
    assert got[0].s == "a < b c" and got[1].m == "sutaṃ ŋa".replace("ŋ", "ŋ") and got[4].f == "ae ß ǆ"
    assert got[2].h is None and got[3].s is None and got[3].n is None and got[5].n == 12 and got[2].n == 0
    assert df.where("i = 1").select(T.composed(F.lit("á"))).first()[0] == "á"


def bm25(docs, terms):
    tokens = {i: M.fold(t or "") for i, t in docs}
    tokens = {i: t for i, t in tokens.items() if t}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for i, t in tokens.items():
        if all(x in t for x in terms):
            s = 0.0
            for x in terms:
                df = sum(x in o for o in tokens.values())
                tf = t.count(x)
                s -= max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
            out[i] = round(s, 6)
    return out


def test_scores_against_python(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice("alpha beta gamma Delta épsilon x y z".split()) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(98, None), (99, "")]
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    for q, terms in (("alpha beta", ["alpha", "beta"]), ("epsilon", ["epsilon"]), ("alpha alpha", ["alpha", "alpha"])):
        assert {x.doc_id: round(x.score, 6) for x in search.scored(index, q).collect()} == bm25(docs, terms)
    assert search.scored(index, "").collect() == [] and search.top(index, "alpha", 0).collect() == []


def test_hidden_copies_and_snippets(spark):
    docs = spark.createDataFrame([(3, "one two three"), (1, "one  two three"), (2, "two words here"), (4, "nothing")], "doc_id long, text string")
    found = search.library_hits(docs, "two").collect()
    assert sorted((x.doc_id, x.duplicate_count) for x in found) == [(1, 2), (2, 1)]
    hits = search.top(search.build_index(docs), "two").select("doc_id")
    assert {x.doc_id: x.snippet for x in search.snippets(hits, docs, "two", 2).collect()} == {1: "one [two] ...", 2: "[two] words ...", 3: "one [two] ..."}


def test_any_number_of_copies_is_hidden(spark, tmp_path, monkeypatch):
    many = [(i, "two two") for i in range(150)] + [(i, f"two  two {i % 2}") for i in range(150, 300)]
    docs = spark.createDataFrame(many + [(i, f"two words and more of document {i}") for i in range(300, 325)], "doc_id long, text string")
    clusters, held = dedupe.exact_clusters(docs), library.changed(spark, str(tmp_path), docs)
    wanted = [(0, 150), (150, 75), (151, 75), *((i, 1) for i in range(300, 317))]
    for index, score_all in ((search.build_index(docs), 1), (held, 1 << 20), (held, 0)):
        monkeypatch.setattr(search, "SCORE_ALL", score_all)
        found = search.top_without_duplicates(index, "two", clusters, 20).collect()
        assert [(x.doc_id, x.duplicate_count) for x in found] == wanted
        assert len(search.top_without_duplicates(index, "two", clusters, 20, among=200).collect()) < 20


def test_clusters_read_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = ["a b", "a  b", "a b", "c", "", "", " ", None, "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dedupe.exact_clusters(docs.mapInArrow(passed, docs.schema))
    assert sorted(map(tuple, found.collect())) == [(0, 0, 3), (1, 0, 3), (2, 0, 3), (4, 4, 3), (5, 4, 3), (7, 4, 3)]
    assert seen.value == len(texts)


def test_terms_in_one_string(spark):
    texts = ["", " ", None, "...", "One, two;three", "-\u00c9t\u00e9 e\u0301t\u00e9\u2003\u0e01\u0301x\U0001d7d8\U00010330 \u0130\u00df\ufb01", "a\u0000b\tc\u00a0d_e\u2028f"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", T.terms(F.col("text")).alias("terms"), T.spaced_terms(F.col("text")).alias("spaced")).collect():
        assert (r.spaced or "").split(" ") == (r.terms or [""]), r.text


def test_deadline(spark):
    with pytest.raises(TimeoutError):
        search.with_deadline(spark, 1.0, lambda: spark.range(0, 10**13, 1, 4).selectExpr("sum(hash(id))").collect())
    assert search.with_deadline(spark, 60, lambda: spark.range(3).count()) == 3


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)] + [("z", "y"), ("q", "q")], "a string, b string")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {f"n{i:02d}": "n00" for i in range(13)} | {"z": "y", "y": "y"}


def test_weak_hints_leave_out_copies(spark):
    docs = spark.createDataFrame([(1, "/a/Maha Book.txt", "Maha Book.txt"), (2, "/b/Maha Book copy.txt", "Maha Book copy.txt"), (3, "/c/maha-book v2.txt", "maha-book v2.txt"), (4, "/d/metadata.opf", "metadata.opf"), (5, "/e/metadata.opf", "metadata.opf")], "doc_id long, source_path string, filename string")
    members = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, representative long")
    assert {r.doc_id: r.hints for r in dedupe.weak_hints(docs, members).collect()} == {1: ["/b/Maha Book copy.txt"], 2: ["/a/Maha Book.txt", "/c/maha-book v2.txt"], 3: ["/b/Maha Book copy.txt"]}


def test_nearest_earlier_against_python(spark):
    r = random.Random(4)
    entries = [(r.choice("ab"), r.randint(0, 30), f"e{k}") for k in range(25)]
    probes = [(k, r.choice("abc"), r.randint(-2, 32)) for k in range(40)]
    got = {x.n: x.v for x in passages.nearest_earlier(spark.createDataFrame(probes, "n int, k string, at int"), spark.createDataFrame(entries, "k string, start int, v string"), ["k"], "at", "start", [F.col("v")], ["v"]).collect()}
    for n, k, at in probes:
        best = max(((s, [-ord(c) for c in v], v) for key, s, v in entries if key == k and s <= at), default=None)
        same = [v for key, s, v in entries if best and key == k and s == best[0]]
        assert got[n] == (min(same) if best else None)


def test_citations_stand_between_ascii_words(spark):
    """As the SQL of citation_extract: letters with marks, which DuckDB's edges of words don't count, touch citations."""
    texts = ["x é\u200ban 71.129 y", "juan 5 éan 64.105, ñMN 7é", "the \u0301an 18.128", "MN\x0b5 MN\n6 MN 7_ MN 8x", " \u017fn 5 x\u017fn 6 \u212ap 7 x\u212ap 8", "MN 9\u0663 AN 1.2-3.4", "日MN 10日", "MN 1.2.3 MN1-2-3 Snp 4.5-6"]
    sql = next(iter(re.findall(r"regexp_extract_all\(t, ('[^']+')\)", queries.ORACLE_SQL["citation_extract"])))
    want = [duckdb.execute(f"SELECT regexp_extract_all(?, {sql})", [t]).fetchone()[0] for t in texts]
    assert [spark.range(1).select(citations.extracted(F.lit(t))).first()[0] for t in texts] == want
    assert want[1] == ["an 64.105", "MN 7"]


@given(st.integers(0, 2000), st.text("0123456789", min_size=1, max_size=3))
@settings(max_examples=10, deadline=None)
def test_range_ends_are_repaired(spark, low, end):
    want = int(end)
    while want < low:
        want += 10 ** len(end)
    assert spark.range(1).select(citations.repaired_end(F.lit(low).cast("bigint"), F.lit(end))).first()[0] == want


def test_range_blocks_hold_every_pair(spark):
    r = random.Random(9)
    ranges = [(i, lo := r.randint(-50, 300), lo + r.randint(0, 200)) for i in range(20)]
    points = [(p,) for p in range(-60, 420, 7)]
    got = {(x.p, x.i) for x in passages.within_range(spark.createDataFrame(points, "p int"), spark.createDataFrame(ranges, "i int, low int, high int"), [], "p", "low", "high").collect()}
    assert got == {(p, i) for (p,) in points for i, lo, hi in ranges if lo <= p <= hi}


def test_globs():
    import re

    for spec, yes, no in (("s02*", "s0202m_mul", "t02"), ("s?1", "s11", "s111"), ("[!a]b", "cb", "ab"), ("a.b", "a.b", "axb")):
        assert re.search(passages.glob_pattern(spec), yes) and not re.search(passages.glob_pattern(spec), no)


def test_parallel_members(spark):
    rows = [("sn12.1-3", ["sn12.1", "sn12.2", "sn12.3"]), ("sn5-3", []), ("12-14", []), ("an1.1-500", []), ("mn1", [])]
    df = spark.createDataFrame([(u,) for u, _ in rows], "u string")
    assert {r.u: r.m for r in df.select("u", parallels.members(F.col("u")).alias("m")).collect()} == dict(rows)


def test_placeholders(spark):
    rows = [("would search the canon", True), ("would searching still", False), ("<fill in> x", True), ("done", False)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert {r.t: r.p for r in df.select("t", runlog.is_placeholder(F.col("t")).alias("p")).collect()} == dict(rows)


def test_log_start_is_idempotent(spark):
    schema = "run string, seq long, phase string, kind string, tool string"
    head = [("a", k + 1, "0", "header", f) for k, f in enumerate(runlog.HEADER_FIELDS)]
    once = runlog.started(spark.createDataFrame([], schema), spark.createDataFrame(head, schema))
    assert once.where("kind = 'gate'").count() == 1 and runlog.started(once, spark.createDataFrame(head, schema)).count() == once.count()


def test_self_audit_notes_and_names(spark):
    log = spark.createDataFrame([("a", 3, "7", "entry", None), ("b", 1, "7", "audit", "x"), ("c", 1, "7", "entry", None)], "run string, seq long, phase string, kind string, payload string")
    answers = spark.createDataFrame([(r, k, " yes ") for r in "ab" for k in range(6)] + [("c", k, None if k == 2 else "y") for k in range(6)] + [("d", 0, "y")], "run string, at long, answer string")
    assert sorted((r.run, r.ok, r.recorded) for r in runlog.audits(log, answers).collect()) == [("a", True, True), ("b", True, False), ("c", False, False), ("d", False, False)]
    full = runlog.audited(log, answers)
    assert sorted((r.seq, r.payload) for r in full.where("run = 'a' and kind = 'audit'").collect()) == [(k, "yes") for k in range(4, 10)] and full.count() == 9
    assert runlog.audited(full, answers).count() == 9 and runlog.audits(log, answers.limit(0)).collect() == []

    schema = "run string, note_path string, pdf string"
    runs = spark.createDataFrame([("a", None, "p"), ("b", "old", None), ("c", "old", None)], schema)
    asked = spark.createDataFrame([("a", "n", None), ("b", "gone", "q"), ("z", "n", None)], schema)
    got = runlog.with_notes(runs, asked, spark.createDataFrame([("n",), ("n",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [("a", "n", "p"), ("b", "old", None), ("c", "old", None)]

    there = spark.createDataFrame([("x",), ("2024-01-02-x",), ("2024-01-02-y",), ("2023-05-05-y",), ("2024-01-02y",)], "run string")
    found = runlog.named(spark.createDataFrame([("x",), ("y",), ("z",), ("2024-01-02-x",), ("y",)], "slug string"), there)
    assert {r.slug: r.run for r in found.collect()} == {"x": "x", "y": "2024-01-02-y", "z": None, "2024-01-02-x": "2024-01-02-x"} and found.count() == 4


def test_calls_are_logged(spark):
    log = spark.createDataFrame([("a", 2, "0", "header")], "run string, seq long, phase string, kind string")
    rows = [("a", 1, "search", "[1, 2]", None), ("a", 2, "gate", "[]", "1"), ("a", 3, "search", "{}", "4a"), ("b", 1, "search", "[1]", "1"), ("a", 4, "search", "no JSON [", None)]
    calls = spark.createDataFrame([(r, k, c, "-x", out, p) for r, k, c, out, p in rows], "run string, seq long, command string, args string, result string, phase string")
    at = spark.createDataFrame([("a", "3")], "run string, phase string")
    got = sorted((r.seq, r.phase, r.tool, r.hits, r.pinned) for r in runlog.logged_calls(log, calls, at).where("kind = 'entry'").collect())
    assert got == [(3, "3", "search", 2, False), (4, "4", "search", None, True), (5, "3", "search", None, False)]
    assert {r.phase for r in runlog.logged_calls(log, calls, at.limit(0)).where("kind = 'entry' and not pinned").collect()} == {"?"}


def test_logged_hits(spark):
    log = spark.createDataFrame([("r", 1, 'x {"document_id": 5, "title": "old"} y {"document_id": 6, "a": {"b": 1}}'), ("r", 2, '{"document_id": 5, "title": "new"}')], "run string, at int, text string")
    assert [(r.document_id, r.title) for r in notes.logged_hits(log).collect()] == [(5, "new")]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts:
            z.writestr(name, data)
    return out.getvalue()


def test_extraction(monkeypatch):
    assert E.extract("a.txt", "héllo\xff".encode("latin-1")) == ("h�llo�", "ok") and E.extract("a.md", b" \n") == ("", "empty")
    assert E.extract("a.html", b"<p>x &amp; y</p>") == ("x & y", "ok") and E.extract("a.xyz", b"")[1] == "unsupported: .xyz"
    assert E.extract("a.epub", zipped([("b.xhtml", "<p>two</p>"), ("a.xhtml", "<p>one</p>"), ("x.css", "no")])) == ("one two", "ok")
    assert E.extract("a.docx", zipped([("word/document.xml", "<w><t>doc</t></w>")]))[0] == "doc"
    inner = zipped([("n.txt", "nested")])
    assert E.extract("a.zip", zipped([("b.txt", "b"), ("a.txt", "a"), ("i.zip", inner), ("p.png", "x"), ("noext", "y")])) == ("b a", "ok")
    assert E.extract("t.txt.bz2", bz2.compress(b"plain")) == ("plain", "ok")
    many = bz2.compress(b"first stream ") + bz2.compress(b"") + bz2.compress(b"x" * 3_000_000) + bz2.compress(b" last")
    assert E.extract("t.txt.bz2", many) == ("first stream " + "x" * 3_000_000 + " last", "ok") and E.extract("t.txt.bz2", many + b"no stream") == E.extract("t.txt.bz2", many)
    assert E.extract("t.txt.bz2", many[:-4])[1] == "error: compressed data are cut off" and E.extract("t.txt.bz2", b"junk")[1].startswith("error")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 4
        t.addfile(info, io.BytesIO(b"tarx"))
    assert E.extract("t.tar.bz2", bz2.compress(tar.getvalue())) == ("tarx", "ok")
    message = b"MIME-Version: 1.0\nContent-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\n\n<b>hi</b>\n--B\nContent-Type: image/png\n\nx\n--B--\n"
    assert E.extract("a.mht", message) == ("hi", "ok") and E.extract("a.zip", b"junk")[1].startswith("error: ")
    monkeypatch.setattr(E, "MOST_MEMBERS", 1)
    assert E.extract("a.zip", zipped([("b.txt", "b"), ("a.txt", "a")]))[1] == "error: archive too large"
    assert E.extract("a.txt", None)[1].startswith("error")


def test_refresh(spark, tmp_path):
    root = tmp_path / "lib"
    (root / "sub" / ".hidden").mkdir(parents=True)
    (root / "skip").mkdir()
    for name, text in (("a.txt", "alpha"), ("sub/b.html", "<p>beta</p>"), ("sub/.hidden/c.txt", "no"), ("skip/d.txt", "no"), ("e.png", "no"), ("f.pdf", "%PDF")):
        (root / name).write_text(text)
    where = files.Roots.from_text(str(root), str(root / "skip"))
    first, counts = files.refreshed(spark, files.empty_documents(spark), where)
    first = spark.createDataFrame(first.collect(), files.DOCUMENTS)
    assert counts.first()["new"] == 3 and {r.filename: r.text for r in first.collect()} == {"a.txt": "alpha", "b.html": "beta", "f.pdf": ""}
    (root / "a.txt").write_text("changed text")
    os.remove(root / "sub" / "b.html")
    second, counts = files.refreshed(spark, first, where, retry_failed=True)
    c = counts.first()
    assert (c["changed"], c["deleted"], c["retried"], c["new"]) == (1, 1, 1, 0)
    kept = {r.filename: (r.doc_id, r.text) for r in second.collect()}
    assert kept["a.txt"] == (first.where("filename = 'a.txt'").first().doc_id, "changed text") and set(kept) == {"a.txt", "f.pdf"}
    _, counts = files.refreshed(spark, first, where, limit=1)
    assert counts.first()["deleted"] == 0


def test_availability():
    asked = []
    states = {"/a": True, "/b": False, "/c": None, "/a/1": True, "/a/2": None}

    def probe(path, seconds):
        asked.append(path)
        return states[path]

    assert files.availability([("/a", "/a/1"), ("/b", "/b/1"), ("/c", "/c/1"), ("/a", "/a/2"), ("/a", "/a/1")], probe=probe) == [True, False, None, None, None]
    assert asked == ["/a", "/b", "/c", "/a/1", "/a/2"]


def test_numbers_in_path_order(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f{k:02d}.txt").write_text(f"text {k}")
    new, _ = files.refreshed(spark, files.empty_documents(spark), files.Roots.from_text(str(tmp_path)))
    rows = sorted((r.path, r.doc_id) for r in new.collect())
    assert [d for _, d in rows] == list(range(1, 31))


def test_phrases_in_any_form(spark):
    rows = [("b", 1, "1", unicodedata.normalize(form, "Evaṃ <b>me</b> sutaṁ Ångström")) for form in ("NFC", "NFD")]
    df = spark.createDataFrame(rows + [("b", 9, "", None)], "book_code string, id long, paranum string, pali_text string")
    for needle in ("evaṁ me sutaṁ ångström", unicodedata.normalize("NFD", "Evaṁ me sutaṃ ångström")):
        assert passages.find_phrase(df, needle, ("pali_text",)).count() == 2
    assert passages.find_phrase(df, "sutam", ("pali_text",)).count() == 0


def test_small_text_functions(spark):
    df = spark.createDataFrame([("x" * 12, ["y" * 11, "z"], {"k": ("w" * 20, 1)})], "a string, b array<string>, c map<string, struct<d: string, e: int>>")
    got = df.select(*[T.clipped_values(F.col(f.name), f.dataType, 10).alias(f.name) for f in df.schema]).first()
    assert got.a == "x" * 10 + "… (+2 more characters)" and got.b == ["y" * 10 + "… (+1 more characters)", "z"] and got.c["k"].e == 1 and got.c["k"].d.startswith("w" * 10 + "…")
    day = F.to_date(F.lit("2024-05-06"))
    assert spark.range(1).select(T.dated_slug(F.lit("a-b"), day), T.dated_slug(F.lit("2023-01-02-x"), day)).first()[:] == ("2024-05-06-a-b", "2023-01-02-x")
    cached = spark.createDataFrame([("v", True, "en", 1), ("v", False, "pi", 2), ("v", False, "en", 3), ("w", True, "en", 4)], "video_id string, is_auto boolean, lang string, n int")
    assert sorted(r.n for r in files.best_transcripts(cached).collect()) == [3, 4]
    videos = spark.createDataFrame([("v1|||T|||Good|||U1|||1"), ("v2|||T|||Bad|||U2|||NA")], "string").withColumnRenamed("value", "text")
    allow = spark.createDataFrame([("excluded", "Bad", ""), ("trusted", "Good", "")], "tier string, name string, channel_id string")
    assert [(r.video_id, r.tier) for r in files.not_excluded(files.video_hits(videos), allow).collect()] == [("v1", "trusted")]


def test_readers(spark, tmp_path):
    folder = tmp_path / "root" / "pli" / "ms"
    folder.mkdir(parents=True)
    (folder / "mn1_root-pli-ms.json").write_text('{"mn1:1.2": "b \\"q\\"", "mn1:1.1": "a"}')
    assert [(r.kind, r.lang, r.author, r.file_stem, r.uid, r.seg_key, r.ord, r.text) for r in files.segment_files(spark, str(tmp_path)).orderBy("ord").collect()] == [("root", "pli", "ms", "mn1", "mn1", "mn1:1.2", 0, 'b "q"'), ("root", "pli", "ms", "mn1", "mn1", "mn1:1.1", 1, "a")]
    lines = ["## Trusted", "- Name | UC1", "```", "- no", "```", "## Other", "- no", "## Excluded", "- Bad"]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, text string")
    assert sorted(map(tuple, files.channels(rows).collect())) == [("excluded", "Bad", ""), ("trusted", "Name", "UC1")]
    report = spark.createDataFrame([('banner\n[{"file": "a.md", "matches": [{"line": 3, "text": " x "}]}]',)], "text string")
    assert [tuple(r) for r in files.flattened_hits(report).collect()] == [("a.md", 3, "x")]


def test_streams(spark, tmp_path):
    from scriptorium.streaming import tables

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, "alpha beta"), (2, "")], "doc_id long, text string").write.parquet(src)
    tables.follow_documents(spark, src, out, ck).awaitTermination()
    spark.createDataFrame([(1, "alpha gamma"), (3, "beta")], "doc_id long, text string").write.mode("append").parquet(src)
    tables.follow_documents(spark, src, out, ck).awaitTermination()
    held = library.opened(spark, out)
    assert [[r.doc_id for r in search.matches(held, q).collect()] for q in ("alpha", "beta", "gamma")] == [[1], [3], [1]] and held.documents().count() == 3
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"run": "r", "phase": "4a", "hits": 2}\n')
    tables.follow_log(spark, str(log), "run string, phase string, hits int", str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).first().phase == "4"


@given(st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_bare_letters_agree_with_unicode(text):
    table = str.maketrans(T.MARKED, T.BARE)
    for c in text:
        if ord(c) < 0x250:
            plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            assert c.translate(table) == plain or len(plain) != 1


@given(st.lists(st.text("aeiouAsß̧̣́̈ͅṩÅक़가각 xyz", max_size=12), min_size=30, max_size=30))
@settings(max_examples=5, deadline=None)
def test_composed_form_agrees_with_unicode(texts):
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    found = df.select("i", T.composed(F.col("t")).alias("c"))
    assert "Python" not in found._jdf.queryExecution().toString()
    assert [r.c for r in found.orderBy("i").collect()] == [unicodedata.normalize("NFC", t) for t in texts] + [None]
