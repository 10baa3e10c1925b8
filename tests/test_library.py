"""The segmented library against an index of the moment."""

from __future__ import annotations

import os
import random
import threading

import pytest

from scriptorium import storage
from scriptorium.operators import library, search

SCHEMA = "doc_id long, text string"
QUERIES = ["alpha", "beta OR fresh", "alpha beta", "alpha NOT beta", "al*", '"alpha beta"', "^alpha", "NEAR(alpha gamma, 2)", "gone", "alpha alpha OR x", "b* gamma", ""]


def same(spark, held, docs, queries=QUERIES):
    whole = search.build_index(spark.createDataFrame(docs, SCHEMA))
    rows = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in df.collect())
    for q in queries:
        assert rows(search.scored(held, q)) == rows(search.scored(whole, q)), q
        for limit in (3,):
            assert [r.doc_id for r in search.top(held, q, limit, 0).collect()] == [r.doc_id for r in search.top(held, q, limit).collect()] == [r.doc_id for r in search.top(whole, q, limit).collect()], (q, limit)
    assert sorted(map(tuple, held.vocabulary().collect())) == sorted(map(tuple, whole.vocabulary().collect()))
    assert sorted(map(tuple, held.documents().select("doc_id", "text").collect()), key=str) == sorted(docs, key=str)


def texts(rng, n, start=0):
    return [(start + k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x", "y", "Épsilon"]) for _ in range(rng.randrange(0, 15)))) for k in range(n)]


def test_changes_over_segments(spark, tmp_path):
    root, rng = str(tmp_path / "lib"), random.Random(1)
    held = dict(texts(rng, 60))
    lib = library.changed(spark, root, spark.createDataFrame(list(held.items()), SCHEMA))
    fresh = dict(texts(rng, 10, 55)) | {3: "alpha fresh beta", 4: None, 5: ""}
    lib = library.changed(spark, root, spark.createDataFrame(list(fresh.items()), SCHEMA), spark.createDataFrame([(7,), (8,), (999,)], "doc_id long"))
    held = {k: v for k, v in (held | fresh).items() if k not in (7, 8)}
    assert len(lib.segments) == 2 and lib.counts()[0] == sum(bool(v) for v in held.values())
    same(spark, lib, list(held.items()), QUERIES[1:10:2] + QUERIES[-1:])
    # A version that was opened stays as it was, whatever comes after.
    later = library.changed(spark, root, spark.createDataFrame([(100, "alpha gone")], SCHEMA), spark.createDataFrame([(3,)], "doc_id long"))
    assert [r.doc_id for r in search.matches(later, "gone").collect()] == [100] and search.matches(lib, "gone").collect() == [] and search.matches(later, "fresh").collect() == []
    assert later.version == lib.version + 1 == 3


def test_random_changes_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(library, "FAN", 3)
    monkeypatch.setattr(library, "ZONE", 4)
    root, rng, held = str(tmp_path / "lib"), random.Random(5), {}
    for _ in range(5):
        fresh = dict(texts(rng, rng.choice([1, 2, 9, 20]), rng.randrange(30)))
        gone = [k for k in held if rng.random() < 0.15]
        lib = library.changed(spark, root, spark.createDataFrame(list(fresh.items()), SCHEMA), spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        held = {k: v for k, v in held.items() if k not in gone} | fresh
        assert not library._due(lib.segments)
    same(spark, lib, list(held.items()), QUERIES[:3])
    lib = library.changed(spark, root, spark.createDataFrame([], SCHEMA), lib.documents().select("doc_id"))
    assert lib.segments == [] and search.scored(lib, "alpha").collect() == [] and search.top(lib, "alpha").collect() == [] and lib.documents().count() == 0


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names)


def test_a_small_change_writes_little(spark, tmp_path):
    root, rng = str(tmp_path / "lib"), random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=150))) for k in range(3000)], SCHEMA).repartition(4)
    library.changed(spark, root, docs)
    before = size_of(root)
    lib = library.changed(spark, root, spark.createDataFrame([(17, "one changed text")], SCHEMA))
    assert size_of(root) - before < 0.03 * before and len(lib.segments) == 2
    assert [r.doc_id for r in search.matches(lib, "changed").collect()] == [17]


def test_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    root = str(tmp_path / "lib")
    lib = library.changed(spark, root, spark.createDataFrame([(k, f"common term{k:03d}") for k in range(400)], SCHEMA))
    for whole, prefixes in (({"term007"}, ()), ((), {"term00"}), ({"common"}, ())):
        read = {p.split("/postings/")[1].rsplit("/", 1)[0] for p in lib.blocks(whole, prefixes).inputFiles()}
        assert read == {f"segment={s}/bucket={b}" for s, b in lib.places(whole, prefixes)}
        assert len(read) == (1 if whole else len(read)) and len(read) < library.LEAST_BUCKETS + bool(prefixes)
    assert lib.blocks({"absent"}, ()).count() == 0
    assert lib.frequencies(["common", "term001", "none"]) == {"common": 400, "term001": 1}


def test_a_term_of_all_documents_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(library, "ZONE", 2)
    monkeypatch.setattr(library, "STRIPE", 8)
    root = str(tmp_path / "lib")
    lib = library.changed(spark, root, spark.createDataFrame([(k, f"common rare{k}") for k in range(600)], SCHEMA))
    rows = lib.blocks({"common"}, ()).groupBy("bucket").sum("n").collect()
    assert len(rows) == library.LEAST_BUCKETS and sum(r[1] for r in rows) == 600 and max(r[1] for r in rows) <= 3 * 600 / len(rows)
    assert search.matches(lib, "common").count() == 600 and search.matches(lib, "common rare7").count() == 1


def test_best_matches_read_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(library, "ZONE", 8)
    root, rng = str(tmp_path / "lib"), random.Random(3)
    docs = [(k, " ".join(rng.choices(["the", "of", "and", "x", "y", "z"], k=rng.randrange(4, 12))) + (" the" * 30 if k % 400 == 7 else "")) for k in range(2000)]
    lib = library.changed(spark, root, spark.createDataFrame(docs, SCHEMA).repartition(2))
    whole = search.build_index(spark.createDataFrame(docs, SCHEMA))
    for q in ("the", "the OR topic", "the AND of", "the NOT missing", "the missing"):
        assert [(r.doc_id, round(r.score, 9)) for r in search.top(lib, q, 4, 0).collect()] == [(r.doc_id, round(r.score, 9)) for r in search.top(whole, q, 4).collect()], q
    tree = search.M.parse("the")
    frequencies = search._frequencies(lib, tree)
    assert search.candidates(lib, tree, frequencies, 4).count() < 0.1 * search.promises(lib, tree, frequencies).count()


def test_two_writers_lose_nothing(spark, tmp_path):
    root, wrong = str(tmp_path / "lib"), []

    def write(low):
        try:
            for k in range(low, low + 3):
                library.changed(spark, root, spark.createDataFrame([(k, f"text number{k}"), (1000, f"shared {low}")], SCHEMA))
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    writers = [threading.Thread(target=write, args=(low,)) for low in (0, 10)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    lib = library.opened(spark, root)
    assert not wrong and {r.doc_id for r in lib.documents().collect()} == {0, 1, 2, 10, 11, 12, 1000} and lib.documents().count() == 7
    assert search.matches(lib, "text").count() == 6 and search.matches(lib, "shared").count() == 1
    with pytest.raises(ValueError, match="has version"):
        library.changed(spark, root, spark.createDataFrame([(5, "late")], SCHEMA), base=1)


def test_commits_of_many_threads(spark, tmp_path):
    folder = str(tmp_path / "versions")
    add = lambda k: storage.committed(spark, folder, lambda n, text: f"{text or ''}{k};")
    threads = [threading.Thread(target=add, args=(k,)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    number, text = storage.latest(spark, folder)
    assert number == 12 and sorted(map(int, text.strip(";").split(";"))) == list(range(12))
    assert not storage.put_if_absent(spark, f"{folder}/{number:09d}", "other") and storage.latest(spark, folder)[1] == text


def shuffled_since(spark, stage):
    """(bytes that stages after a stage have shuffled, the last stage)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    rows = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    held = [(rows.apply(k).stageId(), rows.apply(k).shuffleWriteBytes()) for k in range(rows.size())]
    return sum(n for k, n in held if k > stage), max((k for k, _ in held), default=-1)


def test_a_segment_shuffles_less_than_its_texts(spark, tmp_path):
    rng = random.Random(4)
    words = [f"word{int(rng.paretovariate(0.6)) % 5000}" for _ in range(200000)]
    texts = [(k, " ".join(words[100 * k : 100 * k + 100])) for k in range(2000)]
    spark.createDataFrame(texts, SCHEMA).repartition(2).write.parquet(str(tmp_path / "docs"))
    _, stage = shuffled_since(spark, -1)
    library.write_segment(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "lib"))
    assert shuffled_since(spark, stage)[0] < 0.8 * sum(len(t) for _, t in texts)


def test_runs_of_wide_numbers(spark, tmp_path, monkeypatch):
    """Ids that are far apart, positions beyond two bytes, and tasks that make many runs."""
    monkeypatch.setattr(library, "RUN_WORDS", 50)
    docs = [(-(1 << 63), "alpha beta"), ((1 << 63) - 1, "beta alpha"), (5, "x " * 40000 + "alpha beta"), (6, "x alpha alpha"), (7, None), *texts(random.Random(6), 200, 100)]
    lib = library.changed(spark, str(tmp_path / "lib"), spark.createDataFrame(docs, SCHEMA))
    same(spark, lib, docs, ["alpha", '"alpha beta"', "x NOT gamma"])
    assert (5 in {r.doc_id for r in search.matches(lib, '"x alpha beta"').collect()}) and lib.blocks({"x"}, ()).groupBy("segment", "zone").count().where("count > 1").count() == 0


def test_blocks_against_python(spark, tmp_path, monkeypatch):
    """Blocks, their entries and peaks; a document without an id, and numbers of one to four planes."""
    monkeypatch.setattr(library, "ZONE", 4)
    monkeypatch.setattr(library, "RUN_WORDS", 100)
    rng = random.Random(8)
    docs = [(k * step, " ".join(rng.choices("abcde", [9, 5, 2, 1, 1], k=rng.randrange(1, 20)))) for k, step in enumerate([1, 70000, 1 << 34, 1 << 50] * 30)] + [(None, "a b a")]
    segment = library.write_segment(spark.createDataFrame(docs, SCHEMA).repartition(2), str(tmp_path))
    blocks = library.Library(spark, str(tmp_path), 1, [segment]).blocks("abcde", ()).collect()
    found = sorted(((b.term, e.doc_id, e.len, e.positions) for b in blocks for e in b.entries), key=str)
    assert found == sorted(((t, i, len(w), [k for k, x in enumerate(w) if x == t]) for i, text in docs for w in [text.split()] for t in set(w)), key=str)
    for b in blocks:
        pairs = {(len(e.positions), e.len) for e in b.entries}
        best = [(tf, n) for tf, n in pairs if not any((t >= tf and m <= n) and (t, m) != (tf, n) for t, m in pairs)]
        assert b.n == len(b.entries) <= 4 and [tuple(p) for p in b.peaks] == sorted(best, key=lambda p: p[1])


def test_a_segment_takes_little_more_time_than_its_terms(spark, tmp_path):
    """CPU seconds of the tasks' JVM; blocks were made number by number before."""
    rng = random.Random(9)
    words = [f"word{int(rng.paretovariate(0.6)) % 5000}" for _ in range(1000000)]
    texts = [(k, " ".join(words[500 * k : 500 * k + 500])) for k in range(2000)]
    spark.createDataFrame(texts, SCHEMA).repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def taken(action):
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        before = max(s.stageId() for s in (stages().apply(k) for k in range(stages().size())))
        action()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        after = stages()
        return sum(s.executorCpuTime() / 1e9 for s in (after.apply(k) for k in range(after.size())) if s.stageId() > before)

    alone = min(taken(lambda: docs.select(library.F.sum(library.F.size(library.T.terms(library.F.col("text"))))).collect()) for _ in range(3))
    whole = min(taken(lambda k=k: library.write_segment(docs, str(tmp_path / f"lib{k}"))) for k in range(3))
    assert whole < 6 * alone
