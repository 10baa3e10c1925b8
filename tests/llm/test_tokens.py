import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from scriptorium.llm import catalogue, eliasfano, packing, token_store
from scriptorium.llm.tokens import Encoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
_held: dict = {}


def library(path):
    if path not in _held:
        _held[path] = (Tokenizer.from_file(path), Encoder(path, cache_words=50))
    return _held[path]


@given(st.one_of(st.text(max_size=60), st.text("ab 'stremvld.,\n\t!éÀ²½ß12", max_size=60), st.text("a <|endoftext|>İ日“—€", max_size=40)))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_library(text):
    for path in (BYTE, WORD):
        t, e = library(path)
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


ESCAPING = "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ"


@given(st.text(ESCAPING + "aZÉ1 '", max_size=30))
@settings(max_examples=200, deadline=None)
def test_capitals_with_unknown_lower_case(text):
    for path in (BYTE, WORD):
        t, e = library(path)
        for x in (text, "AZƏRBAYCAN", *(f"A{c}B {c}a" for c in ESCAPING)):
            assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


SPECIAL = ["one document<|endoftext|>next", "<|endoftext|>", "a <|startoftext|> B<|ENDOFTEXT|>c<|endoftext|><|endoftext", "日<|endoftext|>x"]


def test_special_tokens_as_the_library_loads(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    spark.createDataFrame(list(enumerate([*SPECIAL, "plain"])), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    want = {path: [[*Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids, 2] for x in [*SPECIAL, "plain"]] for path in (BYTE, WORD)}
    digests = {path: {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)} for path, ids in want.items()}
    assert 50256 in want[BYTE][0] and 49407 in want[WORD][0]
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in catalogue.op3_token_store(spark, sf).collect()} == digests[BYTE]
    packed = [catalogue.op6_pack(spark, sf), corpus_pipeline.sequences(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)]
    assert [{r.doc_id: (r.length, r.ids_crc32) for r in x.collect()} for x in packed] == [digests[WORD]] * 2


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=60), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_elias_fano(values, repeat):
    values = sorted(values * (repeat + 1))
    s = eliasfano.Sequence(eliasfano.encode(np.array(values, np.int64)))
    assert len(s) == len(values) and s.values().tolist() == values and [s.select(i) for i in range(len(s))] == values


def test_elias_fano_is_small():
    r = random.Random(1)
    values = np.cumsum([r.randint(1, 2000) for _ in range(20_000)])
    code = eliasfano.encode(values)
    assert 8 * len(code) / len(values) < 2 + np.log2(values[-1] / len(values)) + 1
    s = eliasfano.Sequence(code)
    assert all(s.select(i) == values[i] for i in r.sample(range(20_000), 300))
    with pytest.raises(ValueError):
        eliasfano.encode(np.array([2, 1]))


ROWS = [(5, "Hello world"), (1, None), (9, ""), (3, "é ü <|endoftext|> " * 40), (3, "again"), (None, "no id"), (-4, "x" * 3000), (3, "again"), (7, "long text. " * 3000)]
SCHEMA = "doc_id long, text string, start string, n_tokens int"


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "s", 1) for d, t in rows], SCHEMA)


def ids_of(path, text, end=2):
    return (library(path)[0].encode(text, add_special_tokens=False).ids if text else []) + [end]


def test_store_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    manifest = token_store.write(docs_of(spark), BYTE, folder, shards=3)
    rows = token_store.read(spark, folder).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=lambda r: (key(r), r[1])) == sorted(((d, ids_of(BYTE, t)) for d, t in ROWS), key=lambda r: (key(r), r[1]))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.read(spark, folder, manifest, digest=True).collect()}
    assert digests == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}
    shard = token_store.Shard(folder, manifest[-1]["name"])
    assert [(shard.doc_id(i), shard.ids(i).tolist()) for i in range(len(shard))] == [(d, x.tolist()) for d, _, x in shard.scan()]


def test_store_rolls_by_size_and_repeats(spark, tmp_path):
    docs = docs_of(spark, [(7, f"text {k} {'word ' * (k % 40)}") for k in range(400)] + [(k, "b c") for k in range(300)] + [(None, f"n{k}") for k in range(50)])
    made = []
    for k in range(2):
        folder = f"file://{tmp_path}/s{k}"
        made.append(token_store.write(docs, BYTE, folder, shards=1, shard_bytes=2000))
    assert made[0] == made[1] and len(made[0]) > 20 and max(m["documents"] for m in made[0]) < 200
    for m in made[0]:
        assert (tmp_path / "s0" / m["name"]).read_bytes() == (tmp_path / "s1" / m["name"]).read_bytes()
    rows = sorted(token_store.read(spark, f"file://{tmp_path}/s0").collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert len(rows) == 750 and ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_store_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_store.write(docs_of(spark).limit(0), BYTE, folder) == [] and token_store.read(spark, folder).collect() == []


@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_differencing_deals_all(sizes, k):
    out = packing.differencing(sizes, k)
    assert len(out) == k and sorted(i for w in out for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in out]
    assert max(sums, default=0) - min(sums, default=0) <= max(sizes, default=0)
    full = packing.windows(sizes, 60)
    assert all(sum(sizes[i] for i in w) <= 60 for w in full)


def test_padding_of_differencing_and_of_taking_up_room():
    r = random.Random(9)
    parts = [(k, 0, bytes(4 * r.randint(1, 1024)), 1) for k in range(1800)]
    sizes = [len(p[2]) // 4 for p in parts]
    dealt = packing.windows(sizes, 4096)
    alone = 1 - sum(sizes) / (4096 * len(dealt))
    full, left = packing.topped_up(parts, dealt, 4096)
    both = 1 - sum(sizes) / (4096 * (len(full) + bool(left)))
    assert 0 <= both <= alone < 0.02 and sum(len(p[2]) for s in full for p in s) + sum(len(p[2]) for p in left) == 4 * sum(sizes)
    # Windows that differencing filled, and pieces of windows that stay, are left as they were.
    whole = [[(p[0], p[1], len(p[2])) for p in s] for s in full]
    kept = sorted(range(len(dealt)), key=lambda i: (-sum(sizes[j] for j in dealt[i]), i))[: len(full)]
    for s, w in zip(whole, kept, strict=True):
        assert s[: len(dealt[w])] == [(i, 0, 4 * sizes[i]) for i in dealt[w]]
    exact = packing.topped_up([(k, 0, bytes(4 * 64), 1) for k in range(8)], [[0], [1], [2], [3, 4], [5], [6], [7]], 128)
    assert exact[0][0] == [(3, 0, bytes(256), 1), (4, 0, bytes(256), 1)] and len(exact[0]) == 4 and exact[1] == []


def check_pieces(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and {r.sequence_tokens for r in group} == {at} and {r.padded_to for r in group} == {at if at & (at - 1) == 0 else capacity}
    for d, text in docs:
        ids = ids_of(WORD, text)
        at = 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    return by_sequence


def test_packing(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice(["word", "other", "x1", "élan"]) for _ in range(r.choice([0, 1, 5, 40, 150])))) for i in range(200)] + [(900, None), (901, "many words " * 700)]
    rows = packing.pack(docs_of(spark, docs).coalesce(1), WORD, capacity=64, held_windows=8).collect()
    sequences = check_pieces(rows, docs, 64)
    total = sum(len(ids_of(WORD, t)) for _, t in docs)
    assert len(sequences) <= -(-total // 64) + 1
    assert packing.pack(docs_of(spark).limit(0), WORD).collect() == []
    twice = packing.pack(docs_of(spark, [(1, "a b c"), (1, "a b c"), (None, "z")]).coalesce(1), WORD).collect()
    assert sorted((x.doc_id is None, x.length) for x in twice) == [(False, 4), (False, 4), (True, 2)]
