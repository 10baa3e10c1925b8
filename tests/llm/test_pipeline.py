"""The stages and the registered queries, against brute force over a small fixture."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from scriptorium.llm import catalogue

from .test_pii import base
from .test_simhash import brute as linked
from .test_text_operators import brute as contaminated


def fixture(spark, folder):
    r = random.Random(12)
    parts = {"en": "the and ing tion ed er th wh".split(), "fr": "le la eau oui ment que é ç".split(), "de": "sch ung keit ein der ü ß ch".split()}

    def text(lang, n):
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))

    items = [(k, text("en", 30)) for k in range(4)]
    docs = [(i, text(lang := "en fr de".split()[i % 3], r.randint(30, 90)), lang) for i in range(60)]
    docs += [(100 + i, docs[i][1], docs[i][2]) for i in range(10)]
    docs += [(200 + i, f"{text('en', 40)} {items[i][1]} {text('en', 40)}", "en") for i in range(4)]
    docs += [(300, items[0][1], "en"), (301, None, "en"), (302, "123 456 !!", None), (303, "", "fr"), (304, f"{text('en', 30)} mail me@site.org or +1 (555) 555-2485 {text('en', 20)}", None)]
    rows = [(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    page = "<html><body><nav><a href='/'>x</a></nav><article><h1>Head</h1><p>Body text of the page, long enough.</p></article></body></html>"
    spark.createDataFrame([(1, "u", page), (2, "v", page), (3, "w", None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, items = fixture(spark, folder)
    read = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = read.columns, read
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "sequences"]
    after = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder)
        if name != "sequences":
            assert kept.columns == columns
            kept.write.parquet(f"{folder}/out-{name}")
            kept = spark.read.parquet(f"{folder}/out-{name}")
            after.append({r.doc_id: r for r in kept.collect()})
    language, near, clean, private = after
    texts = {d: t for d, t, _ in docs}
    assert set(language) == set(texts) - {301, 302, 303}
    groups = linked([(d, texts[d]) for d in language])
    assert set(near) == {d for d, _, c in groups if d == c} and not set(near) & set(range(100, 110))
    for d in near:
        n, hit, _ = contaminated(texts[d], items)
        assert (d in clean) == (hit <= 0.5 * n)
        if d in clean:
            assert contaminated(clean[d].text, items)[1] == 0 and (hit > 0 or clean[d].text == texts[d]) and clean[d].n_chars == len(clean[d].text)
    for d, r in private.items():
        assert base(r.text) == [] and (base(clean[d].text) or r.text == clean[d].text) and r.n_chars == len(r.text)
    assert "<EMAIL>" in private[304].text and "<PHONE>" in private[304].text
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = kept.collect()
    assert {r.doc_id for r in pieces} == set(private)
    for d, r in private.items():
        ids, at = [*t.encode(r.text, add_special_tokens=False).ids, 2], 0
        for p in sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def test_queries(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, _ = fixture(spark, folder)
    columns = {
        "op1_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op2_html": "page_id url text n_chars",
        "op3_token_store": "doc_id start n_tokens ids_crc32",
        "op4_simhash": "doc_id fingerprint component_id",
        "op5_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op6_pack": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op7_langid": "doc_id held_out lang_pred score",
        "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op9_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op10_warc": "page_id payload_bytes payload_digest record_type refers_to",
    }
    assert list(catalogue.QUERIES) == list(columns)
    for name, f in catalogue.QUERIES.items():
        out = f(spark, folder)
        assert set(columns[name].split()) <= set(out.columns), name
        key = "page_id" if "page_id" in out.columns else "doc_id"
        assert {r[0] for r in out.select(key).collect()} == ({1, 2, 3} if key == "page_id" else {d for d, _, _ in docs}), name
    stored = {r.doc_id: r for r in catalogue.op3_token_store(spark, folder).collect()}
    t, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for d, text, _ in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(stored[d]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.page_id: r.text for r in catalogue.op2_html(spark, folder).collect()} == {1: "Head Body text of the page, long enough.", 2: "Head Body text of the page, long enough.", 3: ""}
    found = {r.doc_id: (r.items_sha256, r.contaminated) for r in catalogue.op1_decontaminate(spark, folder).collect()}
    assert found[200] == (hashlib.sha256(b"0").hexdigest(), True) and found[0] == (hashlib.sha256(b"").hexdigest(), False)
