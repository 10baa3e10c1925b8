"""The thin query of each operator of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, html_extract, langid, media, merkle, packing, pii, recompress, sharding, simhash, token_store, warc
from ._common import shared_folder, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit by windows of the benchmark, of every document; nulls, repeats and empty tables as in ``decontaminate.report``."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; nulls, repeats and empty tables as in ``html_extract.report``."""
    return html_extract.report(table(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, read back from shard files; nulls, repeats and empty tables as in ``token_store.write``."""
    folder = shared_folder(spark, "op3")
    manifest = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_store.read(spark, folder, manifest, digest=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, repeats and empty tables as in ``simhash.groups``."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from every document's stored samples; nulls, repeats and empty tables as in ``media.report``."""
    return media.report(table(spark, sf_dir, "documents"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences; nulls, repeats and empty tables as in ``packing.pack``."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language predicted for every document; nulls, repeats and empty tables as in ``langid.report``."""
    return langid.report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; nulls, repeats and empty tables as in ``pii.report``."""
    return pii.report(table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document; nulls, repeats and empty tables as in ``sharding.assign``."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every page, read back from the archives; nulls, repeats and empty tables as in ``warc.write``."""
    folder = shared_folder(spark, "op10")
    manifest = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document; nulls, repeats and empty tables as in ``merkle.report``."""
    return merkle.report(table(spark, sf_dir, "documents"))


def op12_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without repeated windows; nulls, repeats and empty tables as in ``recompress.deduplicate``."""
    return recompress.report(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ; nulls, repeats and empty tables as in ``divergence.audit``."""
    return divergence.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_html, op3_token_store, op4_simhash, op5_media, op6_pack, op7_langid, op8_pii, op9_shards, op10_warc, op11_merkle, op12_recompress, op13_divergence)}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
spots AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT s.r, s.i, s.n, b.item_id FROM spots s JOIN windows b ON s.n = b.n AND s.k = b.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
    "op10_warc": """
WITH h AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM f
""",
    "op11_merkle": """
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda k: ascii(substr(doc_id::VARCHAR, k + 1, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) END AS crc
  FROM documents),
f AS (
  SELECT doc_id, lang, crc, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM d),
l AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS tampered FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
nodes AS (
  SELECT 0 AS level, tree, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT any_value(level) + 1, tree, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, pos // 8),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, place AS pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY pos // 8),
runs AS (SELECT 0 AS part, level, tree, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8
  UNION ALL SELECT 1, level, '', pos // 8, list(digest ORDER BY pos) FROM upper WHERE n > 1 GROUP BY level, pos // 8),
steps AS (
  SELECT x.tree, x.pos AS id, r.part, r.level, r.digests, (CASE WHEN r.part = 0 THEN x.pos ELSE s.place END) // CAST(pow(8, r.level) AS BIGINT) % 8 AS k
  FROM leaves x JOIN subroots s USING (tree) JOIN runs r ON (r.part = 0 AND r.tree = x.tree AND r.run = x.pos // CAST(pow(8, r.level + 1) AS BIGINT)) OR (r.part = 1 AND r.run = s.place // CAST(pow(8, r.level + 1) AS BIGINT))),
paths AS (SELECT tree, id, list(struct_pack(b := array_to_string(digests[1:k], ''), a := array_to_string(digests[k + 2:], '')) ORDER BY part, level) AS path FROM steps GROUP BY tree, id),
whole AS (
  SELECT x.doc_id, x.leaf, s.subroot, (SELECT digest FROM upper WHERE n = 1) AS root, coalesce(p.path, []) AS path, coalesce(x.tampered, x.leaf) AS start
  FROM leaves x JOIN subroots s USING (tree) LEFT JOIN paths p ON p.tree = x.tree AND p.id = x.pos),
folded AS (SELECT *, list_reduce(list_prepend(struct_pack(b := start, a := ''), path), lambda d, p: struct_pack(b := sha256(concat(p.b, d.b, p.a)), a := '')).b AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.b || p.a), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
""",
    "op12_recompress": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
flagged AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE doc_id > first),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
marked AS (SELECT words.r, words.i, word, max(CASE WHEN flagged.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY words.r ORDER BY words.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM words LEFT JOIN flagged ON words.r = flagged.r AND words.i = flagged.i),
kept AS (SELECT r, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM each GROUP BY lang, term HAVING count(*) >= 30),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, CAST(sum(each.n) AS BIGINT) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * v) AS p, 1 + 1000000000 * (k.n + 5) // (l.total + 5 * v) AS q
  FROM sources s JOIN kept k ON s.lang = k.lang JOIN langs l ON s.lang = l.lang LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every) WHERE part = 'pair' OR rank <= 50
""",
}
