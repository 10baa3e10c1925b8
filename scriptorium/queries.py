"""Registered queries, each with DuckDB SQL that gives the same rows.

Queries over driver tables read whole tables.  Domain relations that have no driver table are given as VALUES, the same text in
the query and in its SQL.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import align, citations, dedupe, lexicon, library, notes, parallels, passages, search
from .sources import files
from .storage import shared_folder, stamps, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def inline(spark: SparkSession, columns: str, values: str) -> DataFrame:
    """A relation of literal rows; columns as ``name type, ...``."""
    names = [c.split()[0] for c in columns.split(", ")]
    raw = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return raw.select(*[F.col(c.split()[0]).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in columns.split(", ")])


def values(columns: str, rows: str) -> str:
    """The same relation as SQL for DuckDB, to stand in a FROM clause."""
    kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
    parts = [c.split(" ", 1) for c in columns.split(", ")]
    names = ", ".join(n for n, _ in parts)
    return f"(SELECT {', '.join(f'CAST({n} AS {kinds[k]}) AS {n}' for n, k in parts)} FROM (VALUES {rows}) AS t({names}))"


TERMS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"
TOKENS = f"tok AS (SELECT doc_id, unnest({TERMS}) AS term, generate_subscripts({TERMS}, 1) - 1 AS at FROM documents)"
HAS = f"has AS (SELECT doc_id, {TERMS} AS w FROM documents)"

# ---- full-text search


_libraries: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[library.Library, DataFrame]:
    """A library of documents and the clusters of their copies.

    It has a history: first two thirds of the documents came, some with another text, and others that are no longer
    there; then the rest and the texts of now.  So all searches run over two segments, one with dead documents.
    """
    docs, root = table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_folder(spark, 'library')}/library"
    early, other = F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 == 0
    before = docs.where(early).withColumn("text", F.when(other, F.concat(F.lit("thing of the past "), "text")).otherwise(F.col("text")))
    passing = docs.where((F.col("doc_id") % 50) == 0).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    library.changed(spark, root, before.unionByName(passing))
    held = library.changed(spark, root, docs.where(~early | other), passing.select("doc_id"))
    dedupe.exact_clusters(docs).write.mode("overwrite").parquet(f"{root}/clusters")
    return held, spark.read.parquet(f"{root}/clusters")


def _library_of(spark: SparkSession, sf_dir: str) -> tuple[library.Library, DataFrame]:
    """The same, made once for each version of the table, as a refresh makes it, and read by all searches."""
    held = _libraries.setdefault(spark.sparkContext, {})
    version = (sf_dir, *stamps(spark, table(spark, sf_dir, "documents")))
    if version not in held:
        held[version] = _indexed(spark, sf_dir)
    return held[version]


def _matches(spark: SparkSession, sf_dir: str, q: str) -> DataFrame:
    return search.matches(_library_of(spark, sf_dir)[0], q)


@query(f"WITH {HAS} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(len(w)), 6) AS mean_len FROM has WHERE len(w) > 0")
def fts_index_build(spark, sf_dir):
    """Makes the index and the clusters anew; what it costs is in no other query."""
    return _indexed(spark, sf_dir)[0].totals.select("n", F.round("mean_len", 6).alias("mean_len"))


@query(f"WITH {HAS} SELECT doc_id FROM has WHERE list_contains(w, 'the') AND list_contains(w, 'thing')")
def fts_and(spark, sf_dir):
    return _matches(spark, sf_dir, "the thing")


@query(f"WITH {HAS} SELECT doc_id FROM has WHERE list_contains(w, 'ement') OR list_contains(w, 'thing')")
def fts_or(spark, sf_dir):
    return _matches(spark, sf_dir, "ement OR thing")


@query(f"WITH {HAS} SELECT doc_id FROM has WHERE list_contains(w, 'the') AND NOT list_contains(w, 'with')")
def fts_not(spark, sf_dir):
    return _matches(spark, sf_dir, "the NOT with")


@query(f"WITH {TOKENS} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the'")
def fts_phrase(spark, sf_dir):
    return _matches(spark, sf_dir, '"of the"')


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id FROM tok WHERE starts_with(term, 'thing')")
def fts_prefix(spark, sf_dir):
    return _matches(spark, sf_dir, "thing*")


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id FROM tok WHERE term = 'the' AND tok.at = 0")
def fts_first_token(spark, sf_dir):
    return _matches(spark, sf_dir, "^the")


@query(f"WITH {TOKENS} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.at <> b.at AND abs(b.at - a.at) - 1 <= 2 WHERE a.term = 'with' AND b.term = 'for'")
def fts_near(spark, sf_dir):
    return _matches(spark, sf_dir, "NEAR(with for, 2)")


@query(f"WITH {HAS} SELECT doc_id FROM has WHERE (list_contains(w, 'oder') OR list_contains(w, 'les')) AND list_contains(w, 'de')")
def fts_groups(spark, sf_dir):
    return _matches(spark, sf_dir, "(oder OR les) AND text:de")


@query(f"WITH {HAS} SELECT doc_id FROM has WHERE list_contains(w, 'ere') AND list_contains(w, 'le')")
def fts_accent_insensitive(spark, sf_dir):
    return _matches(spark, sf_dir, "éRe LÉ")


@query(f"WITH {HAS} SELECT doc_id FROM has WHERE list_contains(w, 'of') AND list_contains(w, 'the')")
def fts_fallback_quote(spark, sf_dir):
    return _matches(spark, sf_dir, "of/the'")


BM25 = f"""
WITH {TOKENS}, len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
tot AS (SELECT count(*) AS n, avg(n) AS mean FROM len),
tf AS (SELECT doc_id, count(*) FILTER (term = 'thing') AS a, count(*) FILTER (term = 'ing') AS b FROM tok GROUP BY doc_id),
df AS (SELECT count(*) FILTER (a > 0) AS a, count(*) FILTER (b > 0) AS b FROM tf),
score AS (
  SELECT doc_id, -(greatest(ln((tot.n - df.a + 0.5) / (df.a + 0.5)), 1e-6) * tf.a * 2.2 / (tf.a + 1.2 * (0.25 + 0.75 * len.n / tot.mean))
    + greatest(ln((tot.n - df.b + 0.5) / (df.b + 0.5)), 1e-6) * tf.b * 2.2 / (tf.b + 1.2 * (0.25 + 0.75 * len.n / tot.mean))) AS score
  FROM tf JOIN len USING (doc_id), tot, df WHERE tf.a > 0 OR tf.b > 0)
"""
HASHED = "hashed AS (SELECT doc_id, sha256(text) AS content_hash, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' THEN sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS text_hash FROM documents)"


@query(BM25 + "SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM score ORDER BY score, doc_id LIMIT 20)")
def fts_bm25_topk(spark, sf_dir):
    found = search.top(_library_of(spark, sf_dir)[0], "thing OR ing", 20)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(BM25.replace("'thing'", "'the'").replace("'ing'", "'de'") + "SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM score ORDER BY score, doc_id LIMIT 5)")
def fts_pruned_topk(spark, sf_dir):
    """Words of very many documents; of their postings only blocks are scored that can hold one of the best."""
    found = search.top(_library_of(spark, sf_dir)[0], "the OR de", 5, score_all=0)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(
    BM25
    + f""", {HASHED},
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text_hash) AS representative, count(*) OVER (PARTITION BY text_hash) AS members FROM hashed),
cand AS (SELECT * FROM score ORDER BY score, doc_id LIMIT 200)
SELECT doc_id, round(score, 6) AS score, CAST(members AS BIGINT) AS duplicate_count FROM cand JOIN rep USING (doc_id) WHERE representative = doc_id ORDER BY score, doc_id LIMIT 20"""
)
def fts_dedup_topk(spark, sf_dir):
    index, clusters = _library_of(spark, sf_dir)
    found = search.top_without_duplicates(index, "thing OR ing", clusters, 20, among=200)
    return found.select("doc_id", F.round("score", 6).alias("score"), "duplicate_count")


@query(
    f"WITH {TOKENS}, len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), tot AS (SELECT count(*) AS n, avg(n) AS mean FROM len),"
    " tf AS (SELECT a.doc_id, count(*) AS f FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id), df AS (SELECT count(*) AS d FROM tf)"
    " SELECT doc_id, round(-greatest(ln((tot.n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len.n / mean)), 6) AS score FROM tf JOIN len USING (doc_id), tot, df"
)
def fts_phrase_score(spark, sf_dir):
    found = search.scored(_library_of(spark, sf_dir)[0], '"of the"')
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(
    BM25
    + f""", {HASHED},
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text_hash) AS representative, text_hash FROM hashed),
hits AS (SELECT doc_id, score, text_hash FROM score JOIN rep USING (doc_id) WHERE representative = doc_id ORDER BY score, doc_id LIMIT 20),
names AS (SELECT doc_id, 'report ' || (doc_id % 499) AS name, '/lib/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS source_path, lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS rel_path FROM documents),
copies AS (SELECT h.doc_id, CASE WHEN count(*) > 1 THEN string_agg(rel_path, ' ' ORDER BY source_path) ELSE '' END AS duplicate_paths, count(*) AS n FROM hits h JOIN rep r ON h.text_hash = r.text_hash JOIN names m ON r.doc_id = m.doc_id GROUP BY h.doc_id),
near AS (SELECT h.doc_id, o.source_path, row_number() OVER (PARTITION BY h.doc_id ORDER BY o.source_path) AS k FROM hits h JOIN names m ON h.doc_id = m.doc_id JOIN names o ON m.name = o.name AND o.doc_id <> h.doc_id JOIN rep r ON o.doc_id = r.doc_id WHERE r.text_hash IS DISTINCT FROM h.text_hash)
SELECT h.doc_id AS document_id, round(score, 6) AS score, m.source_path, CAST(c.n AS BIGINT) AS duplicate_count, c.duplicate_paths, coalesce((SELECT string_agg(source_path, ' ' ORDER BY source_path) FROM near WHERE near.doc_id = h.doc_id AND k <= 10), '') AS hints, CASE WHEN m.rel_path LIKE 'en/%' THEN true WHEN m.rel_path LIKE 'fr/%' THEN false END AS source_available
FROM hits h JOIN names m ON h.doc_id = m.doc_id JOIN copies c ON h.doc_id = c.doc_id"""
)
def library_hit_rows(spark, sf_dir):
    index, clusters = _library_of(spark, sf_dir)
    place = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("Report "), (F.col("doc_id") % 499).cast("string"), F.when(F.col("doc_id") % 2 == 0, " copy").otherwise(""), F.lit(".txt")).alias("filename"), F.lit("/lib").alias("source_root"), F.concat_ws("/", "lang", place).alias("rel_path"), F.concat_ws("/", F.lit("/lib"), "lang", place).alias("source_path"), F.lit(".txt").alias("extension"), F.lit("ok").alias("extraction_status"))
    there = lambda asked: [{"en": True, "fr": False}.get(p.split("/")[2]) for _, p in asked]
    found = search.assembled(index, docs, clusters, "thing OR ing", 20, available=there)
    return found.select("document_id", F.round("score", 6).alias("score"), "source_path", "duplicate_count", F.array_join("duplicate_paths", " ").alias("duplicate_paths"), F.array_join(F.transform("possible_duplicate_of", lambda h: h["source_path"]), " ").alias("hints"), "source_available")


@query(
    f"WITH {TOKENS}, len AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id), tot AS (SELECT count(*) AS n, avg(n) AS mean FROM len), tf AS (SELECT doc_id, count(*) AS f FROM tok WHERE term = 'thing' GROUP BY doc_id), df AS (SELECT count(*) AS d FROM tf),"
    " best AS (SELECT doc_id FROM (SELECT doc_id, round(-greatest(ln((tot.n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len.n / mean)), 12) AS score FROM tf JOIN len USING (doc_id), tot, df) ORDER BY score, doc_id LIMIT 20),"
    " w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS words FROM documents JOIN best USING (doc_id)),"
    " each AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),"
    " hit AS (SELECT *, CASE WHEN list_contains(regexp_extract_all(strip_accents(lower(word)), '[\\p{L}\\p{N}]+'), 'thing') THEN 1 ELSE 0 END AS h FROM each),"
    " c AS (SELECT doc_id, n, i, sum(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 17 FOLLOWING) AS k FROM hit),"
    " f AS (SELECT DISTINCT ON (doc_id) doc_id, n, i AS low FROM c WHERE i <= greatest(n - 17, 1) ORDER BY doc_id, k DESC, i)"
    " SELECT f.doc_id, CASE WHEN low > 1 THEN '... ' ELSE '' END || string_agg(CASE WHEN h = 1 THEN '[' || word || ']' ELSE word END, ' ' ORDER BY hit.i) || CASE WHEN low + 18 <= f.n THEN ' ...' ELSE '' END AS snippet FROM f JOIN hit ON f.doc_id = hit.doc_id AND hit.i BETWEEN low AND low + 17 GROUP BY f.doc_id, low, f.n"
)
def fts_snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = search.top(_library_of(spark, sf_dir)[0], "thing", 20).select("doc_id")
    return search.snippets(hits, docs, "thing")


@query(f"WITH {TOKENS} SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS occurrences FROM tok GROUP BY term")
def fts_vocabulary(spark, sf_dir):
    return _library_of(spark, sf_dir)[0].vocabulary()


# ---- normal forms and scans

STRIPPED = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '\\s+', ' ', 'g'))"
NORMAL = "replace(lower(trim(regexp_replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), 'ṁ', 'ṃ'), 'ŋ', 'ṃ'), '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query(f"SELECT page_id, md5({STRIPPED.format('html')}) AS text_md5, CAST(length({STRIPPED.format('html')}) AS BIGINT) AS n_chars FROM pages")
def strip_markup(spark, sf_dir):
    plain = table(spark, sf_dir, "pages").select("page_id", T.stripped_markup(F.col("html")).alias("t"))
    return plain.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query(f"SELECT page_id FROM pages WHERE contains({NORMAL.format('html')}, 'that and')")
def norm_substring_scan(spark, sf_dir):
    found = passages.find_phrase(table(spark, sf_dir, "pages").select("page_id", F.lit("p").alias("book_code"), F.col("page_id").alias("id"), F.lit("1").alias("paranum"), F.col("html").alias("pali_text")), "That <b>and</b>", ("pali_text",), 1 << 30)
    return found.select("page_id")


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded_md5 FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("folded_md5"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '… (+' || (length(text) - 200) || ' more characters)' END AS text FROM documents")
def compact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clipped(F.col("text")).alias("text"))


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS line FROM documents)"
    " SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line AS BIGINT) AS line, CASE WHEN length(trim(t)) > 300 THEN left(trim(t), 297) || '...' ELSE trim(t) END AS snippet FROM l WHERE contains(t, 'thing')"
)
def line_grep(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return passages.lines_with(docs, "thing")


@query("SELECT CAST(count(*) AS BIGINT) AS notes, CAST(count(*) FILTER (contains(text, 'thing')) AS BIGINT) AS with_term FROM documents")
def vault_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("notes"), F.count_if(F.contains("text", F.lit("thing"))).alias("with_term"))


@query("SELECT doc_id FROM documents WHERE doc_id BETWEEN 50 AND 400 AND coalesce(text, '') <> ''")
def id_window_pull(spark, sf_dir):
    return passages.id_window(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), 100, 200, text="text").select(F.col("id").alias("doc_id"))


@query("SELECT source AS book_code, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT) AS book_ord FROM (SELECT DISTINCT source FROM documents WHERE source GLOB 'src1?')")
def book_glob(spark, sf_dir):
    return passages.chosen_books(table(spark, sf_dir, "documents"), ["src1?", "none"], "source")


# ---- copies


@query(f"WITH {HASHED}, c AS (SELECT text_hash, count(*) AS n, min(doc_id) AS representative FROM hashed WHERE text_hash IS NOT NULL GROUP BY text_hash HAVING count(*) > 1) SELECT text_hash, CAST(n AS BIGINT) AS members, representative FROM c")
def text_hash_clusters(spark, sf_dir):
    hashed = dedupe.with_hashes(table(spark, sf_dir, "documents"))
    return hashed.where("text_hash is not null").groupBy("text_hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("representative")).where("members > 1")


TWO_KEYS = "k AS (SELECT doc_id, md5(text) AS head, source || ' ' || lang || ' ' || length(text) AS tail FROM documents)"


@query(
    f"WITH RECURSIVE {TWO_KEYS}, e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON (a.head = b.head OR a.tail = b.tail) AND a.doc_id <> b.doc_id),"
    " r AS (SELECT DISTINCT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)"
    ", l AS (SELECT node, min(reached) AS representative FROM r GROUP BY node)"
    " SELECT node AS doc_id, representative, CAST(count(*) OVER (PARTITION BY representative) AS BIGINT) AS members FROM l"
)
def dup_components(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("head"), F.concat_ws(" ", "source", "lang", F.length("text").cast("string")).alias("tail"))
    return dedupe.clusters(docs, ["head", "tail"])


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", F.lit(""), "lang", "source", F.col("doc_id").cast("string")).alias("source_path"), F.concat(F.lit("File "), (F.col("doc_id") % 97).cast("string"), F.when(F.col("doc_id") % 3 == 0, " copy 2").when(F.col("doc_id") % 3 == 1, "_v3").otherwise(""), F.when(F.col("doc_id") % 5 == 0, ".pdf").otherwise(".txt")).alias("filename"), F.when(F.col("doc_id") % 5 == 0, ".pdf").otherwise(".txt").alias("extension"), "n_chars", F.col("n_chars").alias("size"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 5 != 0, T.text_hash(F.col("text"))).alias("text_hash"))


LIBRARY = """lib AS (SELECT doc_id, '/' || lang || '/' || source || '/' || doc_id AS source_path, 'file ' || (doc_id % 97) AS name_key, n_chars AS size, CASE WHEN doc_id % 5 = 0 THEN '.pdf' ELSE '.txt' END AS extension,
  sha256(text) AS content_hash, CASE WHEN doc_id % 5 <> 0 AND trim(text) <> '' THEN sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS text_hash FROM documents),
g AS (SELECT doc_id, source_path, extension, text_hash, 'content_hash' AS grouping, content_hash AS key FROM lib UNION ALL SELECT doc_id, source_path, extension, text_hash, 'text_hash', text_hash FROM lib WHERE text_hash IS NOT NULL
  UNION ALL SELECT doc_id, source_path, extension, text_hash, 'normalized_filename', name_key FROM lib UNION ALL SELECT doc_id, source_path, extension, text_hash, 'normalized_filename_size', name_key || '|' || size FROM lib UNION ALL SELECT doc_id, source_path, extension, text_hash, 'size', CAST(size AS VARCHAR) FROM lib),
c AS (SELECT grouping, key, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1)"""


@query(f"WITH {LIBRARY} SELECT grouping, CAST(count(*) AS BIGINT) AS cluster_count, CAST(sum(n) AS BIGINT) AS file_count FROM c GROUP BY grouping")
def dup_diagnostic(spark, sf_dir):
    return dedupe.report(_library(spark, sf_dir))


@query(f"WITH {LIBRARY}, r AS (SELECT *, row_number() OVER (PARTITION BY grouping ORDER BY n DESC, key) AS rank FROM c) SELECT r.grouping, CAST(rank AS BIGINT) AS rank, r.key, string_agg(source_path, ' ' ORDER BY source_path) AS paths FROM r JOIN g ON r.grouping = g.grouping AND r.key = g.key WHERE rank <= 5 GROUP BY ALL")
def dup_samples(spark, sf_dir):
    return dedupe.samples(_library(spark, sf_dir)).withColumn("paths", F.array_join("paths", " "))


@query(f"WITH {LIBRARY} SELECT extension, CAST(count(DISTINCT doc_id) AS BIGINT) AS file_count FROM g JOIN c USING (grouping, key) WHERE text_hash IS NULL GROUP BY extension")
def dup_without_text(spark, sf_dir):
    return dedupe.candidates_without_text(_library(spark, sf_dir))


@query(
    "WITH d AS (SELECT page_id, url, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/([^/]+)', 1)) AS name FROM pages), p AS (SELECT a.page_id, b.url FROM d a JOIN d b ON a.name = b.name AND a.page_id <> b.page_id WHERE a.name <> ''),"
    " r AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY url) AS n FROM p) SELECT page_id, string_agg(url, ' ' ORDER BY url) AS hints FROM r WHERE n <= 10 GROUP BY page_id"
)
def weak_hints(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source_path"), F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^https?://[^/]+/([^/]+)", 1).alias("filename"))
    return dedupe.weak_hints(pages).select(F.col("doc_id").alias("page_id"), F.array_join("hints", " ").alias("hints"))


# ---- ordered rows


@query("SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END, last_value(CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS owner FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def owner_forward_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct().withColumn("paranum", F.when(F.col("role") == "user", F.col("turn").cast("string")).otherwise(""))
    return passages.with_owner(c, "conv_id", "turn").select("conv_id", "turn", "owner")


@query("SELECT conv_id, turn, first_value(CASE WHEN role = 'user' THEN CAST(turn AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_owner FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def next_owner(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct().withColumn("paranum", F.when(F.col("role") == "user", F.col("turn").cast("string")).otherwise(""))
    return passages.with_next_owner(c, "conv_id", "turn").select("conv_id", "turn", "next_owner")


@query(
    "WITH p AS (SELECT event_id, user_id, ts FROM events), e AS (SELECT user_id, ts, min(event_id) AS found_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL)"
    " SELECT p.event_id, e.found_id FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts"
)
def asof_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min("event_type").alias("lo"))
    probes = events.select("event_id", "user_id", "ts")
    entries = events.crossJoin(F.broadcast(ends)).where("event_type = lo").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("found_id"))
    return passages.nearest_earlier(probes, entries, ["user_id"], "ts", "start", [F.col("found_id")], ["found_id"]).select("event_id", "found_id")


BANDS = "(1, 10, 'small'), (8, 25, 'middle'), (26, 26, 'one'), (40, 30, 'none')"


@query(f"SELECT p_partkey, name FROM part JOIN {values('low int, high int, name string', BANDS)} b ON p_size BETWEEN low AND high")
def range_containment(spark, sf_dir):
    return passages.within_range(table(spark, sf_dir, "part").select("p_partkey", "p_size"), inline(spark, "low int, high int, name string", BANDS), [], "p_size", "low", "high", 8).select("p_partkey", "name")


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) WHERE role IS DISTINCT FROM before")
def run_starts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    return c.withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("not (role <=> before)").drop("before")


# ---- citations


ALLOWED = "('trusted', 'blog.', ''), ('probationary', 'm.', 'com'), ('excluded', 'Www.', ''), ('trusted', 'www.', 'net')"
HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(f"WITH p AS (SELECT page_id, regexp_extract({HOST}, '^(www\\.|m\\.|blog\\.)', 1) AS channel, regexp_extract({HOST}, '([a-z]+)$', 1) AS channel_id FROM pages), a AS (SELECT CASE tier WHEN 'excluded' THEN 0 WHEN 'trusted' THEN 1 ELSE 2 END AS rank, lower(name) AS name, id FROM {values('tier string, name string, id string', ALLOWED)}) SELECT page_id, ['excluded', 'trusted', 'probationary'][coalesce(min(rank), 2) + 1] AS tier FROM p LEFT JOIN a ON (a.id <> '' AND a.id = channel_id) OR (a.name <> '' AND a.name = channel) GROUP BY page_id")
def tier_classify(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(host, r"^(www\.|m\.|blog\.)", 1).alias("channel"), F.regexp_extract(host, "([a-z]+)$", 1).alias("channel_id"))
    return citations.tier(pages, inline(spark, "tier string, name string, channel_id string", ALLOWED)).select("page_id", "tier")


# ---- parallels and alignment


def _conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    return c.select(F.when(F.col("role") == "user", "root").otherwise("translation").alias("kind"), F.col("role").alias("author"), F.col("conv_id").cast("string").alias("file_stem"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("uid"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(":"), F.floor(F.col("turn") / 2).cast("string")).alias("seg_key"), F.col("turn").alias("line_no"), F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("path"), "text")


@query("WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), h AS (SELECT * FROM c WHERE role = 'user' AND contains(lower('\"c' || conv_id || ':' || (turn // 2) || '\": \"' || text || '\"'), 'thing') ORDER BY conv_id, turn LIMIT 500) SELECT 'c' || conv_id AS uid, CAST(count(DISTINCT turn // 2) AS BIGINT) AS segments FROM h GROUP BY conv_id")
def align_locate(spark, sf_dir):
    return align.located(_conversation_segments(spark, sf_dir), "Thing").groupBy("uid").agg(F.count("*").alias("segments"))


# ---- dictionaries


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE 'small%'")
def headword_prefix(spark, sf_dir):
    return lexicon.headwords(table(spark, sf_dir, "part"), "SMALL", "p_name").select("p_partkey", "p_name")


@query("SELECT lang, source, CAST(count(*) AS BIGINT) AS documents FROM documents GROUP BY ALL")
def tag_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("documents"))


# ---- audits, logs, snapshots


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def coverage_missing(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.lit("n").alias("note"), F.col("doc_id").alias("document_id"), "source")
    note = table(spark, sf_dir, "labels").select(F.lit("n").alias("note"), F.concat(F.lit("see Calibre #"), F.col("doc_id").cast("string"), F.lit(".")).alias("text"))
    return notes.unmentioned(hits, note).select(F.col("document_id").alias("doc_id"), "source")


@query("SELECT 'missing' AS kind, doc_id || '.pdf' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT 'orphan', (doc_id + 1000000) || '.pdf' FROM labels WHERE quality = 0")
def tree_audit(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    labels = table(spark, sf_dir, "labels")
    p = labels.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path")).union(labels.where("quality = 0").select(F.concat((F.col("doc_id") + 1000000).cast("string"), F.lit(".pdf")).alias("path")))
    return notes.tree_audit(n, p)


@query("SELECT change, CAST(count(*) AS BIGINT) AS files FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'deleted' WHEN doc_id % 13 = 0 THEN 'changed' WHEN doc_id % 17 = 0 THEN 'retried' ELSE 'skipped' END AS change FROM documents) GROUP BY change")
def snapshot_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("/r").alias("source_root"), F.concat(F.lit("/r/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.lit(1.0).alias("mtime"))
    old = d.where("doc_id % 7 <> 0").withColumn("size", F.when(F.col("doc_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("extraction_status", F.when(F.col("doc_id") % 17 == 0, "error: x").otherwise("ok"))
    new = d.where("not (doc_id % 11 = 0 and doc_id % 7 <> 0)")
    return files.changes(old, new, retry_failed=True).groupBy("change").agg(F.count("*").alias("files"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(TRY_CAST(props AS JSON)) AS BIGINT) AS readable FROM events GROUP BY event_type")
def event_json(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.try_parse_json("props")).alias("readable"))


from . import queries_derived, queries_small, queries_tables  # noqa: E402, F401  register their queries
