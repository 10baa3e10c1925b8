"""Registered queries of the smaller operators: sources, predicates, set operations, scalar functions, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import notes, passages, runlog
from .queries import query
from .sources import files, tree
from .storage import shared_folder, table, written
from .streaming import tables as streams

# ---- sources


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


PATH = "'/lib' || CASE WHEN doc_id % 7 = 0 THEN '/.git' WHEN doc_id % 7 = 1 THEN '/skip' WHEN doc_id % 7 = 2 THEN '/skipped' ELSE '' END || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.Png' WHEN 2 THEN '.pdf' ELSE '' END"


@query(f"SELECT {PATH} AS path FROM documents WHERE doc_id % 7 NOT IN (0, 1) AND doc_id % 4 <> 1")
def accepted_files(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").selectExpr(f"{PATH} AS path")
    return paths.where(files.accepted(F.col("path"), ["/lib"], ["/lib/skip"]))


@query("SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (trim(text) <> '') AS BIGINT) AS with_text, CAST(count(DISTINCT source) AS BIGINT) AS roots FROM documents")
def index_health(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_if(T.collapsed(F.col("text")) != "").alias("with_text"), F.count_distinct("source").alias("roots"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text_md5 FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE trim(text) <> '') GROUP BY conv_id")
def segment_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").distinct().where(F.trim("text") != "")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("conv_id").agg(F.md5(whole).alias("text_md5"))


# ---- predicates and sets


@query("SELECT doc_id FROM documents WHERE contains(concat_ws(' ', lang, source, text), 'src7 ') AND lang = 'en'")
def theme_grep(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains(F.concat_ws(" ", "lang", "source", "text"), F.lit("src7 ")) & (F.col("lang") == "en")).select("doc_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").distinct()
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT user_id, bool_or(value > 90) AS any_ok, CAST(count(*) AS BIGINT) AS entries FROM events GROUP BY user_id")
def any_entry_ok(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 90).alias("any_ok"), F.count("*").alias("entries"))


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents) SELECT source, string_agg(doc_id, ',' ORDER BY doc_id) || CASE WHEN max(total) > 3 THEN ' +' || (max(total) - 3) || ' more' ELSE '' END AS shown FROM r WHERE n <= 3 GROUP BY source")
def capped_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    total = d.groupBy("source").agg(F.count("*").alias("total"))
    # Ranks are limited before rows meet, so a hot source sends three rows a task.
    first = d.select("source", "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= 3")
    ids = first.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    more = F.when(F.col("total") > 3, F.concat(F.lit(" +"), (F.col("total") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return ids.join(total, "source").select("source", F.concat(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), more).alias("shown"))


@query("SELECT DISTINCT ON (text) doc_id, md5(text) AS text_md5 FROM documents ORDER BY text, doc_id")
def first_of_each(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.md5("text").alias("text_md5"))


# ---- scalar functions


@query("SELECT doc_id, CAST(json_object('id', doc_id, 'lang', lang) AS VARCHAR) AS json FROM documents")
def json_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang")).alias("json"))


@query("SELECT event_id, strftime(ts, '%Y%m%d') AS day, CAST(CAST(ts AS DATE) AS VARCHAR) AS iso FROM events")
def day_forms(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("day"), F.to_date("ts").cast("string").alias("iso"))


@query("SELECT doc_id || '.pdf' AS path FROM documents")
def printed_paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(notes.printed_path(F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))


@query("SELECT page_id, CAST(length(html) - length(replace(html, '<p>', '')) AS BIGINT) // 3 AS paragraphs, html = html AS valid FROM pages")
def valid_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    whole = F.make_valid_utf8(F.col("html"))
    return p.select("page_id", F.floor((F.length(whole) - F.length(F.replace(whole, F.lit("<p>"), F.lit("")))) / 3).alias("paragraphs"), (whole == F.col("html")).alias("valid"))


# ---- evidence, maintenance, streams


@query("SELECT event_id || '-report.md' AS path FROM events WHERE strftime(ts, '%Y') = '2024' AND starts_with(CAST(event_id AS VARCHAR), '12')")
def reports_of_day(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.concat(F.col("event_id").cast("string"), F.lit("-report.md")).alias("path"))
    return runlog.reports_of(names, "12")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS tool, CAST(count(*) AS BIGINT) AS entries, CAST(sum(floor(value)) AS BIGINT) AS hits FROM events GROUP BY ALL")
def hits_by_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.floor("value").alias("hits"))
    return streams.hits_by_window(e, "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 13 = 0 THEN 'changed' ELSE 'old' END AS state FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 = 0")
def snapshot_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("/r").alias("source_root"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(1.0).alias("mtime"))
    old = d.where("doc_id % 7 <> 0").withColumn("size", F.when(F.col("doc_id") % 13 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("extraction_status", F.lit("ok"))
    new = d.where("not (doc_id % 11 = 0 and doc_id % 7 <> 0)")
    change = files.changes(old, new)
    return change.where("change <> 'deleted'").select(F.col("path").cast("bigint").alias("id"), F.when(F.col("change") == "skipped", "old").otherwise(F.col("change")).alias("state"))


@query(
    "WITH d AS (SELECT *, doc_id % 7 = 0 AS fresh, doc_id % 11 = 0 AND doc_id % 7 <> 0 AS gone, doc_id % 13 = 0 AND doc_id % 11 <> 0 AND doc_id % 7 <> 0 AS other FROM documents)"
    " SELECT CAST(count(*) FILTER (fresh) AS BIGINT) AS \"new\", CAST(count(*) FILTER (other) AS BIGINT) AS changed, CAST(count(*) FILTER (NOT fresh AND NOT gone AND NOT other) AS BIGINT) AS skipped, CAST(count(*) FILTER (gone) AS BIGINT) AS deleted,"
    " CAST(count(*) FILTER (NOT gone) AS BIGINT) AS indexed, CAST(count(*) FILTER (fresh OR other) AS BIGINT) AS written, CAST(count(*) FILTER (other OR fresh AND trim(text) <> '') AS BIGINT) AS text_extracted, CAST(0 AS BIGINT) AS error_count FROM d"
)
def refresh_counters(spark, sf_dir):
    """Documents as files in a folder, refreshed twice: in between some came, some changed, and a subtree was left out."""
    folder = shared_folder(spark, "tree")
    docs, fresh, gone = table(spark, sf_dir, "documents"), F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0
    named = docs.select("doc_id", F.concat(F.when(gone & ~fresh, "old/").otherwise("now/"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    tree.put(named.where(~fresh), folder)
    old, _ = files.refreshed(spark, files.empty_documents(spark), files.Roots([folder]))
    old = written(old, "documents")
    tree.put(named.where(fresh | ((F.col("doc_id") % 13 == 0) & ~gone)).withColumn("text", F.when(fresh, F.col("text")).otherwise(F.concat("text", F.lit(" more")))), folder)
    _, counts = files.refreshed(spark, old, files.Roots([folder], [f"{folder}/old"]))
    return counts.select("new", "changed", "skipped", "deleted", "indexed", "written", "text_extracted", "error_count")


@query("WITH p AS (SELECT event_id, user_id, ts FROM events), e AS (SELECT user_id, ts, min(event_id) AS found_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL) SELECT p.user_id, CAST(count(e.found_id) AS BIGINT) AS found FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts GROUP BY p.user_id")
def asof_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    least = events.agg(F.min("event_type").alias("lo"))
    entries = events.join(F.broadcast(least), F.col("event_type") == F.col("lo")).select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("found_id"))
    found = passages.nearest_earlier(events.select("event_id", "user_id", "ts"), entries, ["user_id"], "ts", "start", [F.col("found_id")], ["found_id"])
    return found.groupBy("user_id").agg(F.count("found_id").alias("found"))
