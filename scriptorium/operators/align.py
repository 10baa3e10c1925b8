"""Renderings of a phrase by its translators, side by side.

segments: kind ('root' or 'translation'), author, file_stem, uid, seg_key, line_no, path, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

LOCATE_LINES, SEGMENTS, CANDIDATES = 500, 20, 15


def located(segments: DataFrame, phrase: str, lines: int = LOCATE_LINES) -> DataFrame:
    """uid, file_stem, nth, seg_key: root segments whose line (key and text) holds the phrase, of the first `lines` such lines.

    Lines are looked at by path and line; case and the two ways of writing a dotted m don't count.  nth: order in the uid.
    """
    line = F.concat(F.lit('"'), F.col("seg_key"), F.lit('": "'), F.col("text"), F.lit('"'))
    needle = F.lower(T.dotted_above(F.lit(phrase.strip())))
    hits = segments.where((F.col("kind") == "root") & F.contains(F.lower(line), needle) & F.contains("seg_key", F.lit(":"))).orderBy("path", "line_no", "seg_key").limit(lines)
    first = hits.groupBy("uid", "seg_key").agg(F.min(F.struct("path", "line_no")).alias("place"), F.min_by("file_stem", F.struct("path", "line_no")).alias("file_stem"))
    return first.select("uid", "file_stem", F.row_number().over(Window.partitionBy("uid").orderBy("place", "seg_key")).cast("long").alias("nth"), "seg_key")


def status(found: DataFrame, scope: str | None = None) -> DataFrame:
    """One row: status (ok, ambiguous, not_found, not_in_scope), uid, candidates (sorted)."""
    uids = found.agg(F.array_sort(F.collect_set("uid")).alias("uids"))
    if scope:
        code = scope.strip().lower().replace(" ", "").replace("-", "").replace("_", "")
        there = F.array_contains("uids", F.lit(code))
        return uids.select(F.when(there, "ok").otherwise("not_in_scope").alias("status"), F.lit(code).alias("uid"), F.when(there, F.array(F.lit(code))).otherwise(F.col("uids")).alias("candidates"))
    n = F.size("uids")
    return uids.select(F.when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("ok").alias("status"), F.when(n == 1, F.col("uids")[0]).otherwise("").alias("uid"), F.col("uids").alias("candidates"))


def message(result: DataFrame, phrase: str) -> DataFrame:
    """result with a message: of ambiguous candidates the first 15 are named."""
    shown = F.array_join(F.slice("candidates", 1, CANDIDATES), ", ")
    more = F.size("candidates") - CANDIDATES
    rest = F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" others"))).otherwise("")
    many = F.concat(F.lit(f"'{phrase}' stands in several texts ("), F.size("candidates").cast("string"), F.lit("), choose one: "), shown, rest)
    elsewhere = F.when(F.size("candidates") > 0, F.concat(F.lit("; texts that have it: "), shown, rest)).otherwise("; no text has it")
    other = F.concat(F.col("uid"), F.lit(f" has no '{phrase}'"), elsewhere)
    said = F.when(F.col("status") == "ambiguous", many).when(F.col("status") == "not_found", F.lit(f"no root text has '{phrase}'")).when(F.col("status") == "not_in_scope", other)
    return result.withColumn("message", F.coalesce(said, F.lit("")))


def joined_text(key: Column, text: Column) -> Column:
    """Aggregate: texts in key order, blank ones left out, with an ellipsis between."""
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.trim(text).alias("t")))), lambda x: x["t"]), lambda t: t != "")
    return F.array_join(parts, " … ")


def renderings(segments: DataFrame, found: DataFrame, uid: str, most: int = SEGMENTS) -> DataFrame:
    """label and text: the root's first `most` segments with the phrase, and each translator's of the same keys."""
    keys = found.where((F.col("uid") == uid) & (F.col("nth") <= most)).select("file_stem", "seg_key", "nth")
    rows = segments.join(keys, ["file_stem", "seg_key"])
    label = F.when(F.col("kind") == "root", "**Pāḷi**").otherwise(F.concat(F.initcap("author"), F.lit(" (Bilara)")))
    return rows.groupBy(label.alias("label")).agg(joined_text(F.col("nth"), F.col("text")).alias("text"))


def prose_files(files: DataFrame, uid: str) -> DataFrame:
    """translator and path of prose files named ``uid.md`` or ``uid-*.md``; the translator is the top folder; sorted without
    regard to case.  files: rel_path."""
    name = F.substring_index("rel_path", "/", -1)
    named = (name == f"{uid}.md") | (name.startswith(f"{uid}-") & name.endswith(".md"))
    return files.where(named).select(F.trim(F.substring_index("rel_path", "/", 1)).alias("translator"), F.col("rel_path").alias("path")).orderBy(F.lower("translator"), "path")
