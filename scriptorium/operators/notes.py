"""Checks of finished notes: front matter, sections, footnotes, evidence, coverage, and their printed copies.

Notes are lines: note, line_no (from 1), text.  Each rule is a query of its own over rows marked once.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sections that a note has to have, the ones whose lack is a warning, and how evidence sections look.
SECTIONS = ("## Question", "## Findings", "## Canon Evidence (T1)", "## Sources Investigated, Not Used", "## Critical Gaps", "## Bibliography")
SOFT = "## Canon Evidence (T1)"
FIRST_TIER, EVIDENCE = r"^##\s+.*\(T1\)\s*$", r"^##\s+.*\(T[12]\)\s*$"
SERIES = r"(?i)^##\s+.*\bwhat the (ebts|suttas)\b.*\bsay\b"


def _by_line() -> object:
    return Window.partitionBy("note").orderBy("line_no")


def marked(lines: DataFrame) -> DataFrame:
    """lines with in_front (inside the front matter), key and value, list_key, section, and final (the last --- line)."""
    order = _by_line()
    bare = F.trim("text")
    fence = (bare == "---").cast("int")
    m = lines.withColumn("bare", bare).withColumn("opens", F.first("bare").over(order) == "---")
    m = m.withColumn("fences", F.sum(fence).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    closed = F.max("fences").over(Window.partitionBy("note"))
    m = m.withColumn("closed", closed)
    fronted = F.col("opens") & (F.col("closed") >= 2)
    m = m.withColumn("has_front", fronted).withColumn("in_front", fronted & (F.col("fences") == 1) & (F.col("bare") != "---"))
    m = m.withColumn("in_body", F.when(fronted, (F.col("fences") >= 2) & ~((F.col("fences") == 2) & (F.col("bare") == "---"))).otherwise(True))
    key = F.when(F.col("in_front"), F.regexp_extract("text", r"^([A-Za-z_][A-Za-z0-9_]*):(.*)$", 1))
    value = F.when(F.col("in_front"), F.trim(F.regexp_extract("text", r"^([A-Za-z_][A-Za-z0-9_]*):(.*)$", 2)))
    m = m.withColumn("key", F.nullif(key, F.lit(""))).withColumn("value", value)
    item = F.col("in_front") & F.col("bare").startswith("- ")
    # A list goes on over items and blank lines; any other line ends it.
    opener = F.when(F.col("in_front") & (F.col("bare") != "") & ~item, F.when(F.col("key").isNotNull() & (F.col("value") == ""), F.col("key")).otherwise(""))
    m = m.withColumn("list_key", F.when(item, F.nullif(F.last(opener, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(""))))
    m = m.withColumn("item", F.when(item, F.trim(F.substring("bare", 3, 1 << 20))))
    m = m.withColumn("heading", F.when(F.col("in_body") & F.col("bare").startswith("## "), F.col("bare")))
    m = m.withColumn("section", F.last("heading", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return m.withColumn("final", F.max(F.when(F.col("in_body") & (F.col("bare") == "---"), F.col("line_no"))).over(Window.partitionBy("note")))


def _unquoted(v: Column) -> Column:
    return F.regexp_replace(v, r"""^(['"])(.*)\1$""", "$2")


def _quoted(v: Column) -> Column:
    return v.rlike(r"""^(['"]).*\1$""")


def issues(lines: DataFrame, tool_url: str) -> DataFrame:
    """note, code, line, severity of each fault, twelve kinds; tool_url is what the field ``tool`` has to say."""
    m = marked(lines)
    start = F.min(F.when(F.col("in_body"), F.col("line_no"))).alias("body_line")
    scalar = {k: F.max_by(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("value")), F.when((F.col("key") == k) & (F.col("value") != ""), F.col("line_no"))).alias(k) for k in ("tool", "agent", "topic")}
    at = {k: F.max(F.when((F.col("key") == k) & (F.col("value") != ""), F.col("line_no"))).alias(f"{k}_line") for k in ("tool", "topic")}
    there = [F.coalesce(F.max(F.when(F.col("in_body") & (F.col("bare") == s), True)), F.lit(False)).alias(f"has_{k}") for k, s in enumerate(SECTIONS)]
    t1 = F.min_by(F.when(F.col("heading").rlike(FIRST_TIER), F.col("heading")), F.when(F.col("heading").rlike(FIRST_TIER), F.col("line_no"))).alias("t1")
    whole = m.groupBy("note").agg(F.max("has_front").alias("has_front"), start, *scalar.values(), *at.values(), *there, t1, F.coalesce(F.max(F.col("heading").rlike(SERIES)), F.lit(False)).alias("series"), F.count_if(F.col("list_key") == "canon_refs").alias("canon_refs"))

    def fault(rows: DataFrame, code: str, line: Column, severity: Column | str = "error") -> DataFrame:
        return rows.select("note", F.lit(code).alias("code"), line.cast("long").alias("line"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))

    one = F.lit(1)
    front = whole.where("has_front")
    plain = lambda c: F.trim(c).isNotNull() & ~F.trim(c).rlike(r"^(?:\{|\[|- )")
    ok_topic = plain(F.col("topic")) & (_quoted(F.trim("topic")) | ~F.contains("topic", F.lit(": ")))
    body = F.coalesce("body_line", F.lit(1))
    found = [
        fault(whole.where("not has_front"), "missing-frontmatter", one),
        fault(front.where(~(_unquoted(F.trim(F.coalesce("tool", F.lit("")))) == tool_url)), "invalid-tool", F.coalesce("tool_line", one)),
        fault(front.where(~F.coalesce(plain(F.col("agent")), F.lit(False))), "missing-agent", one),
        fault(front.where("topic is null"), "missing-topic", one),
        fault(front.where(F.col("topic").isNotNull() & ~ok_topic), "invalid-topic", F.col("topic_line")),
        fault(m.where(F.col("list_key") == "web_refs").where(~_unquoted(F.col("item")).rlike(r"^https?://\S*$")), "invalid-web-ref", F.col("line_no")),
        fault(m.where(F.col("list_key") == "library_refs").where(~_quoted(F.col("item")) & F.col("item").rlike(r"^[^:]+:\s+")), "invalid-library-ref", F.col("line_no")),
        fault(m.where(F.col("in_body") & F.contains("text", F.lit("[REJECTED]"))), "rejected-citation", F.col("line_no")),
        fault(m.where(F.col("in_body") & F.col("text").rlike(r"^\[\^[^\]]+\]:") & (F.col("final").isNull() | (F.col("line_no") < F.col("final")))), "invalid-footnote-placement", F.col("line_no")),
    ]
    for k, s in enumerate(SECTIONS):
        lacking = whole.where(~F.col(f"has_{k}"))
        if s == SOFT:
            lacking = lacking.where(F.col("t1").isNull() & ~F.col("series"))
        found.append(fault(lacking, "missing-section", body, "warning" if s == SOFT else "error"))
    cited = m.where(F.col("in_body") & F.col("heading").isNull() & (F.col("bare") != "") & ~F.col("bare").startswith("- None")).select("note", "section").distinct()
    lacking = whole.where("canon_refs = 0").join(cited.withColumnRenamed("note", "n2"), (F.col("note") == F.col("n2")) & (F.col("section") == F.coalesce("t1", F.lit(SOFT))), "left_semi")
    found.append(fault(lacking, "missing-canon-ref", one))
    counts = evidence_counts(m)
    found.append(fault(counts.where("footnotes >= 3 and quotes < footnotes").join(whole.select("note", "body_line"), "note"), "under-quoted-evidence", body))
    return functools.reduce(DataFrame.unionByName, found)


def evidence_counts(m: DataFrame) -> DataFrame:
    """note, footnotes (different ones referred to) and quotes (quoted lines) in first and second tier sections."""
    rows = m.where(F.col("section").rlike(EVIDENCE) & F.col("heading").isNull() & F.col("in_body"))
    refs = rows.select("note", F.explode(F.regexp_extract_all("text", F.lit(r"\[\^([^\]]+)\](?!:)"), F.lit(1))).alias("ref")).groupBy("note").agg(F.count_distinct("ref").alias("footnotes"))
    quotes = rows.groupBy("note").agg(F.count_if(F.ltrim("text").startswith(">")).alias("quotes"))
    return quotes.join(refs, "note", "left").select("note", F.coalesce("footnotes", F.lit(0)).cast("long").alias("footnotes"), "quotes")


def unmentioned(hits: DataFrame, note_text: DataFrame) -> DataFrame:
    """hits (note, document_id, ...) whose number no ``calibre-<id>`` or ``Calibre #<id>`` in the note (note, text) mentions."""
    mentioned = note_text.select(F.col("note").alias("__note"), F.explode(F.regexp_extract_all("text", F.lit(r"(?i)calibre[\s#-]*(\d+)(?![\p{L}\p{N}_])"), F.lit(1))).alias("__id"))
    mentioned = mentioned.select("__note", F.col("__id").try_cast("bigint").alias("__id"))
    return hits.join(mentioned, (F.col("note") == F.col("__note")) & (F.col("document_id") == F.col("__id")), "left_anti")


def logged_hits(log: DataFrame, text: str = "text") -> DataFrame:
    """document_id, title, relative_path, snippet of the hits in a log's JSON; the last of a number counts.

    Objects with braces inside are not seen.  log: run, at (order), text.
    """
    schema = "document_id bigint, title string, relative_path string, snippet string"
    found = log.select("run", F.posexplode(F.regexp_extract_all(text, F.lit(r'\{[^{}]*"document_id"\s*:\s*\d+[^{}]*\}'), F.lit(0))).alias("k", "json"), "at").withColumn("hit", F.from_json("json", schema)).where("hit.document_id is not null")
    last = found.groupBy("run", F.col("hit.document_id").alias("document_id")).agg(F.max_by("hit", F.struct("at", "k")).alias("hit"))
    return last.select("run", "document_id", "hit.title", "hit.relative_path", F.substring("hit.snippet", 1, 200).alias("snippet"))


def printed_path(note: Column) -> Column:
    """Where a note's printed copy belongs."""
    return F.regexp_replace(note, r"\.md$", ".pdf")


def tree_audit(notes: DataFrame, printed: DataFrame) -> DataFrame:
    """kind ('missing' or 'orphan') and path, of notes (path) without a copy and of copies (path) without a note.  A file that
    is no copy is an orphan too."""
    due = notes.where(F.col("path").endswith(".md")).select(printed_path(F.col("path")).alias("path"))
    missing = due.join(printed, "path", "left_anti").select(F.lit("missing").alias("kind"), "path")
    return missing.unionByName(printed.join(due, "path", "left_anti").select(F.lit("orphan").alias("kind"), "path"))
