"""The evidence log of a run: entries by phase, gates between phases, and what is missing.

log: run, seq (order), phase, kind ('header', 'entry', 'note', 'gate', 'skip', 'audit'), tool, args, hits, payload.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import committed, latest

# The phases in order, those left out of thematic runs, those that need evidence, and what counts as none.
PHASES = ("0", "1", "2", "2.5", "3", "3b", "4", "4b", "4c", "5", "6", "7")
SKIPPED = ("2.5", "3b")
CONTENT = ("1", "2", "2.5", "3", "3b", "4", "4b", "4c", "6")
PLACEHOLDERS = ("would be searched", "would search", "would query", "would fetch", "would look up", "to be searched", "<fill in>")
ALIASES = {"4a": "4"}
AUDIT_ANSWERS = 6
HEADER_FIELDS = ("question_polished", "scope_assumptions", "ambiguity_status")
# Commands of the log itself, which leave no entry of their own.
UNLOGGED = ("log", "gate", "set-note", "self-audit", "verify", "resume", "which")


def phase_name(phase: Column) -> Column:
    plain = F.lower(F.trim(phase))
    return F.when(plain == "4a", "4").otherwise(F.trim(phase))


def phases(spark: SparkSession) -> DataFrame:
    """(ord, phase)."""
    return spark.createDataFrame(list(enumerate(PHASES)), "ord int, phase string")


def is_placeholder(body: Column) -> Column:
    """Whether a text promises a search in place of one."""
    low = F.lower(body)
    out = F.lit(False)
    for p in PLACEHOLDERS:
        out = out | (low.rlike(rf"(?U)\Q{p}\E\b") if p[-1].isalnum() else F.contains(low, F.lit(p)))
    return out


def content_issues(log: DataFrame) -> DataFrame:
    """run, phase, issue ('placeholder' or 'empty') for each gated content phase without real evidence."""
    whole = log.groupBy("run", "phase").agg(
        F.max((F.col("kind") == "skip").cast("int")).alias("skip"),
        F.max((F.col("kind") == "gate").cast("int")).alias("gate"),
        F.max(F.when(F.col("kind").isin("entry", "note"), is_placeholder(F.coalesce("payload", F.lit(""))).cast("int"))).alias("promise"),
        F.count_if(F.col("kind").isin("entry", "note")).alias("evidence"),
    )
    gated = whole.where(F.col("phase").isin(*CONTENT) & (F.col("gate") == 1) & (F.col("skip") == 0))
    issue = F.when(F.col("promise") == 1, "placeholder").when(F.col("evidence") == 0, "empty")
    return gated.select("run", "phase", issue.alias("issue")).where("issue is not null")


def gates(log: DataFrame) -> DataFrame:
    """run and phase of each gate, those of skipped phases too."""
    return log.where(F.col("kind").isin("gate", "skip")).select("run", "phase").distinct()


def gate_checks(requests: DataFrame, log: DataFrame, runs: DataFrame) -> DataFrame:
    """run, phase, ok, missing_phase, reason for requests (run, phase) to close a phase.

    Refused: an earlier phase has no gate (of a thematic run the skipped phases don't count); a content phase has no entry;
    the last phase lacks the six audit answers, or the note still holds a rejected tag.  runs: run, run_class, note_text.
    """
    dim = phases(log.sparkSession)
    asked = requests.select("run", phase_name(F.col("phase")).alias("phase")).join(runs, "run").join(F.broadcast(dim), "phase")
    earlier = asked.select("run", "phase", "run_class", F.col("ord").alias("upto")).join(F.broadcast(dim.select(F.col("phase").alias("before"), "ord")), F.col("ord") < F.col("upto")).where(~((F.col("run_class") == "thematic") & F.col("before").isin(*SKIPPED)))
    lacking = earlier.join(gates(log).select("run", F.col("phase").alias("before")), ["run", "before"], "left_anti").groupBy("run", "phase").agg(F.min_by("before", "ord").alias("missing_phase"))
    evidence = log.groupBy("run", "phase").agg(F.count_if(F.col("kind") == "entry").alias("entries"), F.count_if(F.col("kind") == "gate").alias("gate"))
    audit = log.where("kind = 'audit'").groupBy("run").agg(F.count("*").alias("answers"))
    all_ = asked.join(lacking, ["run", "phase"], "left").join(evidence, ["run", "phase"], "left").join(audit, "run", "left")
    reason = (
        F.when(F.col("missing_phase").isNotNull(), "earlier gate missing")
        .when(F.coalesce("gate", F.lit(0)) > 0, F.lit(None).cast("string"))
        .when((F.col("phase") == "7") & (F.coalesce("answers", F.lit(0)) < AUDIT_ANSWERS), "self-audit missing")
        .when((F.col("phase") == "7") & F.contains(F.coalesce("note_text", F.lit("")), F.lit("[REJECTED")), "rejected tags in the note")
        .when(F.col("phase").isin(*CONTENT) & (F.coalesce("entries", F.lit(0)) == 0), "no evidence")
    )
    return all_.select("run", "phase", reason.isNull().alias("ok"), "missing_phase", reason.alias("reason"))


def missing_gates(log: DataFrame, runs: DataFrame) -> DataFrame:
    """run and phase without a gate."""
    need = runs.select("run").join(F.broadcast(phases(log.sparkSession)))
    return need.join(gates(log), ["run", "phase"], "left_anti").select("run", "phase")


def resumed(log: DataFrame, runs: DataFrame) -> DataFrame:
    """run, last_gate (null for none) and next_phase (null at the end): where to go on; thematic runs skip two phases."""
    dim = phases(log.sparkSession)
    last = gates(log).join(F.broadcast(dim), "phase").groupBy("run").agg(F.max("ord").alias("last_ord"), F.max_by("phase", "ord").alias("last_gate"))
    at = runs.select("run", "run_class").join(last, "run", "left")
    after = at.join(F.broadcast(dim), F.col("ord") > F.coalesce("last_ord", F.lit(-1)), "left").where(F.col("phase").isNull() | F.col("last_ord").isNull() | ~((F.col("run_class") == "thematic") & F.col("phase").isin(*SKIPPED)))
    nxt = after.groupBy("run").agg(F.min_by("phase", "ord").alias("next_phase"))
    return at.join(nxt, "run", "left").select("run", "last_gate", "next_phase")


def started(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing and the rows of new whose run isn't there yet; with all header fields their first phase is closed."""
    fresh = new.join(existing.select("run").distinct(), "run", "left_anti")
    closed = fresh.where("kind = 'header'").groupBy("run").agg(F.count_distinct("tool").alias("n"), F.max("seq").alias("seq")).where(F.col("n") >= len(HEADER_FIELDS))
    gate = closed.select("run", (F.col("seq") + 1).alias("seq"), F.lit("0").alias("phase"), F.lit("gate").alias("kind"))
    return existing.unionByName(fresh, allowMissingColumns=True).unionByName(gate, allowMissingColumns=True)


def numbered(log: DataFrame, entries: DataFrame) -> DataFrame:
    """entries as they stand behind log: each run's are numbered on from its last, in the order of their own seq."""
    last = log.groupBy("run").agg(F.max("seq").alias("__last"))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("seq"))
    return entries.join(last, "run", "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + nth).cast("long")).drop("__last").withColumn("phase", phase_name(F.col("phase")))


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """log and entries behind it, ``numbered``."""
    return log.unionByName(numbered(log, entries), allowMissingColumns=True)


LOG = "run string, seq long, phase string, kind string, tool string, args string, hits long, payload string, pinned boolean"
#: Files that a stored log has before they are made one.
MOST_FILES = 32


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of a log that ``store`` keeps; without rows if there is none."""
    return _of_files(spark, json.loads(latest(spark, f"{root}/versions")[1] or "[]"))


def _of_files(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.schema(LOG).parquet(*files) if files else spark.createDataFrame([], LOG)


def store(spark: SparkSession, root: str, entries: DataFrame | Callable[[DataFrame], DataFrame]) -> int:
    """Puts entries behind a stored log, as a version of its own; the number of that version.

    entries: rows, or a function of the log that gives them.  Each append is a file; a version names the files of the log.
    An append that another one has overtaken is numbered once more behind it, so no entry is lost and no number given twice.
    """

    def change(_: int, text: str | None) -> str:
        files = json.loads(text or "[]")
        log = _of_files(spark, files)
        rows = entries(log) if callable(entries) else entries
        columns = [F.col(c.split()[0]) if c.split()[0] in rows.columns else F.lit(None).alias(c.split()[0]) for c in LOG.split(", ")]
        rows = spark.createDataFrame([], LOG).unionByName(numbered(log, rows.select(*columns)))
        if len(files) >= MOST_FILES:
            rows, files = log.unionByName(rows).coalesce(1), []
        path = f"{root}/entries/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return json.dumps([*files, path])

    return committed(spark, f"{root}/versions", change)


def audits(log: DataFrame, answers: DataFrame) -> DataFrame:
    """run, ok, recorded, reason for the self-audits that answers (run, at, answer) give.

    An audit counts with one answer to each question, none of them blank; a run that has an audit gets no second one, which
    is no fault.
    """
    given = answers.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("answer", F.lit(""))) == "").alias("blank"))
    there = log.where("kind = 'audit'").select("run", F.lit(True).alias("there")).distinct()
    reason = F.when(F.col("there"), "audited before").when((F.col("n") != AUDIT_ANSWERS) | (F.col("blank") > 0), "answers missing or too many")
    judged = given.join(there, "run", "left").select("run", reason.alias("reason"))
    return judged.select("run", F.coalesce(F.col("reason") == "audited before", F.lit(True)).alias("ok"), F.col("reason").isNull().alias("recorded"), "reason")


def audited(log: DataFrame, answers: DataFrame) -> DataFrame:
    """log with the answers behind it that ``audits`` records, trimmed, under the last phase."""
    taken = answers.join(audits(log, answers).where("recorded").select("run"), "run", "left_semi")
    return appended(log, taken.select("run", F.col("at").alias("seq"), F.lit(PHASES[-1]).alias("phase"), F.lit("audit").alias("kind"), F.trim("answer").alias("payload")))


def with_notes(runs: DataFrame, requests: DataFrame, saved: DataFrame) -> DataFrame:
    """runs (run, note_path, pdf, ...) with the paths of requests (run, note_path, pdf; one a run) whose note is among saved (path).

    A request for a note that isn't there changes nothing; one without pdf leaves that of before.
    """
    there = requests.join(saved.select(F.col("path").alias("note_path")).distinct(), "note_path", "left_semi")
    asked = there.select("run", F.col("note_path").alias("__note"), F.col("pdf").alias("__pdf"))
    out = runs.join(asked, "run", "left").withColumn("note_path", F.coalesce("__note", "note_path")).withColumn("pdf", F.coalesce("__pdf", "pdf"))
    return out.select(*runs.columns)


def named(slugs: DataFrame, runs: DataFrame) -> DataFrame:
    """slug, run of slugs: the run of that very name, else the latest one that has a date before it, else null."""
    plain = runs.select("run", F.col("run").alias("slug"), F.lit(1).alias("exact"))
    dated = runs.where(F.col("run").rlike(r"^\d{4}-\d{2}-\d{2}-")).select("run", F.expr("substring(run, 12)").alias("slug"), F.lit(0).alias("exact"))
    best = plain.union(dated).groupBy("slug").agg(F.max_by("run", F.struct("exact", "run")).alias("run"))
    return slugs.select("slug").distinct().join(best, "slug", "left").select("slug", "run")


def logged_calls(log: DataFrame, calls: DataFrame, at: DataFrame, unlogged: tuple[str, ...] = UNLOGGED) -> DataFrame:
    """log with an entry behind it for each of calls (run, seq, command, args, result as JSON, phase or null) that is to be logged.

    Calls of the log's own commands and of runs without a log are passed over.  A call without a phase gets that of its run
    in at (run, phase; one a run) or '?', and its pinned is false.  hits: how many elements a result has that is a list.
    """
    kept = calls.where(~F.col("command").isin(*unlogged)).join(log.select("run").distinct(), "run", "left_semi")
    placed = kept.join(at.select("run", F.col("phase").alias("__at")), "run", "left")
    entries = placed.select("run", "seq", F.coalesce("phase", "__at", F.lit("?")).alias("phase"), F.lit("entry").alias("kind"), F.col("command").alias("tool"), "args", F.json_array_length("result").cast("long").alias("hits"), F.col("result").alias("payload"), F.col("phase").isNotNull().alias("pinned"))
    return appended(log, entries)


def reports_of(files: DataFrame, day: str) -> DataFrame:
    """Run reports (path) whose name begins with a day."""
    return files.where(F.substring_index("path", "/", -1).startswith(day))
