"""Command line: each command prints JSON; exit 0, or 1 for nothing found or refused, 2 for what cannot be checked.

    python -m scriptorium.cli refresh --roots "/a|/b" --table /t/docs
    python -m scriptorium.cli search --table /t/docs --query '"two words" OR pre*' --limit 5
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import align, citations, dedupe, library, notes, parallels, passages, runlog, search
from .sources import files
from .storage import latest, written


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


#: What the command that runs now has printed, for its entry in a log.
_said: list[list] = []


def _print(df: DataFrame, most: int | None = None) -> list:
    """Prints rows as a JSON list; `most` clips long texts."""
    if most is not None:
        df = df.select(*[T.clipped_values(F.col(f"`{f.name}`"), f.dataType, most).alias(f.name) for f in df.schema])
    rows = [json.loads(x) for x in df.toJSON().collect()]
    print(json.dumps(rows, ensure_ascii=False, indent=1))
    _said.append(rows)
    return rows


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """note, line_no, text of the files below a path."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("note"), F.col("value"))
    return whole.select("note", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("at", "text")).select("note", (F.col("at") + 1).cast("long").alias("line_no"), "text")


def _refresh(spark, a) -> int:
    """New and changed files make a segment of the library; a refresh that another one has overtaken is made once more."""
    where = files.Roots.from_text(a.roots, a.exclude)
    live = [r for r in where.roots if files.exists_within(r)]
    prefixes = spark.read.parquet(a.prefixes) if a.prefixes else None
    while True:
        held = library.opened(spark, a.table)
        # A table of another schema version is read anew; no other error of reading it is passed over.
        same = held.about.get("schema_version") == files.SCHEMA_VERSION
        old = held.documents().select(*files.empty_documents(spark).columns) if same and held.segments else files.empty_documents(spark)
        fresh, gone, counts = files.refresh_of(spark, old, where, a.retry_failed, a.limit, prefixes, live)
        clusters = f"{a.table}/clusters/{uuid.uuid4().hex}"
        keys = ["doc_id", "path", "content_hash", "text_hash"]
        stay = old.select(*keys).join(fresh.select("doc_id").union(gone), "doc_id", "left_anti")
        dedupe.clusters(written(stay.unionByName(fresh.select(*keys)), "keys"), ["content_hash", "text_hash"], "path").write.parquet(clusters)
        try:
            stale = gone if same or not held.segments else held.documents().select("doc_id")
            library.changed(spark, a.table, fresh, stale, {"schema_version": files.SCHEMA_VERSION, "clusters": clusters}, held.version)
        except library.Overtaken:
            continue
        _print(counts)
        return 0


def _library(spark, table: str) -> library.Library:
    held = library.opened(spark, table)
    if not held.version:
        raise SystemExit(f"there is no table at {table}")
    return held


def _search(spark, a) -> int:
    held = _library(spark, a.table)
    members = spark.read.parquet(held.about["clusters"])

    def run() -> list:
        hits = search.assembled(held, held.documents().withColumn("source_path", F.col("path")), members, a.query, a.limit, a.include_duplicates, files.availability)
        return _print(hits.orderBy("score", "document_id"), a.clip)

    try:
        return 0 if search.with_deadline(spark, a.timeout, run) else 1
    except TimeoutError as e:
        print(json.dumps({"error": "timeout", "message": str(e)}))
        return 1


def _health(spark, a) -> int:
    """Roots and whether they are there, and what the table holds."""
    where = files.Roots.from_text(a.roots)
    docs = _library(spark, a.table).documents()
    held = docs.agg(F.count("*").alias("documents"), F.count_if(F.trim("text") != "").alias("with_text")).first()
    print(json.dumps({"roots": {r: files.exists_within(r) for r in where.roots}, **held.asDict()}))
    return 0


def _duplicates(spark, a) -> int:
    docs = _library(spark, a.table).documents()
    docs = docs.withColumn("source_path", F.col("path"))
    _print(dedupe.report(docs))
    _print(dedupe.samples(docs, a.samples))
    _print(dedupe.candidates_without_text(docs))
    return 0


def _canon(spark, a) -> int:
    segments = spark.read.parquet(a.segments)
    chosen = passages.chosen_books(segments, a.books or None)
    found = passages.find_phrase(segments.join(chosen, "book_code"), a.phrase, {"pali": ("pali_text",), "english": ("english_translation",), "any": ("pali_text", "english_translation")}[a.lang], a.limit, ("book_ord", "id"))
    return 0 if _print(found.select("book_code", F.col("owner").alias("paranum"), F.trim("pali_text").alias("pali"), F.trim("english_translation").alias("english")), a.clip) else 1


def _label(spark, a) -> int:
    asked = spark.createDataFrame([(a.book, a.paranum)], "book_code string, paranum string")
    rows = _print(citations.labels(asked, spark.read.parquet(a.segments), spark.read.parquet(a.dictionary)))
    return 1 if rows[0].get("paranum_exists") is False or "human" not in rows[0] else 0


def _verify(spark, a) -> int:
    rows = _print(citations.verified(spark.createDataFrame([(r,) for r in a.refs], "ref string"), spark.read.parquet(a.dictionary)))
    verdicts = {r["verdict"] for r in rows}
    return 1 if "rejected" in verdicts else 2 if "unverifiable-form" in verdicts else 0


def _annotate(spark, a) -> int:
    lines = _lines(spark, a.path).select(F.concat_ws(":", "note", F.col("line_no").cast("string")).alias("note"), "text")
    return 0 if _print(citations.annotated(lines, spark.read.parquet(a.dictionary))) else 1


def _shape(spark, a) -> int:
    return 1 if _print(citations.misshapen(_lines(spark, a.path))) else 0


def _note(spark, a) -> int:
    return 1 if any(r["severity"] == "error" for r in _print(notes.issues(_lines(spark, a.path), a.tool_url))) else 0


def _grep(spark, a) -> int:
    path = f"{a.path.rstrip('/')}/{a.folder}" if a.folder else a.path
    if a.folder and files.exists_within(path) is False:
        _print(spark.createDataFrame([], "path string"))
        return 1
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{a.suffix}").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return 0 if _print(passages.lines_with(whole, a.needle, limit=a.limit)) else 1


def _parallels(spark, a) -> int:
    groups = spark.read.option("multiLine", True).schema("parallels array<string>").json(a.groups).withColumn("group_id", F.monotonically_increasing_id())
    return 0 if _print(parallels.parallels(groups, spark.createDataFrame([(a.uid,)], "asked string"))) else 1


def _align(spark, a) -> int:
    rows = files.segment_files(spark, a.segments).withColumn("line_no", F.col("ord") + 2)
    found = align.located(rows, a.phrase)
    result = align.message(align.status(found, a.scope), a.phrase)
    state = _print(result)[0]
    if state["status"] != "ok":
        return 1
    _print(align.renderings(rows, found, state["uid"]))
    return 0


def _log_of(spark, path: str) -> DataFrame:
    return runlog.stored(spark, path) if latest(spark, f"{path}/versions")[0] else spark.read.parquet(path)


def _entry(spark, run: str, phase: str, kind: str, tool: str | None = None, payload: str | None = None, args: str | None = None, hits: int | None = None, pinned: bool = True) -> DataFrame:
    return spark.createDataFrame([(run, 1, phase, kind, tool, args, hits, payload, pinned)], runlog.LOG)


def _log_start(spark, a) -> int:
    """Header fields of a new run; with all of them its first phase is closed.  A run that is there is left as it is."""
    head = spark.createDataFrame([(a.run_name, k + 1, "0", "header", f, None, None, v, True) for k, (f, v) in enumerate(x.split("=", 1) for x in a.fields)], runlog.LOG)
    runlog.store(spark, a.log, lambda log: runlog.started(log, head).join(log.select("run").distinct(), "run", "left_anti"))
    return 0


def _log_add(spark, a) -> int:
    runlog.store(spark, a.log, _entry(spark, a.run_name, a.phase, a.kind, a.tool, a.payload))
    return 0


def _log_gate(spark, a) -> int:
    """Closes a phase, if what comes before it is there; of a thematic run the phases that it skips are marked so."""
    log = _log_of(spark, a.log)
    runs = spark.createDataFrame([(a.run_name, a.run_class, a.note)], "run string, run_class string, note_text string")
    (row,) = _print(runlog.gate_checks(spark.createDataFrame([(a.run_name, a.phase)], "run string, phase string"), log, runs))
    if not row["ok"]:
        return 1
    phase = row["phase"]

    def entries(now: DataFrame) -> DataFrame:
        closed = {r.phase for r in runlog.gates(now).where(F.col("run") == a.run_name).collect()}
        at = runlog.PHASES.index(phase)
        marks = [(p, "skip") for p in runlog.SKIPPED if a.run_class == "thematic" and runlog.PHASES.index(p) < at and p not in closed] + [(phase, "gate")] * (phase not in closed)
        return spark.createDataFrame([(a.run_name, k, p, kind, None, None, None, None, True) for k, (p, kind) in enumerate(marks)], runlog.LOG)

    runlog.store(spark, a.log, entries)
    return 0


def _log_verify(spark, a) -> int:
    log = _log_of(spark, a.log).where(F.col("run") == a.run_name)
    missing = _print(runlog.missing_gates(log, spark.createDataFrame([(a.run_name,)], "run string")))
    return 1 if _print(runlog.content_issues(log)) or missing else 0


def _log_audit(spark, a) -> int:
    answers = spark.createDataFrame([(a.run_name, k, x) for k, x in enumerate(a.answers)], "run string, at long, answer string")
    log = _log_of(spark, a.log)
    (row,) = _print(runlog.audits(log, answers))
    if row["recorded"]:
        runlog.store(spark, a.log, lambda now: runlog.audited(now, answers).join(now.select("run", "seq"), ["run", "seq"], "left_anti"))
    return 0 if row["ok"] else 1


def _log_which(spark, a) -> int:
    (row,) = _print(runlog.named(spark.createDataFrame([(a.slug,)], "slug string"), _log_of(spark, a.log).select("run").distinct()))
    return 0 if row.get("run") else 1


def _resume(spark, a) -> int:
    log = _log_of(spark, a.log)
    runs = log.select("run").distinct().withColumn("run_class", F.lit(a.run_class))
    _print(runlog.resumed(log, runs))
    return 1 if _print(runlog.content_issues(log)) else 0


def _logged(spark, a, argv: list[str]) -> None:
    """An entry for a command that names a log and a run: its phase, or the one that the run has come to."""
    log = _log_of(spark, a.into_log)
    rows = [r for part in _said for r in part]
    at = a.into_phase or (log.where((F.col("run") == a.into_run) & (F.col("kind") != "header")).orderBy(F.desc("seq")).select("phase").first() or ["?"])[0]
    runlog.store(spark, a.into_log, _entry(spark, a.into_run, at, "entry", a.command, json.dumps(rows, ensure_ascii=False)[:20_000], " ".join(argv), len(rows), bool(a.into_phase)))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    p.add_argument("--into-log", help="log that gets an entry of this call")
    p.add_argument("--into-run")
    p.add_argument("--into-phase")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for flag, kind in options:
            s.add_argument(flag, **kind)

    need, number = {"required": True}, lambda n: {"type": int, "default": n}
    clip = ("--clip", {"type": int, "default": None})
    add("refresh", _refresh, ("--roots", need), ("--exclude", {"default": ""}), ("--table", need), ("--limit", number(None)), ("--retry-failed", {"action": "store_true"}), ("--prefixes", {"default": ""}))
    add("search", _search, ("--table", need), ("--query", need), ("--limit", number(20)), ("--include-duplicates", {"action": "store_true"}), ("--timeout", {"type": float, "default": 20.0}), clip)
    add("health", _health, ("--roots", need), ("--table", need))
    add("duplicates", _duplicates, ("--table", need), ("--samples", number(5)))
    add("search-canon", _canon, ("--segments", need), ("--phrase", need), ("--books", {"nargs": "*"}), ("--lang", {"choices": ["pali", "english", "any"], "default": "any"}), ("--limit", number(50)), clip)
    add("resolve-citation", _label, ("--segments", need), ("--dictionary", need), ("--book", need), ("--paranum", need))
    add("verify-citation", _verify, ("--dictionary", need), ("refs", {"nargs": "+"}))
    add("annotate-citations", _annotate, ("--dictionary", need), ("path", {}))
    add("check-shape", _shape, ("path", {}))
    add("validate-note", _note, ("path", {}), ("--tool-url", need))
    add("grep", _grep, ("needle", {}), ("path", {}), ("--folder", {"default": ""}), ("--suffix", {"default": ".md"}), ("--limit", number(50)))
    add("parallels", _parallels, ("--groups", need), ("uid", {}))
    add("align", _align, ("--segments", need), ("--phrase", need), ("--in", {"dest": "scope", "default": None}))
    run = ("--run-name", need)
    add("log-start", _log_start, ("--log", need), run, ("fields", {"nargs": "+"}))
    add("log", _log_add, ("--log", need), run, ("--phase", need), ("--tool", {"default": None}), ("--kind", {"choices": ["entry", "note"], "default": "entry"}), ("payload", {}))
    add("gate", _log_gate, ("--log", need), run, ("--run-class", {"default": "sutta"}), ("--note", {"default": ""}), ("phase", {}))
    add("verify", _log_verify, ("--log", need), run)
    add("self-audit", _log_audit, ("--log", need), run, ("answers", {"nargs": "+"}))
    add("which", _log_which, ("--log", need), ("slug", {}))
    add("resume", _resume, ("--log", need), ("--run-class", {"default": "sutta"}))
    return p


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a, spark = parser().parse_args(argv), _session()
    _said.clear()
    code = a.run(spark, a)
    if a.into_log and a.into_run and a.command not in runlog.UNLOGGED:
        try:
            _logged(spark, a, argv)
        except Exception as e:  # noqa: BLE001  what a command has found stands, whether or not it could be logged
            print(f"not logged: {e}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
