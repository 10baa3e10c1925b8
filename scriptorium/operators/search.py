"""Ranked full-text search over an inverted index.

An index gives the postings (term, doc_id, len, positions) of terms and prefixes: ``Index`` holds them for a table of the
moment, ``library.Library`` keeps them in segments on disk.  A query reads the postings of its own terms only, brings them
together by document, and evaluates phrases, prefixes and nearness with array expressions; document frequencies come from
the library's dictionary where the query is of single terms, else from one small aggregate, and the score is arithmetic.

The best few of a library are found without scoring all: blocks know the greatest score of a document in them, so a few
blocks that promise most give a score to beat, and of the rest only those are read that could beat it.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import match as M
from ..storage import written
from .dedupe import exact_clusters, weak_hints
from .library import Library

#: Of the score: how soon frequency saturates, and how much of it length takes.
K1, B = 1.2, 0.75
#: Postings that are scored without asking first which blocks can matter.
SCORE_ALL = 1 << 20
#: Zones whose names are given to the scan as a list; more are looked up by a join.
LISTED_ZONES = 4096


@dataclass
class Index:
    """entries: term, doc_id, len, positions; stats: doc_id, len; totals: n, mean_len (one row)."""

    entries: DataFrame
    stats: DataFrame
    totals: DataFrame

    def postings(self, whole: Iterable[str], prefixes: Iterable[str]) -> DataFrame:
        wanted = F.col("term").isin(*sorted(whole)) if whole else F.lit(False)
        for p in sorted(prefixes):
            wanted = wanted | F.col("term").startswith(p)
        return self.entries.where(wanted)

    def vocabulary(self) -> DataFrame:
        """term, documents, occurrences of all terms."""
        return self.entries.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of docs; documents without terms are not counted."""
    found = docs.select(F.col(key).alias("doc_id"), T.terms(F.col(text)).alias("terms")).withColumn("len", F.size("terms").cast("long"))
    stats = found.select("doc_id", "len").where("len > 0")
    entries = found.select("doc_id", "len", F.posexplode("terms").alias("at", "term")).groupBy("term", "doc_id", "len").agg(F.sort_array(F.collect_list("at")).alias("positions"))
    return Index(entries, stats, stats.agg(F.count("*").alias("n"), F.avg("len").alias("mean_len")))


def _needed(tree) -> tuple[set[str], set[str]]:
    """(whole terms, prefixes) that a query reads."""
    whole, prefixes = set(), set()
    for leaf in M.leaves(tree):
        for unit in leaf.units if isinstance(leaf, M.Near) else (leaf,):
            for k, term in enumerate(unit.terms):
                (prefixes if unit.prefix and k == len(unit.terms) - 1 else whole).add(term)
    return whole, prefixes


def _starts(unit: M.Unit) -> Column:
    """Where a unit occurs, from a map term -> positions named `held`."""
    if not unit.terms:
        return F.array().cast("array<int>")
    none = F.array().cast("array<int>")

    def places(k: int) -> Column:
        term = unit.terms[k]
        if unit.prefix and k == len(unit.terms) - 1:
            return F.array_sort(F.flatten(F.map_values(F.map_filter("held", lambda t, _: t.startswith(term)))))
        return F.coalesce(F.element_at("held", F.lit(term)), none)

    out = places(0)
    for k in range(1, len(unit.terms)):
        after = places(k)
        out = F.array_intersect(out, _moved(after, k))
    return F.filter(out, lambda p: p == 0) if unit.first else out


def _moved(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - k)


def _near(near: M.Near) -> Column:
    """Whether all units of a NEAR stand close enough, counted from the end of the first to the start of the last."""
    starts = [_starts(u) for u in near.units]

    def all_from(first: Column, n: int) -> Column:
        return functools.reduce(lambda a, b: a & b, (F.exists(s, lambda q: (q >= first) & (q - (first + n) <= near.within)) for s in starts))

    return functools.reduce(lambda a, b: a | b, (_any_from(s, len(u.terms), all_from) for s, u in zip(starts, near.units, strict=True)))


def _any_from(starts: Column, n: int, all_from) -> Column:
    return F.exists(starts, lambda p: all_from(p, n))


def _holds(tree) -> Column:
    if isinstance(tree, M.Unit):
        return F.size(_starts(tree)) > 0 if tree.terms else F.lit(False)
    if isinstance(tree, M.Near):
        return _near(tree)
    parts = [_holds(p) for p in tree.parts]
    if tree.kind == "not":
        return parts[0] & ~parts[1]
    return functools.reduce(lambda a, b: (a & b) if tree.kind == "and" else (a | b), parts)


def _held(postings: DataFrame) -> DataFrame:
    """doc_id, len and `held`, the positions of the query's terms in each document that has any."""
    return postings.groupBy("doc_id").agg(F.first("len").alias("len"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("held"))


def matches(index: Index | Library, query: str) -> DataFrame:
    """doc_id of the documents that a query matches."""
    tree = M.parse_or_quote(query)
    held = _held(index.postings(*_needed(tree if tree is not None else M.Unit(()))))
    return held.where(_holds(tree) if tree is not None else F.lit(False)).select("doc_id")


def _single(unit: M.Unit) -> bool:
    return len(unit.terms) == 1 and not unit.prefix and not unit.first


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def _impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def scored(index: Index | Library, query: str) -> DataFrame:
    """doc_id and score of the documents that a query matches; lower is better.

    For each unit outside NOT, and once for each time it stands in the query, -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 *
    len / mean)), idf = ln((n - df + 0.5) / (df + 0.5)) but 1e-6 at least.  A unit's df counts all documents that it occurs
    in, whatever the rest of the query says.
    """
    tree = M.parse_or_quote(query)
    if tree is None:
        return index.stats.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
    return _scored(index, tree, index.postings(*_needed(tree)), _frequencies(index, tree))


def _frequencies(index: Index | Library, tree) -> dict[str, int] | None:
    """The document frequencies of a tree's terms, where a dictionary has them and single terms are all that counts."""
    units = M.units(tree)
    return index.frequencies(u.terms[0] for u in units) if isinstance(index, Library) and all(map(_single, units)) else None


def _scored(index: Index | Library, tree, postings: DataFrame, frequencies: dict[str, int] | None) -> DataFrame:
    units = M.units(tree)
    distinct = list(dict.fromkeys(units))
    counted = _held(postings).select("doc_id", "len", _holds(tree).alias("holds"), *[(F.size(_starts(u)) if u.terms else F.lit(0)).alias(f"tf{k}") for k, u in enumerate(distinct)])
    if frequencies is None:
        found = counted.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(distinct))])
        rows = counted.where("holds").crossJoin(F.broadcast(found.crossJoin(index.totals)))
    else:
        n, mean = index.counts()
        dfs = {f"df{k}": F.lit(frequencies.get(u.terms[0], 0)) for k, u in enumerate(distinct)}
        rows = counted.where("holds").withColumns({"n": F.lit(n), "mean_len": F.lit(mean)} | dfs)
    score = F.lit(0.0)
    for unit in units:
        k = distinct.index(unit)
        score = score - _idf(F.col("n"), F.col(f"df{k}")) * _impact(F.col(f"tf{k}").cast("double"), F.col("len"), F.col("mean_len"))
    return rows.select("doc_id", score.alias("score"))


def promises(library: Library, tree, frequencies: dict[str, int]) -> DataFrame:
    """segment, zone, bound of the zones that may hold a match of a tree of single terms: no document there scores better."""
    units = M.units(tree)
    n, mean = library.counts()
    weight = {t: sum(u.terms[0] == t for u in units) for t in frequencies}
    best = F.array_max(F.transform("peaks", lambda p: _impact(p["tf"].cast("double"), p["len"], F.lit(mean))))
    of_term = F.coalesce(F.element_at(F.create_map(*[x for t, df in frequencies.items() for x in (F.lit(t), F.lit(float(weight[t])) * _idf(F.lit(n), F.lit(df)))]), F.col("term")), F.lit(0.0)) if frequencies else F.lit(0.0)
    zones = library.blocks(*_needed(tree)).select("segment", "zone", "term", (best * of_term).alias("most")).groupBy("segment", "zone").agg(F.sum("most").alias("bound"), F.collect_set("term").alias("terms"))
    return zones.where(_may_hold(tree)).select("segment", "zone", "bound")


def _may_hold(tree) -> Column:
    if isinstance(tree, M.Unit):
        return F.array_contains("terms", tree.terms[0])
    if tree.kind == "not":
        return _may_hold(tree.parts[0])
    return functools.reduce(lambda a, b: (a & b) if tree.kind == "and" else (a | b), map(_may_hold, tree.parts))


def _without(rows: DataFrame, hidden: DataFrame | None) -> DataFrame:
    return rows if hidden is None else rows.join(hidden.select("doc_id"), "doc_id", "left_anti")


def candidates(library: Library, tree, frequencies: dict[str, int], limit: int, hidden: DataFrame | None = None) -> DataFrame:
    """segment, zone, bound of the zones that are enough for the best `limit` matches of a tree of single terms, documents of
    hidden left out.

    Zones are scored in the order of what they promise, first a few and then ever more, until `limit` matches are at hand;
    all zones that promise less than the last of these can't change the result.
    """
    found = written(promises(library, tree, frequencies), "promises")
    total, few = found.count(), max(4, -(-2 * limit // 64))
    while few < total:
        first = found.orderBy(F.desc("bound"), "segment", "zone").limit(few)
        scores = _scored(library, tree, library.unfolded(_of_zones(library.blocks(*_needed(tree)), first)), frequencies)
        rows = _without(scores, hidden).orderBy("score", "doc_id").limit(limit).collect()
        if len(rows) == limit:
            # Sums of the same numbers in another order may differ in their last bits.
            return found.where(F.col("bound") >= -rows[-1].score * (1 - 1e-9))
        few *= 4
    return found


def _of_zones(blocks: DataFrame, zones: DataFrame) -> DataFrame:
    """Blocks of some zones; those of a bounded number of zones are asked for by number in the scan."""
    named = [(r.segment, r.zone) for r in zones.select("segment", "zone").limit(LISTED_ZONES + 1).collect()]
    if len(named) <= LISTED_ZONES:
        blocks = blocks.where(F.col("zone").isin(*sorted({z for _, z in named})))
    return blocks.join(zones.select("segment", "zone"), ["segment", "zone"], "left_semi")


def top(index: Index | Library, query: str, limit: int = 20, score_all: int | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """The `limit` best documents; equal scores by doc_id.  Those of hidden (doc_id) count for scores, but have no place.

    Of a library, a query of single terms with more than score_all postings (SCORE_ALL if not given) reads only blocks that
    can matter; with fewer, finding those out would take longer than scoring all.
    """
    tree = M.parse_or_quote(query)
    single = limit > 0 and isinstance(index, Library) and tree is not None and all(isinstance(u, M.Unit) and _single(u) for u in M.leaves(tree))
    frequencies = _frequencies(index, tree) if single else None
    if single and sum(frequencies.values()) > (SCORE_ALL if score_all is None else score_all):
        zones = candidates(index, tree, frequencies, limit, hidden)
        found = _scored(index, tree, index.unfolded(_of_zones(index.blocks(*_needed(tree)), zones)), frequencies)
    elif single:
        found = _scored(index, tree, index.postings(*_needed(tree)), frequencies)
    else:
        found = scored(index, query)
    return found.where(F.lit(False)) if limit <= 0 else _without(found, hidden).orderBy("score", "doc_id").limit(limit)


def top_without_duplicates(index: Index | Library, query: str, clusters: DataFrame, limit: int = 20, among: int | None = None) -> DataFrame:
    """The best documents, of each cluster of copies only the representative.

    clusters: doc_id, representative, members.  Copies are hidden before the best are taken, so however many there are, limit
    rows come back if so many clusters and single documents match.  A copy is hidden even where its representative did not
    match.  among: copies are hidden among so many best documents alone; then fewer rows may come back.
    """
    found = top(index, query, limit, hidden=clusters.where("doc_id <> representative")) if among is None else top(index, query, among)
    joined = found.join(clusters, "doc_id", "left").where("representative is null or representative = doc_id")
    return joined.select("doc_id", "score", F.coalesce("members", F.lit(1)).cast("long").alias("duplicate_count")).orderBy("score", "doc_id").limit(limit)


def snippets(hits: DataFrame, docs: DataFrame, query: str, width: int = 18) -> DataFrame:
    """hits (doc_id, ...) with a snippet: the window of `width` words with most hits, those in brackets.

    The window chosen is the first with the most hits; words are as written, between single spaces.
    """
    tree = M.parse_or_quote(query)
    whole, prefixes = _needed(tree) if tree is not None else (set(), set())
    cut = docs.join(hits.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.split(T.collapsed(F.col("text")), " ").alias("words"))

    def hit(word: Column) -> Column:
        return F.exists(T.terms(word), lambda t: functools.reduce(lambda a, b: a | b, [t.isin(*sorted(whole)) if whole else F.lit(False), *[t.startswith(p) for p in sorted(prefixes)]]))

    marked = cut.select("doc_id", "words", F.transform("words", lambda w: F.when(hit(w), 1).otherwise(0)).alias("hits"))
    counts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1))), lambda at: F.struct(F.aggregate(F.slice("hits", at, F.lit(width)), F.lit(0), lambda a, b: a + b).alias("n"), (-at).alias("at")))
    best = marked.withColumn("at", -F.array_max(counts)["at"])
    shown = F.array_join(F.zip_with(F.slice("words", F.col("at"), F.lit(width)), F.slice("hits", F.col("at"), F.lit(width)), lambda w, h: F.when(h == 1, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    text = F.concat(F.when(F.col("at") > 1, "... ").otherwise(""), shown, F.when(F.col("at") + width <= F.size("words"), " ...").otherwise(""))
    return hits.join(best.select("doc_id", text.alias("snippet")), "doc_id")


def with_deadline(spark, seconds: float, action):
    """What action() returns; its Spark jobs are cancelled after so many seconds, and TimeoutError is raised."""
    sc, tag = spark.sparkContext, f"deadline-{threading.get_ident()}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no answer in {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def library_hits(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Search and hiding of copies over docs in one call, without a written index or clusters."""
    return top_without_duplicates(build_index(docs), query, exact_clusters(docs), limit)


def assembled(index: Index | Library, docs: DataFrame, clusters: DataFrame, query: str, limit: int = 20, include_duplicates: bool = False, available=None) -> DataFrame:
    """A row for each hit: document_id, title, source_root, relative_path, source_path, extension, snippet, extraction_status,
    duplicate_count, duplicate_paths, possible_duplicate_of (source_path and signals), source_available, score.

    docs: doc_id, filename, source_root, rel_path, source_path, extension, extraction_status, text.  clusters: doc_id,
    representative, members.  include_duplicates: copies are shown as well.
    available: a function of rows (source_root, source_path) that says which sources are there (null for unknown); of all
    hits it is null where none is given.  duplicate_paths are the relative paths of a cluster's members by source path.
    Hits are `limit` at most, so names and copies are looked up for those alone.
    """
    if include_duplicates:
        found = top(index, query, limit).join(clusters, "doc_id", "left").select("doc_id", "score", F.coalesce("members", F.lit(1)).cast("long").alias("duplicate_count"))
    else:
        found = top_without_duplicates(index, query, clusters, limit)
    hits = written(found, "hits")
    meta = docs.select("doc_id", "filename", "source_root", "rel_path", "source_path", "extension", "extraction_status")
    heads = hits.join(clusters, "doc_id").select("doc_id", "representative")
    members = clusters.join(heads.select("representative").distinct(), "representative", "left_semi").select("representative", F.col("doc_id").alias("member"))
    paths = members.join(meta, F.col("member") == F.col("doc_id")).groupBy("representative").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_path", "rel_path"))), lambda x: x["rel_path"]).alias("duplicate_paths"))
    copies = heads.join(paths, "representative").select("doc_id", "duplicate_paths")
    # Hints of the hits alone: documents whose names have the key of a hit's name.
    keyed = meta.select("doc_id", "source_path", "filename").withColumn("name", T.hint_key(F.col("filename"))).where("name <> ''")
    near = keyed.join(keyed.join(hits, "doc_id", "left_semi").select("name").distinct(), "name", "left_semi").drop("name")
    hints = weak_hints(near, clusters).select("doc_id", F.transform("hints", lambda p: F.struct(p.alias("source_path"), F.array(F.lit("normalized_filename")).alias("signals"))).alias("possible_duplicate_of"))
    rows = snippets(hits, docs, query).join(meta, "doc_id").join(copies, "doc_id", "left").join(hints, "doc_id", "left")
    none = F.array().cast("array<struct<source_path: string, signals: array<string>>>")
    shown = rows.select(F.col("doc_id").alias("document_id"), F.col("filename").alias("title"), "source_root", F.col("rel_path").alias("relative_path"), "source_path", "extension", "snippet", "extraction_status", "duplicate_count", F.coalesce("duplicate_paths", F.array().cast("array<string>")).alias("duplicate_paths"), F.coalesce("possible_duplicate_of", none).alias("possible_duplicate_of"), "score")
    shown = written(shown, "shown")
    if available is None:
        return shown.withColumn("source_available", F.lit(None).cast("boolean"))
    # At most `limit` rows.
    asked = [(r.source_root, r.source_path) for r in shown.select("source_root", "source_path").collect()]
    states = shown.sparkSession.createDataFrame(list(zip([p for _, p in asked], available(asked), strict=True)), "source_path string, source_available boolean")
    return shown.join(states.distinct(), "source_path", "left").select(*[c for c in shown.columns if c != "score"], "source_available", "score")
