"""A document library with a full-text index, in immutable segments.

A segment holds documents, their lengths, a dictionary of terms sorted by term, and postings.  A change writes one segment
with the new and changed documents, a list of the (segment, document) that no longer count, and the terms of these; a
version file then names the segments and lists that make up the library.  Versions are numbered, and put only where there
is none of their number, so of two writers one goes on from what the other wrote.  When enough segments of like size have
come together they are made into one; a segment that is half dead is written anew.

Documents of a segment are numbered as its tasks read them, from a new zone on in each; ZONE of them are a zone, and a row of postings is what one
term has in one zone: a block.  A block also has its peaks, the (frequency, length) of those documents that none other of the
block beats in both: from them the greatest score that a document there can have is known for any mean length, without
reading the documents.  Blocks are dealt to buckets by a hash of the term, and of the stripe of zones where a term is in very
many documents, so that a term of all documents is spread like many terms.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import committed, dropped, latest, settings, written

#: Documents of a zone, zones of a stripe; a term of more documents than a stripe has is dealt by stripes.
ZONE, STRIPE = 64, 1024
#: Words of text that a bucket of postings is for, and the least number of buckets.
BUCKET_WORDS, LEAST_BUCKETS = 1 << 24, 8
#: Segments of like size that are made one.
FAN = 8
FORMAT = 1
BLOCKS = "term string, zone long, n long, peaks array<struct<tf: long, len: long>>, entries array<struct<doc_id: long, len: long, positions: array<int>>>"
POSTINGS = f"{BLOCKS}, segment string, bucket int"


def _bucket(term: Column, stripe: Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(term, stripe), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


#: What the documents of a part have of a term in one stripe, from a zone of the part on: n documents, and as numbers (data) the
#: id (from the least one on), the length, the place (from the first of the zone on) and the occurrences of each, then all
#: positions.  Numbers are in as many planes of two bytes as the greatest one needs (wide), the low ones first.  A row without
#: a least id has a document without one.  A row without a term has all documents of some zones in a row (ids, lens).
RUNS = "part int, term string, zone int, n int, wide int, least bigint, data binary, ids array<bigint>, lens array<int>"
#: Words that a task sorts at a time.
RUN_WORDS = 1 << 22
#: Bounds of the batches of texts and of runs.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def _starts_of(*keys):
    """Where any of some keys differs from the one before."""
    import numpy as np

    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _runs(zone: int, stripe: int, most: int):
    """A function of Arrow batches (doc_id, terms with a space between them) that gives RUNS: a part is a task, and zones are of documents as they come."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    types = {"part": pa.int32(), "term": pa.string(), "zone": pa.int32(), "n": pa.int32(), "wide": pa.int32(), "least": pa.int64(), "data": pa.binary(), "ids": pa.list_(pa.int64()), "lens": pa.list_(pa.int32())}

    def rows(size, **columns):
        columns["part"] = np.full(size, TaskContext.get().partitionId())
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in types.items()], schema=pa.schema(list(types.items())))

    def listed(values, kind):
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

    def made(ids, words, first):
        # Numbers of two or four bytes where they suffice, and arrays of all words or entries no longer than needed.
        n, lens = len(ids), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded, ends = words.flatten().dictionary_encode(), np.cumsum(lens)
        del words
        yield rows(1, zone=[first], n=[n], ids=listed(ids, pa.int64()), lens=listed(lens, pa.int32()))
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = coded.dictionary
        key *= n
        key += np.repeat(np.arange(n, dtype=np.int32), lens)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = (np.arange(len(key), dtype=np.int32) - np.repeat((ends - lens).astype(np.int32), lens))[order]
        del order
        entry = _starts_of(key)
        code, doc = (x.astype(np.int32) for x in np.divmod(key[entry], n))
        tf = np.diff(np.append(entry, len(key))).astype(np.int32)
        del key
        absent = ids.is_null().to_numpy(zero_copy_only=False)[doc]
        row = _starts_of(code, (first + doc // zone) // stripe, absent)
        # Of the rows: how many documents, positions and numbers they have, the least id, the first zone.
        held, places = np.diff(np.append(row, len(entry))), np.diff(np.append(entry[row], len(at)))
        numbers, began = 4 * held + places, entry[row]
        del entry
        known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        least, zones, last = known[doc[row]], doc[row] // zone, doc[row + held - 1]
        # Ids and places rise within a row; positions and occurrences are no greater than lengths.
        span = known[last].view(np.uint64) - least.view(np.uint64)
        peak = np.maximum(span, np.maximum(np.maximum.reduceat(lens[doc], row), last - zones * zone).astype(np.uint64))
        wide = 1 + sum((peak >= np.uint64(1 << bits)).astype(np.int64) for bits in (16, 32, 48))
        ends = np.cumsum(wide * numbers)
        low, out = ends - wide * numbers, np.empty(int(ends[-1]), "<u2")

        def put(values, spot, counts):
            """Values of the rows, so many of each, to where they belong; numbers of eight bytes as they are."""
            out[spot] = values.astype("<u2")
            if wide.max() > 1:
                of = np.repeat(np.arange(len(row)), counts)
                for k in range(1, int(wide.max())):
                    more = np.flatnonzero(wide[of] > k)
                    out[spot[more] + k * numbers[of[more]]] = (values[more].astype(np.uint64) >> np.uint64(16 * k)).astype("<u2")

        spot = np.repeat(low - row, held) + np.arange(len(doc))
        put(known[doc].view(np.uint64) - np.repeat(least.view(np.uint64), held), spot, held)
        step = np.repeat(held, held)
        for values in (lambda: lens[doc], lambda: doc - np.repeat(zones * zone, held), lambda: tf):
            spot += step
            put(values(), spot, held)
        del spot, step, tf
        put(at, np.repeat(low + 4 * held - began, places) + np.arange(len(at)), places)
        del at
        data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(out)])
        yield rows(len(row), term=coded.take(pa.array(code[row])), zone=first + zones, n=held, wide=wide, least=pa.array(least, mask=absent[row]), data=data)

    def run(batches):
        waiting, held, first = [], 0, 0

        def given():
            """Ids and words of the batches that wait, which are let go."""
            whole = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            order = pc.sort_indices(whole["doc_id"].chunk(0))
            return whole["doc_id"].chunk(0).take(order), whole["terms"].chunk(0).take(order)

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.split_pattern(batch.column("terms"), " ")], ["doc_id", "terms"])
            ends, low = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while low < len(ends):
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + most - held, "right")))
                waiting.append(batch.slice(low, high - low))
                held, low = held + ends[high - 1] - before, high
                if held >= most or low < len(ends):
                    zones = -(-sum(map(len, waiting)) // zone)
                    yield from made(*given(), first)
                    pa.default_memory_pool().release_unused()
                    first, held = first + zones, 0
        if waiting:
            yield from made(*given(), first)

    return run


def _unrolled(zone: int):
    """A function of Arrow batches of runs (term, zone, n, wide, least, data, bucket; zone that of the segment) that gives rows of
    postings, in the order of the runs.

    The peaks of a block are, by rising length, its (tf, len) of more occurrences than all before.
    """
    import numpy as np
    import pyarrow as pa

    def offsets(starts, end):
        return pa.array(np.append(starts, end), pa.int32())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, of_row = pa.table(batch).combine_chunks(), lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023
            data = whole["data"].chunk(0)
            _, cuts, buffer = data.buffers()
            cuts = np.frombuffer(cuts, np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) // 2
            values, n, wide = np.frombuffer(buffer, "<u2"), of_row("n"), of_row("wide")
            numbers, low = np.diff(cuts) // wide, cuts[:-1]

            def read(spot, of, values=values, wide=wide, numbers=numbers):
                out = values[spot].astype(np.uint64)
                for k in range(1, int(wide.max())):
                    more = np.flatnonzero(wide[of] > k)
                    out[more] |= values[spot[more] + k * numbers[of[more]]].astype(np.uint64) << np.uint64(16 * k)
                return out

            of = np.repeat(np.arange(len(n)), n)
            spot = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            ids, lens, place, tf = (read(spot + k * n[of], of) for k in range(4))
            lens, place, tf = (x.view(np.int64) for x in (lens, place, tf))
            places = numbers - 4 * n
            of_place = np.repeat(np.arange(len(n)), places)
            positions = read((low + 4 * n)[of_place] + np.arange(len(of_place)) - np.repeat(np.cumsum(places) - places, places), of_place)
            least = batch.column("least")
            found = (ids + least.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[of]).view(np.int64)
            ids = pa.array(found, mask=least.is_null().to_numpy(zero_copy_only=False)[of])
            block = _starts_of(of, place // zone)
            sizes = np.diff(np.append(block, len(of)))
            whose = np.repeat(np.arange(len(block)), sizes)
            order = np.lexsort((-tf, lens, whose))
            # Blocks rise, so the greatest so far is of the same block but at its beginning.
            most = np.maximum.accumulate(whose * (int(tf.max()) + 1) + tf[order])
            best = np.ones(len(of), bool)
            best[1:] = most[1:] > most[:-1]
            best = np.flatnonzero(best)
            peaks = pa.StructArray.from_arrays([pa.array(tf[order][best]), pa.array(lens[order][best])], ["tf", "len"])
            entries = pa.StructArray.from_arrays([ids, pa.array(lens), pa.ListArray.from_arrays(offsets(np.cumsum(tf) - tf, len(positions)), pa.array(positions.astype(np.int32)))], ["doc_id", "len", "positions"])
            row = pa.array(of[block])
            columns = {
                "term": batch.column("term").take(row),
                "zone": pa.array(of_row("zone")[of[block]] + place[block] // zone),
                "n": pa.array(sizes),
                "peaks": pa.ListArray.from_arrays(offsets(np.searchsorted(best, block), len(best)), peaks),
                "entries": pa.ListArray.from_arrays(offsets(block, len(of)), entries),
                "bucket": batch.column("bucket").take(row),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def write_segment(docs: DataFrame, root: str, stripe: int | None = None) -> dict | None:
    """Writes docs (doc_id, text, ...; an id once) as a segment; what the version file has to know of it, None for no rows.

    Texts are not shuffled: each task makes runs of what it reads, and of all runs what is shuffled is their lists of numbers.
    """
    spark, name = docs.sparkSession, uuid.uuid4().hex
    place = {kind: f"{root}/{kind}/segment={name}" for kind in ("docs", "stats", "terms", "postings")}
    docs.write.option("compression", "zstd").parquet(place["docs"])
    held = spark.read.parquet(place["docs"])
    count = held.count()
    if not count:
        return None
    parsed = held.select(F.col("doc_id").cast("long").alias("doc_id"), T.spaced_terms(F.col("text")).alias("terms")).where("terms <> ''")
    with settings(spark, BATCHES):
        runs = written(parsed.mapInArrow(_runs(ZONE, STRIPE, RUN_WORDS), RUNS), "runs")
    whole = runs.where("term is null")
    # A part begins with a stripe; a row for each task comes to the driver.
    parts, base = [], 0
    for r in whole.groupBy("part").agg(F.max(F.col("zone") + F.ceil(F.col("n") / ZONE)).alias("n")).orderBy("part").collect():
        parts.append((r.part, base))
        base += -(-r.n // STRIPE) * STRIPE
    bases = F.broadcast(spark.createDataFrame(parts, "part int, base long"))
    stats = whole.join(bases, "part").select("base", F.col("zone").alias("first"), F.posexplode(F.arrays_zip("ids", "lens")).alias("at", "one"))
    stats.select(F.col("one.ids").alias("doc_id"), F.col("one.lens").cast("long").alias("len"), ((F.col("base") + F.col("first")) * ZONE + F.col("at")).cast("long").alias("local")).write.parquet(place["stats"])
    n, words = spark.read.parquet(place["stats"]).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    based = runs.where("term is not null").join(bases, "part").withColumn("stripe", F.floor((F.col("base") + F.col("zone")) / STRIPE))
    many = ZONE * STRIPE if stripe is None else stripe
    terms = based.groupBy("term").agg(F.sum("n").alias("df"), F.max("stripe").alias("last")).select("term", "df", F.when(F.col("df") > many, F.col("last") + 1).otherwise(1).cast("long").alias("stripes"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(place["terms"])
    buckets = max(LEAST_BUCKETS, -(-words // BUCKET_WORDS))
    # A table of its own, so that Spark knows its size: then the runs are not shuffled for this join.
    hot = written(spark.read.parquet(place["terms"]).where("stripes > 1").select("term", "stripes"), "hot")
    dealt = based.join(hot, "term", "left").withColumn("bucket", _bucket(F.col("term"), F.when(F.col("stripes") > 1, F.col("stripe")).otherwise(0).cast("long"), buckets))
    ordered = dealt.select("bucket", "term", (F.col("base") + F.col("zone")).alias("zone"), "n", "wide", "least", "data").repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "term", "zone")
    # A task has one bucket, so nothing need be sorted for its writer, which would sort the blocks once more.
    with settings(spark, {"spark.sql.optimizer.plannedWrite.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "2"} | BATCHES):
        ordered.mapInArrow(_unrolled(ZONE), f"{BLOCKS}, bucket int").write.option("compression", "zstd").partitionBy("bucket").parquet(place["postings"])
    dropped(runs, hot)
    return {"id": name, "docs": count, "held": n, "words": words, "buckets": buckets, "dead": 0, "dead_held": 0, "dead_words": 0}


class Overtaken(ValueError):
    """Another writer has changed the library since the version that a change was made from."""


@dataclass
class Library:
    """One version of a library; what it reads never changes.

    A search asks it for the postings of terms: ``postings`` reads the buckets that the dictionary names for them, and no
    others.
    """

    spark: SparkSession
    root: str
    version: int = 0
    segments: list[dict] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    about: dict = field(default_factory=dict)

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}/segment={s['id']}" for s in self.segments]
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.root}/{kind}")
        # A segment without words has no files of some kinds, whose columns can't be told from files then.
        return (reader if kind == "docs" else reader.schema(schema)).parquet(*paths)

    def _dead(self, kind: str, schema: str) -> DataFrame:
        live = [s["id"] for s in self.segments if s["dead"]]
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{t}" for t in self.tombstones]).where(F.col("segment").isin(*live))

    def _alive(self, rows: DataFrame) -> DataFrame:
        if not any(s["dead"] for s in self.segments):
            return rows
        return rows.join(self._dead("dead", "segment string, doc_id long"), ["segment", "doc_id"], "left_anti")

    def documents(self) -> DataFrame:
        """The documents, with the columns they were given with."""
        return self._alive(self._read("docs", "doc_id long, text string, segment string")).drop("segment")

    @property
    def stats(self) -> DataFrame:
        """doc_id and len of the documents with words."""
        return self._alive(self._read("stats", "doc_id long, len long, local long, segment string")).select("doc_id", "len")

    def counts(self) -> tuple[int, float]:
        """How many documents have words, and how many words they have in the mean."""
        n = sum(s["held"] - s["dead_held"] for s in self.segments)
        return n, sum(s["words"] - s["dead_words"] for s in self.segments) / n if n else 0.0

    @property
    def totals(self) -> DataFrame:
        return self.spark.createDataFrame([self.counts()], "n long, mean_len double")

    def _dictionary(self, whole: Iterable[str], prefixes: Iterable[str]) -> DataFrame:
        wanted = F.col("term").isin(*sorted(whole)) if whole else F.lit(False)
        for p in sorted(prefixes):
            wanted = wanted | F.col("term").startswith(p)
        return self._read("terms", "term string, df long, stripes long, segment string").where(wanted)

    def frequencies(self, terms: Iterable[str]) -> dict[str, int]:
        """In how many documents each of some terms is; terms without any are left out."""
        asked = sorted(set(terms))
        if not asked or not self.segments:
            return {}
        rows = self._dictionary(asked, ()).select("term", "df")
        if any(s["dead"] for s in self.segments):
            rows = rows.unionByName(self._dead("dead_terms", "segment string, term string, n long").where(F.col("term").isin(*asked)).select("term", (-F.col("n")).alias("df")))
        return {r.term: r.df for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect() if r.df > 0}

    def places(self, whole: Iterable[str], prefixes: Iterable[str]) -> list[tuple[str, int]]:
        """(segment, bucket) where the postings of some terms and prefixes are, from the dictionary."""
        if not self.segments:
            return []
        buckets = F.create_map(*[F.lit(x) for s in self.segments for x in (s["id"], s["buckets"])])
        each = self._dictionary(whole, prefixes).select("segment", "term", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)).alias("stripe"))
        found = each.select("segment", _bucket(F.col("term"), F.col("stripe"), F.element_at(buckets, F.col("segment"))).alias("bucket")).distinct()
        return sorted((r.segment, r.bucket) for r in found.collect())

    def blocks(self, whole: Iterable[str], prefixes: Iterable[str]) -> DataFrame:
        """Rows of postings of some terms and prefixes, from the buckets that hold them."""
        wanted = F.col("term").isin(*sorted(whole)) if whole else F.lit(False)
        for p in sorted(prefixes):
            wanted = wanted | F.col("term").startswith(p)
        paths = [f"{self.root}/postings/segment={s}/bucket={b}" for s, b in self.places(whole, prefixes)]
        if not paths:
            return self.spark.createDataFrame([], POSTINGS)
        return self.spark.read.schema(POSTINGS).option("basePath", f"{self.root}/postings").parquet(*paths).where(wanted)

    def unfolded(self, blocks: DataFrame) -> DataFrame:
        """term, doc_id, len, positions of blocks, dead documents left out."""
        return self._alive(blocks.select("segment", "term", F.inline("entries"))).select("term", "doc_id", "len", "positions")

    def postings(self, whole: Iterable[str], prefixes: Iterable[str]) -> DataFrame:
        return self.unfolded(self.blocks(whole, prefixes))

    def vocabulary(self) -> DataFrame:
        """term, documents, occurrences of all terms."""
        paths = [f"{self.root}/postings/segment={s['id']}" for s in self.segments if s["held"]]
        if not paths:
            return self.spark.createDataFrame([], "term string, documents long, occurrences long")
        blocks = self.spark.read.schema(POSTINGS).option("basePath", f"{self.root}/postings").parquet(*paths)
        return self.unfolded(blocks).groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


def opened(spark: SparkSession, root: str) -> Library:
    """The newest version of a library; an empty one where there is none."""
    number, text = latest(spark, f"{root}/versions")
    return _library(spark, root, number, text)


def _library(spark: SparkSession, root: str, number: int, text: str | None) -> Library:
    held = json.loads(text) if text else {"format": FORMAT, "segments": [], "tombstones": [], "about": {}}
    if held["format"] != FORMAT:
        raise ValueError(f"{root} is of format {held['format']}")
    return Library(spark, root, number, held["segments"], held["tombstones"], held["about"])


def _text(segments: list[dict], tombstones: list[str], about: dict) -> str:
    return json.dumps({"format": FORMAT, "segments": segments, "tombstones": tombstones, "about": about})


def _buried(library: Library, ids: DataFrame) -> tuple[list[dict], list[str]]:
    """Segments and tombstones of a library without the documents of ids (doc_id)."""
    spark, name = library.spark, uuid.uuid4().hex
    # A table of its own, so that Spark knows its size: a small one is sent to where the texts are.
    listed = written(ids.select("doc_id").distinct(), "ids")
    there = library._alive(library._read("docs", "doc_id long, text string, segment string").join(listed, "doc_id", "left_semi"))
    gone = written(there.select("segment", "doc_id", T.terms(F.col("text")).alias("terms")), "gone")
    found = {r.segment: r for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(F.size("terms") > 0).alias("held"), F.sum(F.size("terms")).alias("words")).collect()}
    dropped(listed)
    if not found:
        return library.segments, library.tombstones
    # So that the frequency of a term is known without its postings.
    lists, kept = {"dead": gone.select("segment", "doc_id"), "dead_terms": gone.select("segment", F.explode(F.array_distinct("terms")).alias("term")).groupBy("segment", "term").agg(F.count("*").alias("n"))}, library.tombstones
    if len(kept) >= FAN:
        kept = []
        lists = {kind: rows.unionByName(library._dead(kind, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))) for kind, rows in lists.items()}
    for kind, rows in lists.items():
        rows.write.parquet(f"{library.root}/{kind}/{name}")
    dropped(gone)
    out = []
    for s in library.segments:
        r = found.get(s["id"])
        out.append(s if r is None else s | {"dead": s["dead"] + r.n, "dead_held": s["dead_held"] + r.held, "dead_words": s["dead_words"] + r.words})
    return [s for s in out if s["dead"] < s["docs"]], [*kept, name]


def changed(spark: SparkSession, root: str, fresh: DataFrame, gone: DataFrame | None = None, about: dict | None = None, base: int | None = None) -> Library:
    """The library with the documents fresh (doc_id, text, ...; an id once) in place of any with these ids, and without those of gone.

    about: what the version file is to say besides.  base: the version that the change was made from; if another one has
    come since, Overtaken is raised; without it the change goes on top of whatever is newest.
    """
    segment = write_segment(fresh, root)
    ids = fresh.select("doc_id") if gone is None else fresh.select("doc_id").union(gone.select("doc_id"))

    def change(number: int, text: str | None) -> str:
        if base is not None and number != base:
            raise Overtaken(f"{root} has version {number} now, not {base}")
        library = _library(spark, root, number, text)
        segments, tombstones = _buried(library, ids) if library.segments else ([], [])
        return _text([*segments, *([segment] if segment else [])], tombstones, library.about | (about or {}))

    committed(spark, f"{root}/versions", change)
    return merged(spark, root)


def _due(segments: list[dict]) -> list[dict]:
    """Segments that are to be made one: many of a size, or one that is half dead."""
    tiers: dict[int, list[dict]] = {}
    for s in segments:
        tiers.setdefault(int(math.log(max(1, s["docs"] - s["dead"]), FAN)), []).append(s)
    full = [held for _, held in sorted(tiers.items()) if len(held) >= FAN]
    return full[0] if full else [s for s in segments if 2 * s["dead"] > s["docs"]]


def merged(spark: SparkSession, root: str) -> Library:
    """The library after all merges that are due; a document is written anew once for each power of FAN at most."""
    while due := _due(opened(spark, root).segments):
        ids = {s["id"] for s in due}
        done: dict[str, dict | None] = {}

        def change(number: int, text: str | None, ids=ids, done=done) -> str | None:
            library = _library(spark, root, number, text)
            part = [s for s in library.segments if s["id"] in ids]
            if {s["id"] for s in part} != ids:
                return None  # another writer has merged some of them
            # What has died since the last try must not come back.
            state = json.dumps(part)
            if state not in done:
                done[state] = write_segment(Library(spark, root, number, part, library.tombstones).documents(), root)
            segments = [s for s in library.segments if s["id"] not in ids] + ([done[state]] if done[state] else [])
            return _text(segments, library.tombstones if any(s["dead"] for s in segments) else [], library.about)

        committed(spark, f"{root}/versions", change)
    return opened(spark, root)
