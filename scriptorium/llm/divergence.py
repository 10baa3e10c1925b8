"""How the sources of a language differ in the words they use: all pairs of sources, and the words each one uses most above the rest.

Words are counted in each task and summed by Spark; words of enough documents are kept.  The kept words of a language are dealt
into blocks of bounded size, its sources into groups of bounded size, and each block becomes dense tiles of sources by words.
In a tile the smoothed shares are whole numbers, and all pairs of its sources are taken at once by broadcasting; each block
gives a partial matrix of pair sums, and for each source a heap of its first words.  Spark adds the matrices and merges the
heaps.  With more sources than one group holds, each pair of groups is a tile of its own.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import dropped, prepare, utf8, written

#: Fixed value: what is part of a word, after A-Z were lower-cased, in UTF-8; all else is a space.
_WORDS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Smoothing added to each count, and the whole that shares are parts of.
SMOOTHING, WHOLE = 5, 1_000_000_000
#: Words in a block and sources in a group, about and at most.
BLOCK_WORDS, GROUP_SOURCES = 1024, 128
#: Distinct (source, word) that a task counts before it sends its counts on.
_HELD = 1 << 19


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), documents (of docs that hold it), partly summed: of each task's batches."""
    prepare(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("documents", pa.int64())])

    def sent(tables: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in tables.items():
            terms = list(n)
            for low in range(0, len(terms), 1 << 14):
                some = terms[low : low + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([documents[t] for t in some], pa.int64())], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), utf8(batch.column("text")), strict=True):
                own = Counter(text.translate(_WORDS).split(b" "))
                own.pop(b"", None)
                n, documents = tables.setdefault((lang, source), (Counter(), Counter()))
                n.update(own)
                documents.update(own.keys())
            if sum(len(n) for n, _ in tables.values()) > _HELD:
                yield from sent(tables)
                tables = {}
        yield from sent(tables)

    return docs.mapInArrow(rows, "lang string, source string, term string, n long, documents long")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * counts / whole), exact for wholes up to 9e15 and counts up to their whole."""
    out, rest = counts // whole, counts % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _tile(top: int):
    """What one tile gives: rows (source_a, source_b, total) of pairs, and rows (source, term, value) of heaps."""

    def rows(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        group, one_group = table.column("source_group").to_numpy(), key[2].as_py() == key[3].as_py()
        place, terms = table.column("place").to_numpy(), table.column("term").combine_chunks().dictionary_encode()
        n, totals, kept = (table.column(c).to_numpy() for c in ("n", "total", "kept"))
        language, language_total = table.column("language_n").to_numpy(), table.column("language_total").to_numpy()
        # Rows without a term are the sources themselves, whether or not they have a word here.
        column = np.asarray(terms.indices.fill_null(-1))
        head = column < 0
        order = np.lexsort((place[head], group[head]))
        groups, places, whole = group[head][order], place[head][order], (totals + SMOOTHING * kept)[head][order]
        number = {pair: k for k, pair in enumerate(zip(groups.tolist(), places.tolist(), strict=True))}
        counts = np.zeros((len(number), len(terms.dictionary)), np.int64)
        row = np.array([number[pair] for pair in zip(group[~head].tolist(), place[~head].tolist(), strict=True)], np.int64)
        counts[row, column[~head]] = n[~head]
        p = shares(counts + SMOOTHING, whole[:, None])
        cut = len(p) if one_group else int((groups == groups[0]).sum())
        first, second = p[:cut], p if one_group else p[cut:]
        sums = np.zeros((len(first), len(second)), np.int64)
        step = max(1, (1 << 22) // max(1, second.size))
        for low in range(0, len(first), step):
            sums[low : low + step] = np.abs(first[low : low + step, None, :] - second[None, :, :]).sum(axis=2)
        # Words of the block that neither group has: shares of no occurrences differ with the sources' totals.
        absent = int(table.column("words").combine_chunks().drop_null()[0].as_py()) - counts.shape[1]
        none = shares(np.full(len(p), SMOOTHING, np.int64), whole)
        sums += absent * np.abs(none[: len(first), None] - (none if one_group else none[cut:])[None, :])
        a, b = np.meshgrid(np.arange(len(first)), np.arange(len(second)) + (0 if one_group else cut), indexing="ij")
        wanted = (a < b).ravel()
        pairs = (places[a.ravel()[wanted]], places[b.ravel()[wanted]], sums.ravel()[wanted])
        out = [pa.record_batch([pa.array(groups[a.ravel()[wanted]]), pa.array(pairs[0]), pa.array(groups[b.ravel()[wanted]]), pa.array(pairs[1]), pa.nulls(len(pairs[2]), pa.string()), pa.array(pairs[2])], names=["group_a", "place_a", "group_b", "place_b", "term", "value"])]
        if one_group and len(terms.dictionary):
            q = np.zeros(counts.shape[1], np.int64)
            q[column[~head]] = shares(language[~head] + SMOOTHING, (language_total + SMOOTHING * kept)[~head])
            names = terms.dictionary.cast(pa.binary()).to_pylist()
            for k in range(len(p)):
                above = np.flatnonzero((counts[k] > 0) & (p[k] > q))
                best = heapq.nsmallest(top, zip((q[above] - p[k][above]).tolist(), [names[c] for c in above.tolist()], strict=True))
                if best:
                    same = [pa.repeat(pa.scalar(x, pa.int32()), len(best)) for x in (int(groups[k]), int(places[k]))]
                    out.append(pa.record_batch([*same, pa.nulls(len(best), pa.int32()), pa.nulls(len(best), pa.int32()), pa.array([t.decode() for _, t in best], pa.string()), pa.array([-v for v, _ in best], pa.int64())], names=["group_a", "place_a", "group_b", "place_b", "term", "value"]))
        yield from out

    return rows


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least_documents: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others.

    docs: text, lang, source (other columns are ignored); nulls count as ''.  A language keeps the words that
    `least_documents` of its documents hold.  A source's share of a kept word is 1 + floor(10^9 (n + 5) / (N + 5 V)), N its
    occurrences of all V kept words.  Part `pair`: each other source and the sum of what the shares differ by, over all
    kept words (0 if there are none), all ranks.  Part `term`: the words of the source whose share is above the
    language's, by how much, the first `top` of them.  Equal values go by the items' bytes.  Sources without any kept
    word take part; a source that is alone in its language has no pairs; an empty table gives no rows.
    """
    given = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    own = written(counted(given).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "counts")
    terms = written(own.groupBy("lang", "term").agg(F.sum("documents").alias("d"), F.sum("n").alias("language_n")).where(F.col("d") >= least_documents).select("lang", "term", "language_n"), "terms")
    kept = written(own.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "language_n"), "kept")
    dropped(own)
    languages = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("language_n").alias("language_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sources = given.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    sources = sources.select("lang", "source", zero("total"), zero("kept"), zero("language_total"), F.expr(f"({BLOCK_WORDS - 1} + coalesce(kept, 0)) div {BLOCK_WORDS}").alias("blocks"), place.alias("at"))
    width = F.lit(GROUP_SOURCES)
    sources = written(sources.withColumn("source_group", F.floor(F.col("at") / width).cast("int")).withColumn("place", (F.col("at") % width).cast("int")).withColumn("groups", F.floor(F.max("at").over(Window.partitionBy("lang")) / width).cast("int") + 1), "sources")
    # Each source's rows go to the tiles of its group with each group, the source itself to all blocks of them.
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int")
    of_words = kept.join(sources, ["lang", "source"]).withColumn("block", block)
    in_block = terms.join(languages.select("lang", F.expr(f"({BLOCK_WORDS - 1} + kept) div {BLOCK_WORDS}").alias("blocks")), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").cast("int").alias("words"))
    of_sources = sources.join(in_block, "lang").withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "language_n": F.lit(0).cast("long")})
    of_words = of_words.withColumn("words", F.lit(None).cast("int"))
    columns = ["lang", "block", "source_group", "place", "term", "n", "words", "total", "kept", "language_n", "language_total", "groups"]
    tiles = of_words.select(*columns).unionByName(of_sources.select(*columns)).withColumn("other", F.explode(F.expr("sequence(0, groups - 1)")))
    tiles = tiles.withColumn("low", F.least("source_group", "other")).withColumn("high", F.greatest("source_group", "other")).drop("other", "groups")
    found = written(tiles.groupBy("lang", "block", "low", "high").applyInArrow(_with_lang(_tile(top)), "lang string, group_a int, place_a int, group_b int, place_b int, term string, value long"), "tiles")
    dropped(kept, terms)
    named = sources.select("lang", "source", F.col("source_group").alias("g"), F.col("place").alias("p"))

    def name(rows: DataFrame, side: str, to: str) -> DataFrame:
        return rows.withColumnsRenamed({f"group_{side}": "g", f"place_{side}": "p"}).join(named, ["lang", "g", "p"]).withColumnRenamed("source", to).drop("g", "p")

    sums = found.where("term is null").groupBy("lang", "group_a", "place_a", "group_b", "place_b").agg(F.sum("value").alias("value"))
    # Where no word is kept there are no tiles, and all pairs are equal.
    bare = sources.where("blocks = 0").select("lang", "source", "at", F.col("source_group").alias("group_a"), F.col("place").alias("place_a"), F.max("at").over(Window.partitionBy("lang")).alias("last"))
    bare = bare.where("at < last").withColumn("to", F.explode(F.expr("sequence(at + 1, last)"))).select("lang", "group_a", "place_a", F.floor(F.col("to") / width).cast("int").alias("group_b"), (F.col("to") % width).cast("int").alias("place_b"), F.lit(0).cast("long").alias("value"))
    both = written(name(name(sums.unionByName(bare), "a", "one"), "b", "two"), "pairs")
    pairs = both.select("lang", F.col("one").alias("source"), F.lit("pair").alias("part"), F.col("two").alias("item"), "value").unionByName(both.select("lang", F.col("two").alias("source"), F.lit("pair").alias("part"), F.col("one").alias("item"), "value"))
    heaps = name(found.where("term is not null").drop("group_b", "place_b"), "a", "source").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return _ranked(pairs).unionByName(_ranked(heaps).where(F.col("rank") <= top))


def _with_lang(tile):
    def rows(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tile(key, batches):
            yield batch.add_column(0, "lang", pa.repeat(key[0], batch.num_rows).cast(pa.string()))

    return rows


def report(docs: DataFrame) -> DataFrame:
    """The audit with words of 30 documents and first 50 words; all cases as in ``audit``."""
    return audit(docs)
