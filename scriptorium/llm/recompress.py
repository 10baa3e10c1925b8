"""Substring deduplication by recompression: equal stretches of words get equal symbols, wherever they stand.

Words get names, and in each round neighbouring symbols are named together.  Every symbol is left or right by a bit of its
name; a left one followed by a right one becomes a pair, and what is left over is taken in runs of equal symbols.  A name is
a hash of what it stands for, so it is the same in all documents and tasks: a shared dictionary of pairs would be as large as
the corpus.  With each symbol goes its reach, the words that settle it: its own, and the neighbours that decided that it was
not made part of another one.  A symbol whose reach lies in a stretch of words is there wherever that stretch occurs.

After the rounds (two for windows of 13 words: a window then holds the reach of some symbol, unless words repeat at once),
each window of words has as its anchor, of the symbols whose reach lies in it, that of the least name.  Neighbouring windows
mostly agree on it, so some fifth as many anchors as words stand for all windows; a window without one is its own anchor.
Then two rounds of Spark: anchors that only one document has go; of the windows that hang on the rest, those are found that
occur in a document with a smaller id.  The first compares keys of 64 bits, the second 128-bit hashes of all words of a window,
made from two names of each word, so what one name has brought together is told apart there.  A document equal to an earlier one is settled by its top symbol.

Anchors and windows are counted before they are shuffled and looked up by joins that adaptive execution can split, so a
passage of a third of all documents is no one task's work.  Texts are shuffled twice, beside their own anchors and results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, prepare, utf8, written

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd factors that tell the places of a window's words apart.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(32)], np.uint64)
#: Words that are parsed together.
_CHUNK = 1 << 18


class _Names(dict):
    """Names of words, made when first asked for; other seeds give other names."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = name = xxhash.xxh64_intdigest(word, self.seed)
        return name


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _round(names: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over symbols with their reaches [low, high): names and reaches of the pairs and runs.

    The first and the last symbol are edges of the text: what depends on them has a reach that no window holds.
    """
    n = len(names)
    left = (_mixed(names ^ _M1) & np.uint64(1)).astype(bool)
    heads = np.zeros(n, bool)
    heads[:-1] = left[:-1] & ~left[1:]
    tails = np.zeros(n, bool)
    tails[1:] = heads[:-1]
    single = ~(heads | tails)
    # A single symbol goes on with the run before it if that is single and equal.
    going_on = np.zeros(n, bool)
    going_on[1:] = single[1:] & single[:-1] & (names[1:] == names[:-1])
    starts = np.flatnonzero(~(tails | going_on))
    ends = np.append(starts[1:], n)
    size, first = ends - starts, names[starts]
    paired = heads[starts]
    run = ~paired & (size > 1)
    out = first.copy()
    out[paired] = _mixed(first[paired] * _M1 + _mixed(names[starts[paired] + 1]))
    out[run] = _mixed(first[run] * _M2 + size[run].astype(np.uint64))
    # A pair is settled by its two symbols; others by the symbol on either side too, and if that is an equal one, made part
    # of a pair, by the other half of that pair.
    before, after = np.where(paired, starts, starts - 1), np.where(paired, ends - 1, ends)
    before -= ~paired & (starts > 0) & (names[np.maximum(starts - 1, 0)] == first)
    after += ~paired & (ends < n) & (names[np.minimum(ends, n - 1)] == first)
    outer_low, outer_high = np.where(before < 0, -(1 << 40), low[np.maximum(before, 0)]), np.where(after >= n, 1 << 40, high[np.minimum(after, n - 1)])
    return out, outer_low, outer_high


def rounds_for(window: int) -> int:
    """How many rounds leave a symbol with its reach in every window: a round doubles symbols and what lies around them."""
    return max(1, ((window + 3) // 4).bit_length() - 1)


def _least(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[first:end] for each pair, by tables of powers of two; none of the stretches is empty."""
    size = end - first
    power = np.frexp(size.astype(np.float64))[1] - 1
    out, table = np.empty(len(first), values.dtype), values
    for k in range(int(power.max()) + 1 if len(power) else 0):
        which = power == k
        out[which] = np.minimum(table[first[which]], table[end[which] - (1 << k)])
        half = 1 << k
        table = np.minimum(table[:-half], table[half:]) if len(table) > half else table
    return out


def anchors(names: np.ndarray, window: int) -> np.ndarray:
    """For each window of the text (word names) the key of its anchor: equal windows have equal keys."""
    n = len(names) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    symbols, low, high = names, np.arange(len(names)), np.arange(1, len(names) + 1)
    for _ in range(rounds_for(window)):
        symbols, low, high = _round(symbols, low, high)
    fits = high - low <= window
    symbols, low, high = symbols[fits], low[fits], high[fits]
    at = np.arange(n)
    first, end = np.searchsorted(low, at), np.searchsorted(high, at + window, "right")
    start, stop = at.copy(), at + window
    held = end > first
    if held.any():
        # The least name, its place in the last bits.
        bits = np.uint64(max(1, len(symbols).bit_length()))
        order = (_mixed(symbols) >> bits << bits) | np.arange(len(symbols), dtype=np.uint64)
        chosen = (_least(order, first[held], end[held]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        start[held], stop[held] = low[chosen], high[chosen]
    # The key is made of all words that the anchor reaches, once for each anchor.
    fresh = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))
    a, size = start[fresh], (stop - start)[fresh]
    key = size.astype(np.uint64) * _M1
    for k in range(int(size.max())):
        inside = size > k
        key[inside] = _mixed(key[inside] * _M2 + names[a[inside] + k])
    return key[np.cumsum(fresh) - 1]


def _batch_anchors(names: np.ndarray, window: int) -> np.ndarray:
    """The keys of all windows of texts put one behind the other, in bounded pieces.

    Texts and pieces need nothing between them: a window's anchor depends on the words of the window alone.
    """
    n = max(0, len(names) - window + 1)
    return np.concatenate([np.empty(0, np.uint64), *[anchors(names[low : min(n, low + _CHUNK) + window - 1], window) for low in range(0, n, _CHUNK)]])


def _parsed(batch: pa.RecordBatch, window: int, names: _Names) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text of a batch, the names of all words, where each text begins among them, and the keys of all windows."""
    words = [text.split() for text in utf8(batch.column("text"))]
    starts = np.cumsum([0, *map(len, words)])
    named = np.fromiter(map(names.__getitem__, chain.from_iterable(words)), np.uint64, int(starts[-1]))
    return words, named, starts, _batch_anchors(named, window)


def _top(named: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(named.tobytes())


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *values]), kind))


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, version, top (binary), keys (each once) of the documents that have a window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in batches:
            _, named, starts, found = _parsed(batch, window, names)
            kept = np.flatnonzero(np.diff(starts) >= window)
            spans = list(zip(starts[kept].tolist(), starts[kept + 1].tolist(), strict=True))
            keys = [np.unique(found[low : high - window + 1]).view(np.int64) for low, high in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept)), batch.column("version").take(pa.array(kept)), pa.array([_top(named[low:high]) for low, high in spans], pa.binary()), _lists(keys, pa.int64())], ["doc_id", "version", "top", "keys"])

    return docs.mapInArrow(rows, "doc_id long, version long, top binary, keys array<long>")


def _window_hash(names: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the words of windows, from names of theirs."""
    out = np.zeros(len(at), np.uint64)
    for k in range(window):
        out += names[at + k] * _FACTORS[k % len(_FACTORS)]
        if k % len(_FACTORS) == len(_FACTORS) - 1:
            out = _mixed(out)
    return _mixed(out)


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, version, at (the window's first word), a, b (its 128-bit hash) of windows whose anchor is among `keys`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, others = _Names(), _Names(1)
        for batch in batches:
            words, named, starts, found = _parsed(batch, window, names)
            second = np.fromiter(map(others.__getitem__, chain.from_iterable(words)), np.uint64, len(named))
            keys, which = batch.column("keys"), []
            for k, (low, high) in enumerate(zip(starts.tolist(), starts[1:].tolist(), strict=False)):
                if high - low >= window:
                    which.append(low + np.flatnonzero(np.isin(found[low : high - window + 1], np.asarray(keys[k].values).view(np.uint64))))
            wanted = np.concatenate([np.empty(0, np.int64), *which])
            for low in range(0, len(wanted), 1 << 16):
                at = wanted[low : low + (1 << 16)]
                text = np.searchsorted(starts, at, "right") - 1
                of = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(of), batch.column("version").take(of), pa.array((at - starts[text]).astype(np.int32)), *[pa.array(_window_hash(x, at, window).view(np.int64)) for x in (named, second)]],
                    ["doc_id", "version", "at", "a", "b"],
                )

    return docs.mapInArrow(rows, "doc_id long, version long, at int, a long, b long")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and version, which tells texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))


def repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, version, whole, at: where windows of words start that also start in a document with a smaller doc_id.

    One row for each document (doc_id and text) that has any; `whole` is true, and `at` empty, where all its words are
    those of an earlier document.  Written to the shared folder.
    """
    prepare(docs.sparkSession)
    known = _identified(docs).where("doc_id is not null")
    posted = written(_anchor_rows(known, window), "anchors")
    tops = written(posted.groupBy("top").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("top", "first"), "tops")
    copies = written(posted.select("doc_id", "version", "top").join(tops, "top").where("doc_id > first").select("doc_id", "version").distinct(), "copies")
    each = posted.select("doc_id", "version", F.explode("keys").alias("key"))
    shared = written(each.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key"), "shared")
    left = each.join(shared, "key").groupBy("doc_id", "version").agg(F.collect_set("key").alias("keys"))
    candidates = written(left.join(copies, ["doc_id", "version"], "left_anti"), "candidates")
    dropped(posted, tops, shared)
    beside = known.join(candidates, ["doc_id", "version"]).select("doc_id", "version", "text", "keys")
    windows = written(_window_rows(beside, window), "windows")
    dropped(candidates)
    firsts = written(windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a", "b", "first"), "firsts")
    later = windows.join(firsts, ["a", "b"]).where("doc_id > first").groupBy("doc_id", "version").agg(F.collect_set("at").alias("at"))
    found = later.select("doc_id", "version", F.lit(False).alias("whole"), "at").unionByName(copies.select("doc_id", "version", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("at")))
    out = written(found, "repeats")
    dropped(windows, firsts, copies)
    return out


def deduplicate(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary: the words that stay, joined by one space) for each row of docs.

    docs: doc_id, text; other columns are ignored.  A word goes if a window of `window` consecutive words covers it whose
    words also start, as a window, in a document with a smaller doc_id; windows are judged on the texts as they come.
    Null and wordless texts have no words; texts shorter than a window stay whole.  Rows without a doc_id are nobody's
    earlier document and keep all words, and so do the first of equal documents; rows that share a doc_id aren't earlier
    than each other.  A window that occurs twice in one document alone stays.  An empty table gives no rows.
    """
    found = repeats(docs, window)
    # A version may be repeated (rows that are equal); its result is the same for each of them.
    beside = _identified(docs).join(found, ["doc_id", "version"], "left").select("doc_id", "text", "whole", "at")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at = batch.column("whole").to_pylist(), batch.column("at")
            counts, gone, kept = [], [], []
            for k, text in enumerate(utf8(batch.column("text"))):
                words = text.split()
                counts.append(len(words))
                if whole[k] is None:
                    gone.append(0)
                    kept.append(b" ".join(words))
                    continue
                starts = np.asarray(at[k].values, np.int64)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + window, -1)
                stays = (np.cumsum(change)[:-1] == 0) & (not whole[k])
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(compress(words, stays.tolist())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return beside.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept binary")


def report(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (hex) for each row of docs; all cases as in ``deduplicate``."""
    return deduplicate(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
