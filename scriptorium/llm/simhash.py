"""SimHash near-duplicates through an inverted index of positional bytes, with count filtering.

A fingerprint has 64 bits, eight positional bytes.  Two that differ in at most two bits share at least six of the eight.
Lists of single bytes would each hold a 256th of the corpus, so postings are made under four bytes at a time: the fourteen
blocks of the Steiner system S(3, 4, 8), that is, the sets of four positions whose numbers are zero under exclusive or.  Of
these blocks three lie within any six positions, one within five, at most one within four.  So the tally of the
keys that a pair shares says how many positional bytes it shares: pairs with a tally of three, the guaranteed minimum, are
retained (six bytes or more are shared), all others go, and those retained are verified by their differing bits.

A posting list longer than `list_limit` isn't paired.  Its members are linked exactly and in linear space instead: each
is posted under itself and under every fingerprint one bit away in the bytes outside the key.  Two members share such a
place if and only if they differ in at most two bits, and a place has at most 33 members.

Equal fingerprints are made one before any of this, so copies of a document cost nothing here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import components
from ._common import dropped, prepare, utf8, written

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text in UTF-8; 0 for a null or wordless one."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)), len(words) - shingle + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    counts = np.zeros((8, 8), np.int64)
    while (part := np.fromiter(islice(hashes, _CHUNK), "<u8")).size:
        counts += np.bincount((part.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > total).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long) of docs (doc_id, text), one row for each of its rows."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle, seed) for x in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(rows, "doc_id long, fp long")


_KEYS = [k for k in combinations(range(8), 4) if k[0] ^ k[1] ^ k[2] ^ k[3] == 0]
#: How many keys two fingerprints share that share six bytes.
LEAST_TALLY = 3


def _key(fp: Column, c: int) -> Column:
    """The number of a block and the four bytes that a fingerprint has there."""
    return reduce(lambda out, k: F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(0xFF))), _KEYS[c], F.lit(c).cast("long"))


def links(distinct: DataFrame, list_limit: int = 32) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (fp long) whose components are those of all pairs within two bits."""
    posted = distinct.select("fp", F.explode(F.array(*[_key(F.col("fp"), c) for c in range(len(_KEYS))])).alias("key"))
    sizes = written(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    lists = written(posted.join(sizes, "key"), "lists")
    dropped(sizes)
    short = lists.where(F.col("n") <= list_limit).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = short.select("fps", F.posexplode("fps").alias("k", "a")).select("a", F.explode(F.slice("fps", F.col("k") + 2, F.size("fps"))).alias("b"))
    # A pair with a shared list that is long may have a lesser tally here; that list links it.
    retained = pairs.groupBy("a", "b").agg(F.count("*").alias("tally")).where(F.col("tally") >= LEAST_TALLY)
    near = retained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    # What a flip of one bit outside the key's bytes makes of a fingerprint.
    flips = [F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << (8 * k + b)) - (1 << 64 if 8 * k + b == 63 else 0))) for k in range(8) if k not in key for b in range(8)]) for key in _KEYS]
    number = F.shiftright("key", 32).cast("int")
    chosen = reduce(lambda out, c: F.when(number == c, flips[c]).otherwise(out), range(1, len(_KEYS)), flips[0])
    places = lists.where(F.col("n") > list_limit).select("fp", number.alias("c"), F.explode(chosen).alias("place")).groupBy("c", "place").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = places.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("b"))
    return near.union(stars)


def _grouped(docs: DataFrame, shingle: int, seed: int, list_limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp of each row of docs; and of each distinct fingerprint `of` its component's label and component_id)."""
    marked = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    labels = written(components(links(distinct, list_limit)), "labels")
    labelled = written(distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label")), "labelled")
    least = written(labelled.groupBy("label").agg(F.min("least_id").alias("component_id")), "least")
    whole = written(labelled.join(least, "label").select(F.col("fp").alias("of"), "label", "component_id"), "whole")
    dropped(distinct, labels, labelled, least)
    return marked, whole


def groups(docs: DataFrame, shingle: int = 3, seed: int = 42, list_limit: int = 32) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text).

    component_id is the least doc_id reachable over fingerprints that differ in at most two bits, the document itself
    included.  Rows are kept one for one; texts without words (null, empty) have fingerprint zero and are linked like any
    other; rows without doc_id take part and get the least id of their component, null if none has one; other columns
    are ignored; an empty table gives no rows.
    """
    marked, whole = _grouped(docs, shingle, seed, list_limit)
    return marked.join(whole, marked.fp == whole["of"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """rows (id, row: a struct with text in it) with the fingerprint of each as fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle, seed) for x in utf8(batch.column("row").field("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, "fp"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fp", LongType())]))


def deduplicate(docs: DataFrame, shingle: int = 3, seed: int = 42, list_limit: int = 32) -> DataFrame:
    """docs (any columns, whatever their names) without the near copies: of each component one row stays, that with the least doc_id.

    Of several rows of a component with that id, the one with the least text stays; rows that share an id but not a
    component are not each other's copies.  Of a component in which no row has an id, the row with the least text stays.
    Ties of texts go by the other columns, of any type; null and empty texts are copies of each other; an empty table
    gives no rows.  What goes is taken out by its ids: texts are only shuffled where those are too many for Spark's own
    size check to broadcast.
    """
    marked, whole = _grouped(docs, shingle, seed, list_limit)
    ids = written(marked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("id")), "repeated")
    gone = marked.join(whole, marked.fp == whole["of"]).where("doc_id <> component_id").select(F.col("doc_id").alias("id"))
    named = ids.where("id is not null")
    out = written(gone.union(named), "gone")
    # A row is one struct from here on, so that no name of its columns can meet one of these.
    held = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = held.where("id is not null").join(out, "id", "left_anti").select("row")
    if not ids.isEmpty():
        # Rows that an id doesn't name are told apart by their fingerprints, made anew for these rows alone.
        unclear = held.where("id is null")
        if not named.isEmpty():
            unclear = unclear.unionByName(held.join(named, "id", "left_semi"))
        # Types that hold maps or variants have no order; those columns go by their JSON.
        value = lambda f: F.col("row").getField(f.name)
        order = [F.to_json(F.struct(value(f).alias(f.name))) if re.search(r"\b(map<|variant)", f.dataType.simpleString()) else value(f) for f in docs.schema if f.name != "text"]
        ranked = _with_fingerprint(unclear, shingle, seed).join(whole, (F.col("fp") == F.col("of")) & F.col("id").eqNullSafe(F.col("component_id")))
        keys = F.struct(F.col("row").getField("text").alias("k"), *[o.alias(f"k{n}") for n, o in enumerate(order)])
        kept = kept.unionByName(ranked.groupBy("label").agg(F.min_by("row", keys).alias("row")).select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
