"""Sharding by longest processing time: the largest unit first, each to the least-loaded shard, through a heap.

Rows with equal texts form a group that stays together.  A group of at least 1/(shards * fineness) of all bytes is a unit
of its own, of which there can be shards * fineness at most; all other groups are dealt by their hash into as many
bundles, which are units too.  So the driver schedules at most twice that many units, whatever the size of the corpus,
and rows find their shard by two small broadcast maps, without a shuffle of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import prepare, written

OVERHEAD = 8


def schedule(units: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """name -> shard for (size, name) units; ties by name and by the lower shard."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(units, key=lambda u: (-u[0], u[1])):
        load, s = loads[0]
        out[name] = s
        heapq.heapreplace(loads, (load + size, s))
    return out


def assign(docs: DataFrame, shards: int = 24, fineness: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text).

    size: bytes of the text (null: none) plus 8.  law: always ``bytes``, sizes as near to equal as the groups allow (a
    group above the mean has its shard for itself).  A null text counts as empty, and both form one group.  slot: from 0
    without gaps in each shard, in no particular order.  grown_shard: null.  fineness: units a shard, at least; it bounds
    what reaches the driver and how far shards differ.  Rows are kept one for one, other columns are ignored, an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    most = shards * fineness
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key")), "sized")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0]
    large = F.col("bytes") * most >= F.lit(total or 1)
    bundle = F.pmod(F.xxhash64("key"), F.lit(most)).cast("int")
    heavy = [(r.bytes, f"g{r.key.hex()}") for r in groups.where(large).toLocalIterator()]
    light = [(r.bytes, f"b{r.bundle:012d}") for r in groups.where(~large).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).toLocalIterator()]
    place = schedule(heavy + light, shards)
    of_group = spark.createDataFrame([(bytes.fromhex(n[1:]), s) for n, s in place.items() if n[0] == "g"], "key binary, group_shard int")
    of_bundle = spark.createDataFrame([(int(n[1:]), s) for n, s in place.items() if n[0] == "b"], "bundle int, bundle_shard int")
    placed = rows.withColumn("bundle", bundle).join(F.broadcast(of_group), "key", "left").join(F.broadcast(of_bundle), "bundle", "left").select("doc_id", "size", "text_crc32", F.coalesce("group_shard", "bundle_shard").alias("shard"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the rows of each shard in this task."""
        seen, task = [0] * shards, TaskContext.get().partitionId()
        for batch in batches:
            slots = []
            for s in batch.column("shard").to_pylist():
                slots.append(seen[s])
                seen[s] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(slots), pa.int64()), pa.array(slots, pa.int64())], [*batch.schema.names, "task", "nth"])

    numbered = written(placed.mapInArrow(counted, "doc_id long, size long, text_crc32 long, shard int, task long, nth long"), "numbered")
    counts = numbered.groupBy("shard", "task").agg(F.count("*").alias("n"))
    starts = written(counts.select("shard", "task", (F.expr("sum(n) over (partition by shard order by task)") - F.col("n")).alias("before")), "starts")
    return numbered.join(starts, ["shard", "task"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
