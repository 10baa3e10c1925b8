"""Streams that keep tables current: the run log, and a library of documents that arrive.

Each batch is written under its own number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import library
from ..operators.runlog import phase_name


def follow_log(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends log entries that arrive as JSON lines; each is stamped with its batch and keeps its own time."""
    rows = spark.readStream.schema(schema).json(source).withColumn("phase", phase_name(F.col("phase")))

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hits_by_window(entries: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Entries and hits by tool in windows of time, for batch or stream; entries later than `late` don't count any more."""
    return entries.withWatermark("ts", late).groupBy(F.window("ts", width), "tool").agg(F.count("*").alias("entries"), F.sum("hits").alias("hits")).select(F.col("window.start").alias("start"), "tool", "entries", "hits")


def follow_documents(spark: SparkSession, source: str, root: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Puts documents that arrive as Parquet into a library (``operators.library``), each batch as a change of its own.

    The number of the last batch stands in the library's version, so a batch that is run again after a failure changes
    nothing.  Of several texts of one document in a batch the greatest one counts.
    """
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(source).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    mark = f"batch of {checkpoint}"

    def put(batch: DataFrame, number: int) -> None:
        if library.opened(spark, root).about.get(mark, -1) < number:
            library.changed(spark, root, batch.groupBy("doc_id").agg(F.max("text").alias("text")), about={mark: number})

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
