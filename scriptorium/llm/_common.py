"""Plumbing shared by the operators of this subpackage.

Where a task has to write a file itself it goes through ``pyarrow.fs`` (local, HDFS and object-store URIs)
into the folder named by ``spark.checkpoint.dir``, under a temporary name that is then moved into place, so
that a repeated or speculative attempt only replaces equal bytes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, shared_folder, table, written  # noqa: F401  for the operators

#: Rows in one Arrow batch; with texts of some kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 256
#: Bytes in one Arrow batch, however long its texts are (one row may be longer).
BATCH_BYTES = 16 << 20

_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, and bound the session's Arrow batches.

    The bound is a setting of the session, since Spark has none for one query; it is only ever lowered.
    """
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in sorted(os.walk(package)):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, package)))
    sc.addPyFile(archive)
    _shipped[sc] = archive


def file_system(uri: str):
    """(file system, path) of a URI or plain path, on the driver or in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else (fs.LocalFileSystem(), uri)


class CommittedFile:
    """An output stream under a temporary name; ``commit`` moves it to its own, ``abandon`` removes it."""

    def __init__(self, folder: str, name: str):
        self.fs, path = file_system(folder)
        self.path, self.temporary = f"{path}/{name}", f"{path}/_temporary-{uuid.uuid4().hex}"
        self.fs.create_dir(path, recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)

    def abandon(self) -> None:
        """Removes what was written; nothing happens after ``commit``."""
        if not self.stream.closed:
            self.stream.close()
            self.fs.delete_file(self.temporary)


def utf8(column: pa.Array) -> list:
    """The values of a string column as bytes, None for null."""
    return pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def one_task_each(spark: SparkSession, n: int) -> DataFrame:
    """Rows 0 to n-1, each in a partition of its own."""
    return spark.range(0, n, 1, max(1, n))


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` of the rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Ranges:
    """Consecutive ranges of a long key, cut by the keys' own weights, so equal tables are cut alike every time.

    lows: least key of each range but the first.  salts: parts of each range, more than one only where a single key weighs
    more than a part may.  nulls: parts of the rows without a key, which come first.  Parts are numbered from 0 in order.
    """

    def __init__(self, lows: list[int], salts: list[int], nulls: int):
        self.lows, self.salts, self.nulls = lows, salts, nulls
        self.first = np.cumsum([nulls, *salts])[:-1].tolist()
        self.count = nulls + sum(salts)

    def part(self, key: Column, salt: Column) -> Column:
        """The part of a row; salt: a hash (long) that deals the rows of a range with several parts."""
        lows, first, salts = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (self.lows or [0], self.first or [0], self.salts or [1]))
        n = len(self.lows)
        # Binary search: steps of falling powers of two, taken while the least key there isn't beyond this one.
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")
        place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(lows, at + step - 1) <= key), at + step).otherwise(at))
        dealt = F.transform(F.array(place), lambda at: F.get(first, at) + F.pmod(salt, F.get(salts, at)))[0]
        return F.when(key.isNull(), F.pmod(salt, F.lit(max(1, self.nulls)))).otherwise(dealt).cast("int")


def ranges(sizes: DataFrame, most: int, least_parts: int = 1) -> Ranges:
    """Ranges of the keys of sizes (key long, weight long; written before) of at most `most` weight each.

    There are about least_parts of them at least, if the keys allow.  The driver sees the weights of some four buckets of
    keys for each part, not of keys; buckets that are too heavy are divided further, down to single keys.
    """
    total, nulls, low, high = sizes.agg(F.sum("weight"), F.sum(F.when(F.col("key").isNull(), F.col("weight"))), F.min("key"), F.max("key")).first()
    limit = max(1, min(most, -(-(total or 0) // max(1, least_parts))))
    low, high = ((0 if x is None else x) + 2**63 for x in (low, high))
    shift, wide = 0, max(4096, 4 * -(-(total or 0) // limit))
    while (high >> shift) - (low >> shift) >= wide:
        shift += 1
    found, left = [], sizes.where("key is not null")
    while True:
        # Keys as unsigned numbers, without their last bits.
        bucket = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), shift)
        sums = [(r.bucket % 2**64, r.weight) for r in left.groupBy(bucket.alias("bucket")).agg(F.sum("weight").alias("weight")).toLocalIterator()]
        found += [(b << shift, w) for b, w in sums if w <= limit or not shift]
        heavy = [b for b, w in sums if w > limit and shift]
        if not heavy:
            break
        wanted = sizes.sparkSession.createDataFrame([(b - 2**64 if b >= 2**63 else b,) for b in heavy], "heavy long")
        left, shift = left.join(wanted, bucket == F.col("heavy"), "left_semi"), max(0, shift - 12)
    lows, salts, held = [], [], limit + 1
    for at, w in sorted(found):
        if held + w > limit:
            lows.append(at - 2**63)
            salts.append(max(1, -(-w // limit)))
            held = 0
        held += w
    return Ranges(lows[1:], salts, -(-(nulls or 0) // limit))
