"""Token-id output: one concatenated id array a shard, document boundaries in Elias-Fano code.

A shard file holds, in this order: ``TOKSHRD1``; the ids, 2 bytes each where all ids fit, else 4; the code of the
boundaries (one more than documents, from 0); the code of the document ids; a footer as JSON; its length; ``TOKSHRD1``.
Documents stand in ascending order of doc_id, through the shards and inside each; documents without an id come first.

Plan: lengths of texts by doc_id first, which cut the ids into ranges of bounded size whatever the corpus; then one shuffle
of the texts by range (a repeated id that is too heavy for one range is dealt over several by its texts' hash) and one
task a shard.  Cuts depend on the rows alone, so equal tables give equal files.  The driver sees one small row a shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import eliasfano
from ._common import CommittedFile, dropped, file_system, one_task_each, prepare, ranges, shuffle_partitions, written
from .tokens import encoder

MAGIC = b"TOKSHRD1"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, shards: int | None = None, shard_bytes: int = 256 << 20) -> list[dict]:
    """Encode docs (doc_id long, text string) and write shard files into folder; returns the manifest, a row a shard.

    vocabulary: path of the tokenizer file.  end_id: appended to each document.  shard_bytes: bytes of text in a shard, at most
    (but for texts that are longer alone, or many rows with the same id and text).  shards: how many there are at least, if
    ids allow (the number of shuffle partitions where not given).  A null or empty text gives the end id alone; rows with
    equal ids are all kept; other columns are ignored; an empty table gives no shard.  The manifest is also written as
    ``manifest.json``, last, so a folder without one is incomplete.
    """
    spark = docs.sparkSession
    prepare(spark)
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sizes = written(wide.select(F.col("doc_id").alias("key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("weight")), "sizes")
    cut = ranges(sizes, shard_bytes, shards or shuffle_partitions(spark))
    hashed = wide.withColumn("hash", F.xxhash64("text")).withColumn("part", cut.part(F.col("doc_id"), F.col("hash")))
    dealt = hashed.repartitionById(max(1, cut.count), "part").sortWithinPartitions("part", "doc_id", "hash").drop("hash")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(vocabulary)
        kind = "<u2" if max(use.vocabulary_size() - 1, end_id) < 2**16 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        out, name, number, sizes, ids = None, "", -1, [], []

        def finished() -> pa.RecordBatch:
            nulls = sum(x is None for x in ids)
            bounds = eliasfano.encode(np.concatenate([[0], np.cumsum(sizes)]))
            names = eliasfano.encode(np.array(ids[nulls:], np.int64))
            footer = json.dumps({"documents": len(ids), "nulls": nulls, "tokens": sum(sizes), "kind": kind, "bounds": len(bounds), "names": len(names)}).encode()
            out.write(bounds + names + footer + len(footer).to_bytes(4, "little") + MAGIC)
            out.commit()
            return pa.RecordBatch.from_pydict({"shard": [number], "name": [name], "documents": [len(ids)], "tokens": [sum(sizes)]})

        try:
            for batch in batches:
                for part, doc, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    if part != number:
                        if out is not None:
                            yield finished()
                        number, name, sizes, ids = part, f"shard-{part:08d}.tok", [], []
                        out = CommittedFile(folder, name)
                        out.write(MAGIC)
                    found = use.encode(text.as_py()) + end
                    ids.append(doc)
                    sizes.append(len(found) // 4)
                    out.write(np.frombuffer(found, "<u4").astype(kind).tobytes())
            if out is not None:
                yield finished()
        except BaseException:
            if out is not None:
                out.abandon()
            raise

    manifest = sorted((r.asDict() for r in dealt.mapInArrow(shard, "shard long, name string, documents long, tokens long").collect()), key=lambda r: r["shard"])
    dropped(sizes)
    start = 0
    for row in manifest:
        row["start"] = start
        start += row["tokens"]
    last = CommittedFile(folder, "manifest.json")
    last.write(json.dumps(manifest).encode())
    last.commit()
    return manifest


class Shard:
    """Random access to a shard file: ``len``, ``doc_id(i)``, ``offset(i)``, ``ids(i)``."""

    def __init__(self, folder: str, name: str):
        fs, path = file_system(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{name} is no complete shard")
        n = int.from_bytes(tail[:4], "little")
        self.footer = json.loads(self.file.read_at(n, size - 12 - n))
        a, b = self.footer["bounds"], self.footer["names"]
        code = self.file.read_at(a + b, size - 12 - n - a - b)
        self.bounds, self.names, self.kind = eliasfano.Sequence(code[:a]), eliasfano.Sequence(code[a:]), np.dtype(self.footer["kind"])

    def __len__(self) -> int:
        return self.footer["documents"]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.footer["nulls"] else self.names.select(i - self.footer["nulls"])

    def offset(self, i: int) -> int:
        return self.bounds.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.offset(i), self.offset(i + 1)
        return np.frombuffer(self.file.read_at((b - a) * self.kind.itemsize, len(MAGIC) + a * self.kind.itemsize), self.kind)

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, offset, ids) of each document in order, reading the ids once from first to last."""
        bounds = self.bounds.values().tolist()
        names = [None] * self.footer["nulls"] + self.names.values().tolist()
        self.file.seek(len(MAGIC))
        for k, name in enumerate(names):
            yield name, bounds[k], np.frombuffer(self.file.read((bounds[k + 1] - bounds[k]) * self.kind.itemsize), self.kind)


def read(spark, folder: str, manifest: list[dict] | None = None, digest: bool = False) -> DataFrame:
    """The documents of a folder: doc_id, start (ids before it in all shards), n_tokens and its ids as unsigned 32-bit
    little-endian integers; with digest their unsigned crc32 as ids_crc32 instead.  A task for each shard."""
    prepare(spark)
    if manifest is None:
        fs, path = file_system(folder)
        manifest = json.loads(fs.open_input_file(f"{path}/manifest.json").read())
    column = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), column])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                held: list[tuple] = []
                weight = 0
                for doc, offset, ids in Shard(folder, manifest[k]["name"]).scan():
                    data = ids.astype("<u4").tobytes()
                    held.append((doc, manifest[k]["start"] + offset, len(ids), zlib.crc32(data) if digest else data))
                    weight += 32 if digest else len(data)
                    if weight > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema, strict=True)], schema=schema)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema, strict=True)], schema=schema)

    out = READ_SCHEMA.replace("ids binary", "ids_crc32 long") if digest else READ_SCHEMA
    if not manifest:
        return spark.createDataFrame([], out)
    return one_task_each(spark, len(manifest)).mapInArrow(rows, out)
