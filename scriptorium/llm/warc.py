"""A deterministic sharded WARC writer, and its reader.

Records are sorted by range of page_id; the ranges are cut by the pages' sizes alone (a page_id that repeats beyond one
range's size is dealt over several by its rows' hash), so equal tables give equal files.  Each task writes its range as
files that roll over once their compressed size passes a limit, one gzip member a record, so that a reader can start at
any record.  Headers and digests are made anew from the payload; record ids and dates are functions of the record alone.  A
file is written under a temporary name and moved into place, each task reports its files, and ``manifest.json`` comes last: a
folder without it is incomplete.

Of pages with equal payloads of at least `revisit_from` bytes the one with the least page_id is a response, the others are
revisits that refer to it by its record id, address and date.  Which those are is found on digests alone; the wide rows
are shuffled once, with the references sorted in before the pages that they concern.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CommittedFile, batches_of, dropped, file_system, one_task_each, prepare, ranges, shuffle_partitions, written

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, file string, file_offset long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """The id of a record: of its page, address and payload, and of how many equal rows came before it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {copy} {digest} {url}')}>"


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, copy: int = 0, original: tuple[int, str | None] | None = None) -> bytes:
    """One WARC 1.1 record, not compressed; original: page_id and url of the response that a revisit refers to."""
    digest, revisit = base32_sha1(payload), original is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, url, digest, copy)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _uri(url))] if url is not None else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        *([("X-Url-Json", json.dumps(url))] if url is not None else []),
    ]
    if original is not None:
        first, address = original
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first, address, digest, 0)), *([("WARC-Refers-To-Target-URI", _uri(address))] if address is not None else []), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(first))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    return gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: " + _record_id(None, name, "", 0).encode() + f"\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), 6, mtime=0)


def write(pages: DataFrame, folder: str, roll_bytes: int = 64 << 20, revisit_from: int = 0, tasks: int | None = None, task_bytes: int = 1 << 30) -> list[dict]:
    """Write pages (page_id long, url string, html string) as WARC files into folder; returns the manifest, a row a file.

    roll_bytes: compressed size at which a new file is begun.  tasks: ranges, at least (the number of shuffle partitions
    where not given).  task_bytes: html in a range, at most.  A null html is an empty payload.  Every row gives a record,
    repeated rows too; rows that repeat the least page_id of their payload are responses all, and revisits refer to the
    first of them by url.  Rows without page_id come first and are responses.  Other columns are ignored; an empty table
    gives a manifest without files.  Rows equal in page_id, url and html stay in one range.
    """
    spark = pages.sparkSession
    prepare(spark)
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    narrow = written(wide.select("page_id", "url", F.octet_length("html").cast("long").alias("n"), "digest"), "digests")
    cut = ranges(narrow.select(F.col("page_id").alias("key"), (F.col("n") + 500).alias("weight")), task_bytes, tasks or shuffle_partitions(spark))
    numbered = narrow.where((F.col("n") >= revisit_from) & F.col("page_id").isNotNull())
    repeated = written(numbered.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    refers = numbered.join(repeated, "digest").where("page_id > first.page_id").select("page_id", "url", F.lit(None).cast("binary").alias("html"), "digest", "first")
    both = wide.withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType)).union(refers)
    parts = both.withColumn("part", cut.part(F.col("page_id"), F.xxhash64("url", "digest")))
    dealt = parts.repartitionById(max(1, cut.count), "part").sortWithinPartitions("part", "page_id", "digest", F.col("first").isNull(), "url")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, name, size, count, rolled = -1, None, "", 0, 0, 0
        group, original, row, copy = None, None, None, 0

        def finished() -> pa.RecordBatch:
            out.commit()
            return pa.RecordBatch.from_pydict({"name": [name], "records": [count], "bytes": [size]})

        try:
            for batch in batches:
                for number, page_id, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("part", "page_id", "url", "html", "digest", "first")), strict=True):
                    if (number, page_id, digest) != group:
                        group, original = (number, page_id, digest), None
                    if first is not None:
                        original = (first["page_id"], first["url"])
                        continue
                    copy = copy + 1 if row == (group, url) else 0
                    row = (group, url)
                    if out is not None and (size >= roll_bytes or number != part):
                        yield finished()
                        out = None
                    if out is None:
                        rolled = rolled + 1 if number == part else 0
                        part, name = number, f"part-{number:08d}-{rolled:05d}.warc.gz"
                        out = CommittedFile(folder, name)
                        info = _info(name)
                        out.write(info)
                        size, count = len(info), 0
                    member = gzip.compress(record(page_id, url, html, copy, original), 6, mtime=0)
                    out.write(member)
                    size += len(member)
                    count += 1
            if out is not None:
                yield finished()
        except BaseException:
            if out is not None:
                out.abandon()
            raise

    manifest = sorted((r.asDict() for r in dealt.mapInArrow(task, "name string, records long, bytes long").collect()), key=lambda r: r["name"])
    dropped(narrow, repeated)
    last = CommittedFile(folder, "manifest.json")
    last.write(json.dumps(manifest).encode())
    last.commit()
    return manifest


class _Members:
    """The gzip members of a stream, each unpacked, with its place; holds one member and one block."""

    def __init__(self, stream, block: int = 1 << 18):
        self.stream, self.block, self.at = stream, block, 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        data, begin = b"", 0
        while True:
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                if not data:
                    data = self.stream.read(self.block)
                    if not data:
                        if parts:
                            raise ValueError("a member is cut off")
                        return
                n = len(data)
                parts.append(unpack.decompress(data))
                data = unpack.unused_data
                self.at += n - len(data)
            yield begin, b"".join(parts)
            begin = self.at


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, folder: str, manifest: list[dict] | None = None) -> DataFrame:
    """A row for each record of the archives in folder, columns as in READ.

    A response's length and digest are checked against its payload, a revisit's against those of the response that its
    WARC-Refers-To names; a record that fails, or refers to nothing, is an error.
    """
    prepare(spark)
    if manifest is None:
        fs, path = file_system(folder)
        manifest = json.loads(fs.open_input_file(f"{path}/manifest.json").read())
    names = [m["name"] for m in manifest]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("file", pa.string()), ("file_offset", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                fs, path = file_system(folder)
                with fs.open_input_stream(f"{path}/{names[k]}", compression=None) as stream:
                    for at, member in _Members(stream):
                        fields, block = parse(member)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != n or base32_sha1(payload) != digest:
                                raise ValueError(f"{names[k]}, {at}: the payload is not what its digest says")
                        page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page")
                        yield {"page_id": int(page) if page else None, "url": json.loads(fields["X-Url-Json"]) if "X-Url-Json" in fields else None, "payload_bytes": n, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None, "record_id": fields["WARC-Record-ID"], "refers_to_id": fields.get("WARC-Refers-To"), "file": names[k], "file_offset": at}

    if not names:
        return spark.createDataFrame([], READ)
    records = written(one_task_each(spark, len(names)).mapInArrow(lambda b: batches_of(rows(b), schema), READ), "records")
    responses, revisits = records.where("refers_to_id is null"), records.where("refers_to_id is not null")
    originals = responses.select(F.col("record_id").alias("refers_to_id"), F.struct("page_id", "payload_bytes", "payload_digest").alias("original"))
    found = revisits.join(originals.join(revisits.select("refers_to_id").distinct(), "refers_to_id", "left_semi"), "refers_to_id", "left")
    good = F.coalesce(F.col("original") == F.struct(F.col("refers_to").alias("page_id"), "payload_bytes", "payload_digest"), F.lit(False))
    checked = found.withColumn("payload_digest", F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.concat("record_id", F.lit(" refers to no such response")))))
    return responses.select(*schema.names).union(checked.select(*schema.names))
