"""File trees listed and read in tasks.

A walk goes by rounds: a task takes a folder, lists it and what lies below it until it has seen so many entries, and hands
back the folders it has not come to; the next round deals those over the tasks.  Excluded and hidden folders are never
listed.  What cannot be listed or read becomes a row with an error, never an exception; files are hashed in pieces and
opened once more for their text, so memory doesn't grow with their size.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from . import extract as E

#: Entries that a task lists before it hands folders back.
MOST_ENTRIES = 20_000
#: Bytes and files that one task reads, about.
TASK_BYTES, TASK_FILES = 256 << 20, 2_000
LISTED = "root_ord int, source_root string, path string, size long, modified double, error string"
READ = "path string, content_hash string, text string, extraction_status string"


def local(path: str) -> str | None:
    """The path on the local file system, None for one of another."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _said(e: BaseException) -> str:
    return str(e) or type(e).__name__


def _entries(folder: str) -> Iterator[tuple[str, bool, int | None, float | None, str | None]]:
    """(name, whether it is a folder, size, time of change, error) of what lies in a folder; other kinds are left out."""
    here = local(folder)
    if here is not None:
        with os.scandir(here) as found:
            for x in found:
                try:
                    if x.is_dir():
                        x.name.encode()
                        if not x.is_symlink():
                            yield x.name, True, None, None, None
                    elif x.is_file():
                        stat = x.stat()
                        x.name.encode()
                        yield x.name, False, stat.st_size, stat.st_mtime, None
                except OSError as e:
                    yield x.name, False, None, None, f"stat failed: {_said(e)}"
                except UnicodeEncodeError:
                    yield x.name.encode("utf-8", "replace").decode(), False, None, None, "stat failed: the name is not UTF-8"
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    for x in store.get_file_info(fs.FileSelector(path)):
        if x.type in (fs.FileType.Directory, fs.FileType.File):
            yield x.base_name, x.type == fs.FileType.Directory, x.size, x.mtime_ns / 1e9 if x.mtime_ns is not None else None, None


def opened(path: str) -> BinaryIO:
    """A file, open for reading."""
    here = local(path)
    if here is not None:
        return open(here, "rb")  # noqa: SIM115  the caller closes it
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _accepted(name: str) -> bool:
    return not name.startswith(".") and os.path.splitext(name)[1].lower() not in E.NOISE


def _listing(folder: str, excluded: frozenset[str], most: int) -> tuple[list[tuple], list[str]]:
    """Files (path, size, time, error) in and below a folder, as far as `most` entries go, and the folders not listed."""
    files, waiting, seen = [], [folder], 0
    while waiting and seen < most:
        at = waiting.pop()
        try:
            for name, is_folder, size, modified, error in _entries(at):
                seen += 1
                path = f"{at.rstrip('/')}/{name}"
                if name.startswith(".") or path in excluded:
                    continue
                if is_folder:
                    waiting.append(path)
                elif _accepted(name):
                    files.append((path, size, modified, error))
        except OSError as e:
            files.append((at, None, None, f"folder not read: {_said(e)}"))
    return files, waiting


def walked(spark: SparkSession, roots: list[str], excluded: list[str], most_entries: int | None = None) -> DataFrame:
    """root_ord, source_root, path, size, modified (seconds), error of the files to read below some roots.

    Hidden names, noise suffixes, links to folders and excluded subtrees are left out.  A folder or file that cannot be
    looked at has an error and no size.  A root that lies below another one is listed with both.
    """
    out = frozenset(x.rstrip("/") for x in excluded)
    most = MOST_ENTRIES if most_entries is None else most_entries

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for order, root, folder in zip(*(batch.column(c).to_pylist() for c in ("root_ord", "source_root", "folder")), strict=True):
                files, left = _listing(folder, out, most)
                rows = [(order, root, None, *f) for f in files] + [(order, root, x, None, None, None, None) for x in left]
                for low in range(0, len(rows), 4096):
                    columns = list(zip(*rows[low : low + 4096], strict=True))
                    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["root_ord", "source_root", "folder", "path", "size", "modified", "error"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    waiting = spark.createDataFrame([(k, r.rstrip("/") or "/", r.rstrip("/") or "/") for k, r in enumerate(roots) if r.rstrip("/") not in out], "root_ord int, source_root string, folder string")
    found = []
    while True:
        rows = written(waiting.repartition(tasks, "folder").mapInArrow(step, "root_ord int, source_root string, folder string, path string, size long, modified double, error string"), "walk")
        found.append(rows.where("path is not null").drop("folder"))
        waiting = rows.where("path is null").select("root_ord", "source_root", "folder")
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, found)


def unreadable_hash(path: str, size: int, modified: float) -> str:
    """What stands for the hash of a file that cannot be read."""
    return "unreadable:" + hashlib.sha256(f"unreadable\0{path}\0{size}\0{modified}".encode()).hexdigest()


def _one(path: str, size: int, modified: float) -> tuple[str, str, str]:
    """(hash, text, status) of a file."""
    try:
        with opened(path) as f:
            digest = hashlib.sha256()
            while piece := f.read(1 << 20):
                digest.update(piece)
            f.seek(0)
            return (digest.hexdigest(), *E.extract(path, f))
    except OSError as e:
        return unreadable_hash(path, size, modified), "", f"error: file read failed: {_said(e)}"


def read(listing: DataFrame) -> DataFrame:
    """path, content_hash, text, extraction_status of listed files (path, size, modified).

    A file that is gone, locked or broken has the hash that stands for one, no text, and a status that says what went wrong.
    The files are dealt over as many tasks as their sizes and number ask for.
    """
    n, size = listing.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(listing.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES), -(-n // TASK_FILES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for path, length, modified in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "modified")), strict=True):
                held.append((path, *_one(path, length, modified)))
                size += len(held[-1][2])
                if size > 8 << 20 or len(held) == 256:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)

    return listing.select("path", "size", "modified").repartition(tasks, "path").mapInArrow(run, READ)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], ["path", "content_hash", "text", "extraction_status"])


def put(rows: DataFrame, folder: str) -> int:
    """Writes each of rows (name, text) as a file below a folder, in tasks; how many there are.

    A name that is there is written over; a null text makes an empty file.  A repeated attempt writes the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        made: set[str] = set()
        here = local(folder)
        store, top = (fs.LocalFileSystem(), here) if here is not None else fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                path = f"{top.rstrip('/')}/{name}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(path, compression=None) as out:
                    out.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select("name", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
