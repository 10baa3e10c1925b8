"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_local: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_folders: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, under one folder for each application.

    Where the setting is absent a temporary folder serves a local master; any other master is refused, since its executors
    would each write to a disk of their own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc not in _local:
            _local[sc] = "file://" + tempfile.mkdtemp(prefix="scriptorium-shared-")
        base = _local[sc]
    return f"{base.rstrip('/')}/scriptorium-{sc.applicationId}/{label}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back: lineage ends there.

    What was shuffled to make them is of no more use, so Spark is told to delete it at once and not when the driver
    happens to collect its garbage.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, label)
    with settings(spark, {_CLEANUP: "true"}):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing will read any more; others are left alone."""
    for t in tables:
        path = _folders.pop(t, None)
        if path is not None:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def stamps(spark: SparkSession, df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """(name, size, time of change) of the files that a table is read from: what tells its versions apart."""
    conf, out = spark._jsparkSession.sessionState().newHadoopConf(), []
    for name in sorted(df.inputFiles()):
        where = _path(spark, name)
        status = where.getFileSystem(conf).getFileStatus(where)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file if there is none of its name, whole or not at all; False if there is one.

    Of several writers, on whatever machines, one succeeds: a link on a local file system, a rename that doesn't overwrite
    on another.
    """
    jvm, where, fresh = spark._jvm, _path(spark, path), _path(spark, f"{path}-{uuid.uuid4().hex}")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    store = where.getFileSystem(conf)
    store.mkdirs(where.getParent())
    out = store.create(fresh)
    out.write(text.encode())
    out.close()
    target = store.makeQualified(where).toUri()
    try:
        if target.getScheme() == "file":
            os.link(store.makeQualified(fresh).toUri().getPath(), target.getPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target, conf).rename(fresh, where, options)
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        store.delete(fresh, False)
    return True


def latest(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and text of the newest version in a folder of versions; (0, None) if there is none."""
    where = _path(spark, folder)
    store = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []
    number = max((int(n) for n in names if re.fullmatch(r"\d{9}", n)), default=0)
    if not number:
        return 0, None
    stream = store.open(_path(spark, f"{folder}/{number:09d}"))
    try:
        return number, bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def committed(spark: SparkSession, folder: str, change: Callable[[int, str | None], str | None], tries: int = 100) -> int:
    """The number of the version that change(number, text of the newest version) gives; None from it commits nothing.

    If another writer was first, the change is made once more, from what that one wrote: nothing is lost, and each version
    is the last one with one change.
    """
    for _ in range(tries):
        number, text = latest(spark, folder)
        new = change(number, text)
        if new is None or put_if_absent(spark, f"{folder}/{number + 1:09d}", new):
            return number + (new is not None)
    raise RuntimeError(f"no commit to {folder} in {tries} tries")
