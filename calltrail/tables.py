"""Tables in the folder that driver and executors share: they cut lineage, survive lost executors, and go when their user says so."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_folders: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset and one machine does all the work."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.gettempdir(), "calltrail-shared").as_uri()
    return root.rstrip("/")


def made(path: str) -> str:
    """Says that a folder was made, so that an open scratch deletes it."""
    for folders in _folders:
        folders.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again."""
    spark = df.sparkSession
    path = made(f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """df as a table in the shared folder, dealt by a column into a bucket a shuffle partition: what is grouped by that column, alone or with others, is not moved again.

    The table has an entry in the session's catalog; an open scratch drops it with the folder.
    """
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    path = made(f"{shared_dir(spark)}/{name}")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(by).write.bucketBy(n, by).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were stored inside it when it ends; results that are to outlive it must be written before."""
    mine: list[str] = []
    _folders.append(mine)
    try:
        yield
    finally:
        _folders[:] = [f for f in _folders if f is not mine]
        for path in mine:
            if (name := path.rsplit("/", 1)[-1]).startswith("buckets_"):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(spark, path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """path with its file system's scheme, without an end slash."""
    fs, at = _fs(spark, path)
    return str(fs.makeQualified(at).toString()).rstrip("/")


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _fs(spark, old)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} could not be renamed to {new}")


def create_new(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False if there is one already."""
    fs, at = _fs(spark, path)
    fs.mkdirs(at.getParent())
    try:
        return fs.createNewFile(at)
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False


def age_seconds(spark: SparkSession, path: str) -> float | None:
    fs, at = _fs(spark, path)
    return time.time() - fs.getFileStatus(at).getModificationTime() / 1000 if fs.exists(at) else None


def children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(str(s.getPath()) for s in fs.listStatus(at)) if fs.exists(at) else []


def merge(spark: SparkSession, folders: list[str], to: str) -> None:
    """The files of folders, by name, as one file: a stream of bytes through this process, whatever their size."""
    target, place = _fs(spark, to)
    out = target.create(place, True)
    try:
        for path in (p for folder in folders for p in children(spark, folder)):
            if not path.rsplit("/", 1)[-1].startswith(("_", ".")):
                fs, at = _fs(spark, path)
                source = fs.open(at)
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
    finally:
        out.close()


def counted(df: DataFrame, **measures) -> tuple[DataFrame, Observation]:
    """df as a stored table, and what the pass that wrote it counted: rows and further aggregates."""
    seen = Observation()
    return stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in measures.items()])), seen
