"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from calltrail import tables


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name in the folder that driver and executors share; an open tables.scratch deletes it."""
    return tables.made(f"{tables.shared_dir(spark)}/calltrail-{uuid.uuid4().hex}")


@contextlib.contextmanager
def without_leftovers(spark: SparkSession):
    """Writes inside it drop their shuffle files when they are done: nothing reads them once the table is there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    with without_leftovers(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs with columns that are called like one of names (whatever the case) renamed to name_in, name_in_in, ..."""
    taken = {c.lower() for c in docs.columns} | set(names)
    out = []
    for c in docs.columns:
        new = c
        if c.lower() in names:
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
        out.append(new)
    return docs.toDF(*out)


#: Rows and bytes of an Arrow batch: with long texts, ten thousand rows would be very large.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on Arrow batches to those of BATCH where they are higher; what a task holds then follows its largest row."""
    for name, most in BATCH.items():
        now = int(spark.conf.get(name).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def trim() -> None:
    """Gives memory that a worker has freed back to the machine; workers live long and run many stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made of them stays small too."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    trim()
