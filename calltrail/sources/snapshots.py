"""Kept base runs that are committed whole: staging folder, exclusive lock, rename, pruning by age. All through Hadoop's file systems, so that any shared store will do.

A snapshot is a folder named by the hash of what it belongs to. It is written beside its place, its description last, and then renamed into place while its writer holds the
lock, a file that only one can create. So readers see the old snapshot, the new one or none, never a part of one; a writer that died leaves a staging folder and
a lock, which count as abandoned after ``lock_seconds``.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail import tables
from calltrail.sources import schema
from calltrail.sources.traces import InputError

SCHEMA = "trace-snapshot/1"
_ABOUT = "schema string, key string, runs string, created long"


class Busy(RuntimeError):
    """Another writer holds the lock of this snapshot."""


@dataclass
class Snapshots:
    spark: SparkSession
    root: str
    retention_seconds: int = 14 * 86_400
    lock_seconds: int = 6 * 3_600

    @staticmethod
    def key_of(**what: str) -> str:
        """A canonical text of what a snapshot belongs to, such as target, language, tracer version and scopes."""
        return json.dumps(what, sort_keys=True, ensure_ascii=False)

    def _folder(self, key: str) -> str:
        return f"{self.root.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    @contextlib.contextmanager
    def _locked(self, path: str) -> Iterator[None]:
        if not tables.create_new(self.spark, path):
            age = tables.age_seconds(self.spark, path)
            if age is None or age < self.lock_seconds or not tables.delete(self.spark, path) or not tables.create_new(self.spark, path):
                raise Busy(path)
        try:
            yield
        finally:
            tables.delete(self.spark, path)

    def store(self, key: str, events: DataFrame, runs: list[str]) -> str:
        """Commits the events of runs, all of which must be there; returns the folder."""
        final = self._folder(key)
        staging = f"{final}.tmp-{uuid.uuid4().hex}"
        with self._locked(f"{final}.lock"):
            try:
                events.write.partitionBy("run").parquet(staging)
                there = {r[0] for r in self.spark.read.parquet(staging).select(F.col("run").cast("string")).distinct().collect()}
                if missing := sorted(set(runs) - there):
                    raise InputError(f"an incomplete snapshot is not kept: no events of {', '.join(missing)}")
                about = self.spark.createDataFrame([(SCHEMA, key, ",".join(sorted(there)), int(time.time()))], _ABOUT)
                about.coalesce(1).write.json(f"{staging}/_about")
                tables.delete(self.spark, final)
                tables.rename(self.spark, staging, final)
            finally:
                tables.delete(self.spark, staging)
        return final

    def _about(self, folder: str):
        try:
            return self.spark.read.schema(_ABOUT).json(f"{folder}/_about").first()
        except AnalysisException:
            return None

    def find(self, key: str, runs: list[str] = ()) -> DataFrame | None:
        """The events of a snapshot of this key that is whole and not too old, else None."""
        folder = self._folder(key)
        about = self._about(folder)
        if about is None or about["schema"] != SCHEMA or about["key"] != key or about["created"] + self.retention_seconds <= time.time() or set(runs) - set(about["runs"].split(",")):
            return None
        return self.spark.read.parquet(folder).withColumn("run", F.col("run").cast("string")).select(*schema.EVENT.names)

    def prune(self) -> int:
        """Deletes snapshots past their age, and staging folders and locks that were left behind; returns how many."""
        gone = 0
        for path in tables.children(self.spark, self.root):
            name = path.rsplit("/", 1)[-1]
            if ".tmp-" in name or name.endswith(".lock"):
                old = (tables.age_seconds(self.spark, path) or 0) >= self.lock_seconds
            else:
                about = self._about(path)
                old = about is not None and about["created"] + self.retention_seconds <= time.time()
            gone += old and tables.delete(self.spark, path)
        return gone
