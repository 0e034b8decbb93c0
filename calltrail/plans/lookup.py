"""Questions to a stored analysis. Every one of them refuses when the analysis was refused or is not there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail.operators import tree

MAX_LISTED, MAX_OBSERVATIONS = 50, 5


class NotAnalyzed(RuntimeError):
    """There is no analysis to ask; this is not a clean result."""


class Run:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def status(self) -> dict:
        try:
            row = self.spark.read.schema("status string, exit_code int").json(f"{self.path}/status").first()
        except AnalysisException:
            row = None
        return {"status": "unknown"} if row is None else row.asDict()

    def refusals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/refusals")

    def _table(self, name: str) -> DataFrame:
        status = self.status()["status"]
        if status != "analyzed":
            raise NotAnalyzed(f"the run is {status}: not a clean result")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def list_divergences(self, category: str = "unexpected", limit: int | None = None) -> DataFrame:
        """Members of a category (or all), most call sites first, with the totals they were taken from."""
        m = self._table("members")
        if category.lower() != "all":
            m = m.where(F.col("attribution") == category.lower())
        n = min(MAX_LISTED if limit is None else limit, MAX_LISTED)
        totals = m.agg(F.count("*").alias("total_members"), F.coalesce(F.sum("call_sites"), F.lit(0)).alias("total_call_sites"))
        return m.orderBy(F.desc("call_sites"), "method").limit(n).crossJoin(totals).withColumn("truncated", F.col("total_members") > n)  # one row of totals

    def get_divergence(self, member: str) -> DataFrame:
        """The member with its first observations and whether there are more; each task hands on its first few only."""
        shown = ("test_id", "ordinal", "kind", "detail", "base_args", "base_return", "pr_return", "assertion_reacted")
        of = self._table("evidence").where(F.col("method") == member)
        first = of.orderBy(*shown).limit(MAX_OBSERVATIONS + 1)  # a top-k: no sort of all of them
        ev = first.groupBy("method").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("e"))
        return self._table("members").where(F.col("method") == member).join(ev, "method", "left").withColumns({"evidence": F.slice("e", 1, MAX_OBSERVATIONS), "evidence_truncated": F.size("e") > MAX_OBSERVATIONS}).drop("e")

    def get_call_path(self, member: str) -> DataFrame:
        """The base run's path of a member's first call, changed or not; no rows where the base never called it."""
        calls = self._table("call_tree")
        first = calls.where(F.col("method") == member).orderBy("test_id", "ordinal", "process", "line_number").limit(1)
        paths = tree.call_paths(calls, first)
        return paths.join(first.select(*tree.CALL, "test_id"), tree.CALL).select(F.lit(member).alias("method"), "test_id", F.posexplode("path").alias("depth", "node")).select("method", "test_id", "depth", "node.*")

    def get_untested_divergences(self) -> DataFrame:
        return self._table("members").where("untested_call_sites > 0").orderBy(F.desc("untested_call_sites"), "method").limit(MAX_LISTED)
