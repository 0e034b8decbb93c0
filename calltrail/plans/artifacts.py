"""Stored results of an analysis: a table per section; a refused result has no members."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail.operators import findings, keys, manifests
from calltrail.plans.analysis import Analysis
from calltrail.sources import documents


SECTIONS = ("nodes", "members", "evidence", "consequences", "coverage", "call_tree", "known_members", "skip_reasons")


def store(result: Analysis, path: str, spark: SparkSession, sections: tuple[str, ...] | None = None) -> None:
    """All of a result, or only those sections of an analyzed one that will be asked for; a section is always whole."""
    status = spark.createDataFrame([(result.status, result.exit_code)], "status string, exit_code int")
    spark.createDataFrame(result.refusals, "code string, message string, observed double, required double").write.mode("overwrite").parquet(f"{path}/refusals")
    if result.divergences is not None:
        spark.createDataFrame(result.divergences.step_counts(), "step string, rows long").write.mode("overwrite").parquet(f"{path}/steps")
    if result.status == "analyzed":
        for name in SECTIONS if sections is None else sections:
            getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
    if result.status == "analyzed" and sections is None:
        d = result.divergences
        parts = {"divergences": d.remaining, "harness_divergences": d.harness, "matched_keys": d.matched, "noise_keys": d.noise, "noise_histogram": keys.noise_histogram(d.noise), "gaps": d.gaps, "gaps_by_scope": manifests.gaps_by_scope(d.gaps), "manifest_noise": d.manifest_noise, "measures": d.measures}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{name}")
        counts = result.nodes.groupBy("classification", "attribution").agg(F.count("*").alias("nodes"), F.count_distinct("method").alias("members"))
        counts.write.mode("overwrite").json(f"{path}/frontier_counts")
        findings.summary(result.members).write.mode("overwrite").json(f"{path}/summary")
    status.write.mode("overwrite").json(f"{path}/status")  # last: it says that the rest is there


def as_json(members: DataFrame) -> DataFrame:
    """One JSON document per member, nulls left out."""
    return members.select(F.to_json(F.struct(*members.columns)).alias("value"))


FINDINGS = "calltrail.findings/1"


def export(spark: SparkSession, stored: str, path: str) -> None:
    """A stored analysis' findings as one versioned JSON document, for tools that read files."""
    names = ("status", "summary", "members", "evidence", "consequences", "coverage", "refusals")
    sections = {}
    for name in names:
        try:
            sections[name] = spark.read.json(f"{stored}/{name}") if name in ("status", "summary") else spark.read.parquet(f"{stored}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    documents.write_document(sections, FINDINGS, path)


def imported(spark: SparkSession, path: str) -> DataFrame:
    """The members of an exported document; a field that is missing or of another kind is its default."""
    row = documents.section(documents.read_document(spark, path, FINDINGS), "members")
    text = lambda name: documents.string_of("row", name, "").alias(name)
    count = lambda name: documents.long_of("row", name, 0).alias(name)
    return row.select(
        text("method"), text("attribution"), documents.string_of("row", "file_path").alias("file_path"), documents.long_of("row", "line").alias("line"), count("call_sites"), count("executing_tests"), count("observing_tests"), count("reacting_tests"),
        documents.bool_of("row", "verified").alias("verified"), documents.strings_of("row", "symptoms").alias("symptoms"), documents.strings_of("row", "reasons").alias("reasons"), count("untested_call_sites"),
    )
