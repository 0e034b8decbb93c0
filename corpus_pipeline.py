"""A corpus pipeline over documents: toxicity, language, near duplicates, benchmark leaks, mixing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever these are called: operators
get them as one column.

Null text counts as empty: it is not toxic, but of no language, so the second stage rejects it, and so it does texts without a letter. Of rows that share a doc_id
the third stage keeps one (the least by a hash of its text), and none where the id's document is a near copy of one with a smaller id; rows with a null id are kept
there as they can't be named, and drawn by their text in the last stage. Equal texts (ties) are settled by the smaller id. Very long texts are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail.llm import decontaminate, langid, minhash, mixing, toxicity
from calltrail.llm.shared import apart, shared_dir, small_batches, written

LEAST_LANGUAGE_SCORE = 0.1
#: A mixture has no oracle: two classifiers, a sketch and a latent space come before it.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the ids; counted first, and broadcast only where they are few."""
    return docs.join(minhash.if_small(ids.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def _once(docs: DataFrame) -> DataFrame:
    """One row of each doc_id; only rows of ids that occur more than once are moved."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = written(again, "repeated")
    if again.isEmpty():
        return docs
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return docs.join(again, "doc_id", "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _once(_without(docs, minhash.near_duplicates(docs.select("doc_id", "text")).where("NOT kept")))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _without(docs, decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled rows with topic and probability; columns of documents that are called so get the ending _in."""
    small_batches(spark)
    kept = mixing.mix(docs).where("kept")
    names = [c for c in kept.columns if c not in ("_mix", "probability", "kept")]
    out = apart(kept.select(*names), ("topic",)).columns
    return kept.select(*[F.col(a).alias(b) for a, b in zip(names, out, strict=True)], F.col("_mix.topic").alias("topic"), "probability")


STAGES = [("toxicity", toxic), ("language", language), ("near_duplicates", near_duplicates), ("leaks", leaks), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
