"""Versioned JSON documents: one file with a schema name and sections of rows, read back with tolerant getters.

Writing: rows become text in parallel, in order, and the parts are joined as a stream. Reading: a document is one value (so it is under 2 GB; larger results stay
tables), parsed once into a VARIANT; sections are exploded into rows. A document of another schema or version is refused. A getter
gives its default where a field is missing or of another kind, and never casts: a number is no string and a string no number, but ids may be either.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail import tables
from calltrail.sources.traces import InputError


def write_document(sections: dict[str, DataFrame], schema: str, path: str) -> None:
    """{"schema": schema, name: [rows], ...} as one file at path; a section's rows in the order of their text, nulls left out."""
    spark = next(iter(sections.values())).sparkSession
    parts = f"{tables.shared_dir(spark)}/document-{uuid.uuid4().hex}"
    rows = None
    for k, (name, df) in enumerate(sections.items()):
        text = F.to_json(F.struct(*df.columns)) if df.columns else F.lit("{}")
        lines = df.select(F.lit(k).alias("k"), F.lit(1).alias("place"), text.alias("text"))
        head = spark.range(1).select(F.lit(k).alias("k"), F.lit(0).alias("place"), F.lit(f',"{name}":[').alias("text"))
        tail = spark.range(1).select(F.lit(k).alias("k"), F.lit(2).alias("place"), F.lit("]").alias("text"))
        part = head.unionByName(lines).unionByName(tail)
        rows = part if rows is None else rows.unionByName(part)
    rows = tables.stored(rows)
    ordered = rows.repartitionByRange("k", "place", "text").sortWithinPartitions("k", "place", "text")
    placed = tables.stored(ordered.withColumn("at", F.monotonically_increasing_id()))
    # commas go before all rows of a section but its first
    opens = placed.where("place = 1").groupBy("k").agg(F.min("at").alias("opens"))
    text = F.when((F.col("place") == 1) & (F.col("at") > F.col("opens")), F.concat(F.lit(","), "text")).otherwise(F.col("text"))
    body = placed.join(F.broadcast(opens), "k", "left").repartitionByRange("at").sortWithinPartitions("at").select(text.alias("text"))  # a row per section
    for k, part in enumerate((spark.createDataFrame([(f'{{"schema":"{schema}"',)], "text string").coalesce(1), body, spark.createDataFrame([("}",)], "text string").coalesce(1))):
        part.write.text(f"{parts}/{k}")
    tables.merge(spark, [f"{parts}/{k}" for k in range(3)], path)
    tables.delete(spark, parts)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row, doc (VARIANT), of a document of this schema; InputError where there is none, it is no object, or it is of another schema."""
    try:
        found = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
        has = found.select(string_of("doc", "schema").alias("schema")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        has = None
    if has is None:
        raise InputError(f"{path}: no document")
    if has["schema"] != schema:
        raise InputError(f"{path}: schema {has['schema']!r}, not {schema!r}")
    return found


def section(document: DataFrame, name: str) -> DataFrame:
    """row (VARIANT) for each element of a section, in order (place); none where there is no such array."""
    items = F.when(F.startswith(_kind("doc", name), F.lit("ARRAY")), F.try_variant_get("doc", f"$.{name}", "array<variant>"))
    return document.select(F.posexplode(items).alias("place", "row"))


def _at(of: str, name: str) -> Column:
    return F.try_variant_get(F.col(of), f"$.{name}", "variant")


def _kind(of: str, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(_at(of, name)), F.lit("VOID"))


def string_of(of: str, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.when(_kind(of, name) == "STRING", F.try_variant_get(F.col(of), f"$.{name}", "string")), F.lit(default).cast("string"))


def long_of(of: str, name: str, default: int | None = None) -> Column:
    return F.coalesce(F.when(_kind(of, name) == "BIGINT", F.try_variant_get(F.col(of), f"$.{name}", "long")), F.lit(default).cast("long"))


def bool_of(of: str, name: str) -> Column:
    return (_kind(of, name) == "BOOLEAN") & F.coalesce(F.try_variant_get(F.col(of), f"$.{name}", "boolean"), F.lit(False))


def strings_of(of: str, name: str) -> Column:
    """The strings of an array; an empty array for anything else."""
    return F.coalesce(F.when(_kind(of, name) == "ARRAY<STRING>", F.try_variant_get(F.col(of), f"$.{name}", "array<string>")), F.array().cast("array<string>"))


def id_of(of: str, name: str) -> Column:
    """An id that some writers give as a number and others as text; null for anything else."""
    return F.when(_kind(of, name).isin("BIGINT", "STRING"), F.expr(f"try_cast(try_variant_get({of}, '$.{name}', 'string') AS BIGINT)"))
