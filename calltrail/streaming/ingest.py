"""Continuous ingest of trace files into Parquet, an extension of the batch reader: one parse, micro-batches of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calltrail.sources.traces import parse_events


def stream_events(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """process, line_number (byte order within a file is not known to a stream: 0), raw, error and the event's columns of new files."""
    raw = spark.readStream.option("pathGlobFilter", "*.ndjson").option("maxFilesPerTrigger", max_files).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    raw = raw.where(~F.endswith("file", F.lit(".manifest.ndjson")) & (F.trim("value") != ""))
    return parse_events(raw.select(F.regexp_replace("file", r"\.ndjson$", "").alias("process"), F.lit(0).alias("line_number"), F.col("value").alias("raw")))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all lines, valid or not (error says why), to Parquet; exactly once by the checkpoint."""
    return stream_events(spark, path).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
