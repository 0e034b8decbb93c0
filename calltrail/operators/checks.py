"""Checks that refuse: manifest and ordinal accounting, volume, conformance of two runs. Each gives rows; none of them means passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.functions import scalars as S
from calltrail.operators.keys import KEY

# Fixed limits of the comparison.
MIN_MATCHED_KEYS = 100
MAX_BASE_DRIFT_PERCENT = 10.0
MAX_NOISE_PERCENT = 20.0
MIN_PATH_OVERLAP_PERCENT = 50.0
REFUSAL = "code string, message string, observed double, required double"


def manifest_violations(members: DataFrame, modules: DataFrame, writers: DataFrame, records: DataFrame) -> DataFrame:
    """(run, process, code, detail): modules whose member records or sums do not add up, writers that lost or miscounted records."""
    counted = members.groupBy("run", "process", "assembly").agg(F.count("*").alias("records"))
    m = modules.join(counted, ["run", "process", "assembly"], "left").withColumn("records", F.coalesce("records", F.lit(0)))
    parts = F.col("patchedMembers") + F.col("skippedMembers") + F.col("patchFailedMembers")
    unbalanced = m.where(F.col("discoveredMembers") != parts).select("run", "process", F.lit("MODULE_SUM").alias("code"), F.format_string("%s: discovered %d, accounted %d", "assembly", "discoveredMembers", parts).alias("detail"))
    missing = m.where(F.coalesce("scanned", F.lit(True)) & (F.col("records") != F.col("discoveredMembers"))).select("run", "process", F.lit("MODULE_RECORDS").alias("code"), F.format_string("%s: discovered %d, records %d", "assembly", "discoveredMembers", "records").alias("detail"))
    w = writers.join(records, ["run", "process"], "left").withColumn("records", F.coalesce("records", F.lit(0)))
    lost = w.where("dropped <> 0 OR enqueued <> written OR written <> records").select("run", "process", F.lit("WRITER").alias("code"), F.format_string("enqueued %d, written %d, dropped %d, records %d", "enqueued", "written", "dropped", "records").alias("detail"))
    return unbalanced.unionByName(missing).unionByName(lost)


def volume(events: DataFrame, matched: DataFrame, noise: DataFrame, base1: str = "base1", base2: str = "base2", pr: str = "pr") -> DataFrame:
    """One row of measures: subject events of three runs, drift, matched keys, noise share, path overlap."""
    s = events.where("NOT is_harness")
    per = s.agg(*[F.count_if(F.col("run") == r).alias(n) for r, n in ((base1, "base1_events"), (base2, "base2_events"), (pr, "pr_events"))])
    sides = s.where(F.col("relative_path").isNotNull()).groupBy("relative_path").agg(F.bool_or(F.col("run") == base1).alias("b"), F.bool_or(F.col("run") == pr).alias("p"))
    paths = sides.agg(F.count_if("b").alias("base_paths"), F.count_if(F.col("b") & F.col("p")).alias("shared_paths"))
    n = matched.agg(F.count("*").alias("matched_keys")).crossJoin(noise.agg(F.count("*").alias("noise_keys")))  # one row each
    one = per.crossJoin(paths).crossJoin(n)
    drift = S.share_percent(F.abs(F.col("base1_events") - F.col("base2_events")), F.col("base1_events"), 100)
    return one.withColumns({"drift_percent": F.round(drift, 4), "noise_percent": F.round(S.share_percent(F.col("noise_keys"), F.col("matched_keys"), 100), 4), "overlap_percent": F.round(S.share_percent(F.col("shared_paths"), F.col("base_paths"), 0), 4)})


def volume_refusals(measures: DataFrame) -> DataFrame:
    """(code, message, observed, required) for every limit that the measures break; all are reported together."""
    rule = lambda code, message, observed, required, broken: F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), observed.cast("double").alias("observed"), F.lit(float(required)).alias("required")))
    c = F.col
    rules = [rule("VOLUME_EMPTY", f"{n} has zero subject events", c(n), 1, c(n) == 0) for n in ("base1_events", "base2_events", "pr_events")]
    rules += [
        rule("VOLUME_DRIFT", "the two base runs differ too much in subject events", c("drift_percent"), MAX_BASE_DRIFT_PERCENT, c("drift_percent") > MAX_BASE_DRIFT_PERCENT),
        rule("VOLUME_MATCHED", "too few matched keys for a clean result to mean anything", c("matched_keys"), MIN_MATCHED_KEYS, c("matched_keys") < MIN_MATCHED_KEYS),
        rule("VOLUME_NOISE", "the noise exclusions cover too many keys", c("noise_percent"), MAX_NOISE_PERCENT, c("noise_percent") > MAX_NOISE_PERCENT),
        rule("VOLUME_OVERLAP", "the runs share too few source paths", c("overlap_percent"), MIN_PATH_OVERLAP_PERCENT, c("overlap_percent") < MIN_PATH_OVERLAP_PERCENT),
    ]
    return measures.select(F.explode(F.array_compact(F.array(*rules))).alias("r")).select("r.*")


def input_refusals(load: DataFrame) -> DataFrame:
    """Of a load report (run, language, malformed, still_absolute): malformed lines, absolute paths, unlike languages."""
    bad = load.where("malformed > 0").select(F.lit("MALFORMED").alias("code"), F.concat(F.lit("malformed lines in "), "run").alias("message"), F.col("malformed").cast("double").alias("observed"), F.lit(0.0).alias("required"))
    paths = load.where("still_absolute > 0").select(F.lit("ABSOLUTE_PATHS").alias("code"), F.concat(F.lit("paths outside the root in "), "run").alias("message"), F.col("still_absolute").cast("double").alias("observed"), F.lit(0.0).alias("required"))
    languages = load.agg(F.count_distinct("language").alias("n")).where("n > 1").select(F.lit("LANGUAGES").alias("code"), F.lit("runs of different languages cannot be compared").alias("message"), F.col("n").cast("double").alias("observed"), F.lit(1.0).alias("required"))
    return bad.unionByName(paths).unionByName(languages)


def labelled_share(events: DataFrame) -> DataFrame:
    """events, labelled, share_percent of events that belong to a test; under 50 % a run is refused."""
    one = events.agg(F.count("*").alias("events"), F.count_if(F.col("test_id") != "(no-test)").alias("labelled"))
    return one.withColumn("share_percent", F.round(S.share_percent(F.col("labelled"), F.col("events"), 0), 4))


def conformance(left: DataFrame, right: DataFrame, min_keys: int = 100) -> DataFrame:
    """(guard, failures) of two runs of the same build; all zero means conformant."""
    subj = lambda df: df.where("NOT is_harness")
    # ordinals of a key are alike if each occurs as often on both sides: counts per (key, ordinal), then per key
    rows = subj(left).select(*KEY, "ordinal", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(subj(right).select(*KEY, "ordinal", F.lit(0).alias("l"), F.lit(1).alias("r")))
    per = rows.groupBy(*KEY, "ordinal").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).groupBy(*KEY).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.bool_or(F.col("l") != F.col("r")).alias("unlike"))
    keys = per.agg(
        F.greatest(F.lit(0), F.lit(min_keys) - F.count_if((F.col("l") > 0) & (F.col("r") > 0))).alias("matched_key_floor"),
        F.count_if(F.col("l") != F.col("r")).alias("call_counts"), F.count_if("unlike").alias("ordinal_sequences"),
    )
    methods = subj(left).select("method").distinct().withColumn("l", F.lit(1)).join(subj(right).select("method").distinct().withColumn("r", F.lit(1)), "method", "full_outer").agg(F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("method_set"))
    source = subj(left).agg(F.count_if(~F.coalesce(F.col("resolution").isin(*S.USABLE_RESOLUTIONS), F.lit(False))).alias("unusable_source"))
    wide = keys.crossJoin(methods).crossJoin(source)  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("guard"), F.col(c).cast("long").alias("failures")) for c in wide.columns])).alias("g")).select("g.*")
