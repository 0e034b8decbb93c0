"""Readers and writers of trace files, manifests and changed-file lists; strict parsing with line numbers."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calltrail import tables
from calltrail.functions import scalars as S
from calltrail.sources import schema
from calltrail.tables import stored

_CORRUPT = "_corrupt"
#: More splits than this are joined by an exchange.
MAX_BROADCAST_SPLITS = 100_000


class InputError(ValueError):
    """Input that cannot be analysed; raised instead of giving an empty result."""


def lines(spark: SparkSession, path: str, glob: str = "*.ndjson", skip_manifests: bool = True, by: str | None = None) -> DataFrame:
    """process (file stem, or what the pattern by finds in the path), line_number (from 1), raw of every line that is not blank; a line ends with a line feed, a carriage return or both.

    Files are read in splits, so one of any size is many tasks' work and no value is larger than a line. Lines are written once with the split they come from and their place in
    the reading task, as a second reading may be split otherwise. A line's number is its place in the split plus the lines of the file's earlier splits, whose
    counts are one row per split.
    """
    read = spark.read.option("pathGlobFilter", glob).text(path)
    each = read.select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    if skip_manifests:
        each = each.where(~F.endswith("name", F.lit(".manifest.ndjson")))
    each = stored(each)
    counts = each.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = stored(counts.select("file", "split", (before - F.col("first") + 1).alias("shift")))
    numbered = each.join(F.broadcast(splits) if splits.count() <= MAX_BROADCAST_SPLITS else splits, ["file", "split"])
    return numbered.where(F.trim("value") != "").select((F.regexp_extract("file", by, 1) if by else F.regexp_replace("name", r"(\.manifest)?\.ndjson$", "")).alias("process"), (F.col("at") + F.col("shift")).cast("int").alias("line_number"), F.col("value").alias("raw"))


def parse_events(raw: DataFrame) -> DataFrame:
    """Adds the event's columns and error (null: valid) to process, line_number, raw.

    Wrapped in an array a line with trailing content parses to more or fewer than one element; the plain parse reports type errors.
    """
    strict = T.StructType([*schema.WIRE_EVENT.fields, T.StructField(_CORRUPT, T.StringType())])
    one = F.from_json("raw", strict, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    whole = F.from_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    p = raw.withColumn("e", one).withColumn("w", F.size(F.coalesce(whole, F.array().cast("array<map<string,string>>"))))
    e = F.col("e")
    error = (
        F.when(~F.startswith(F.ltrim("raw"), F.lit("{")), "not an object").when(F.col("w") != 1, "trailing content or malformed JSON").when(e[_CORRUPT].isNotNull(), "malformed JSON or wrong type")
        .when(F.coalesce(e["testId"], F.lit("")) == "", "testId missing").when(F.coalesce(e["methodFullName"], F.lit("")) == "", "methodFullName missing")
        .when(e["callId"].isNull(), "callId missing").when(e["ordinal"].isNull() | (e["ordinal"] < 0), "ordinal missing or negative")
    )
    defaults = {"resolution": F.lit("unresolved"), "line": F.lit(0), "call_depth": F.lit(0), "thread_id": F.lit(0), "is_harness": F.lit(False)}
    cols = [F.coalesce(e[w], defaults[c]).alias(c) if c in defaults else e[w].alias(c) for w, c in schema.EVENT_COLUMNS.items()]
    return p.select("process", "line_number", "raw", error.alias("error"), *cols)


def read_events(spark: SparkSession, path: str, run: str, root: str | None = None, strict: bool = False, reference_roots: bool = False) -> DataFrame:
    """Valid events of a run's directory with relative paths; strict raises on the first malformed line. A directory without a trace line is an error, not a clean run."""
    raw = lines(spark, path)
    if raw.isEmpty():
        raise InputError(f"{path}: no trace files, or only empty ones")
    parsed = parse_events(raw)
    if strict and (bad := parsed.where("error IS NOT NULL").orderBy("process", "line_number").first()):
        raise InputError(f"{bad['process']}:{bad['line_number']}: {bad['error']}")
    valid = parsed.where("error IS NULL")
    if root is None:
        root = valid.where(S.is_rooted(F.col("file_path"))).agg(S.common_root(F.col("file_path"))).first()[0] or ""
    return valid.withColumns({"run": F.lit(run), "relative_path": S.normalize_path(F.col("file_path"), F.lit(root), not reference_roots), "resolution": canonical_resolution(F.col("resolution"))}).select(*schema.EVENT.names)


def canonical_resolution(value: Column) -> Column:
    out = value
    for alias, name in S.ALIASES.items():
        out = F.when(value == alias, name).otherwise(out)
    return out


def report(parsed: DataFrame, run: str, root: str = "") -> DataFrame:
    """One row of a run's parsed lines: run, records, malformed, path counters."""
    kind, ok = S.path_class(F.col("file_path"), F.lit(root)), F.col("error").isNull()
    one = parsed.agg(F.count("*").alias("records"), F.count_if(~ok).alias("malformed"), *[F.count_if(ok & (kind == k)).alias(n) for k, n in (("normalized", "normalized"), ("relative", "relative"), ("still-absolute", "still_absolute"), ("missing", "missing"))])
    return one.select(F.lit(run).alias("run"), "*")


def load_report(spark: SparkSession, path: str, run: str, root: str = "") -> DataFrame:
    """One row: run, language, records, malformed, path counters."""
    language = read_manifest(spark, path).where("kind = 'run'").agg(F.min("language").alias("language"))
    return report(parse_events(lines(spark, path)), run, root).crossJoin(language)  # one row each


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All records of a run's manifests with process and line_number, and error for what the contract rules out."""
    return parse_manifest(lines(spark, path, "*.manifest.ndjson", skip_manifests=False))


def parse_manifest(raw: DataFrame) -> DataFrame:
    """The records of manifest lines (process, line_number, raw)."""
    strict = T.StructType([*schema.WIRE_MANIFEST.fields, T.StructField(_CORRUPT, T.StringType())])
    p = raw.withColumn("m", F.from_json("raw", strict, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})).select("process", "line_number", "raw", "m.*")
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    retired = [F.get_json_object("raw", f"$.{f}").isNotNull() for f in schema.RETIRED_FIELDS]
    error = (
        F.when(F.col(_CORRUPT).isNotNull(), "malformed JSON or wrong type").when(~known("kind", schema.MANIFEST_KINDS), "unknown kind")
        .when((F.col("kind") == "run") & ~(F.col("schema").rlike(r"^[a-z]+\.trace/1$") & known("language", schema.LANGUAGES)), "unknown schema or language")
        .when((F.col("kind") == "assembly") & ~known("discovery", schema.DISCOVERIES), "unknown discovery").when((F.col("kind") == "member") & ~known("status", schema.STATUSES), "unknown status")
        .when((F.col("kind") == "member") & F.col("skipReason").isNotNull() & ~known("skipReason", schema.SKIP_REASONS), "unknown skip reason").when(retired[0] | retired[1], "retired field")
    )
    return p.withColumn("error", error).drop(_CORRUPT)


def checked_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """read_manifest, or InputError for bad records, a process with several run records, and in strict mode a wrong order or capacity."""
    m = read_manifest(spark, path)
    if m.isEmpty():
        raise InputError(f"{path}: no manifests, or only empty ones")
    if bad := m.where("error IS NOT NULL").orderBy("process", "line_number").first():
        raise InputError(f"{bad['process']}:{bad['line_number']}: {bad['error']}")
    if twice := m.where("kind = 'run'").groupBy("process").count().where("count > 1").first():
        raise InputError(f"{twice['process']}: {twice['count']} run records")
    if strict:
        ends = m.groupBy("process").agg(F.min_by("kind", "line_number").alias("first"), F.max_by("kind", "line_number").alias("last"), F.min("capacity").alias("capacity"))
        if odd := ends.where("first <> 'run' OR last <> 'writer' OR capacity <= 0").first():
            raise InputError(f"{odd['process']}: begins with {odd['first']}, ends with {odd['last']}, capacity {odd['capacity']}")
    return m


def members(manifest: DataFrame, run: str) -> DataFrame:
    return manifest.where("kind = 'member'").select(F.lit(run).alias("run"), "process", "line_number", "assembly", "method", "status", F.col("skipReason").alias("skip_reason"), F.col("sourceResolution").alias("source_resolution"), F.col("isTestRoot").alias("is_test_root"), "sourceResolution", "returnKind")


def modules(manifest: DataFrame, run: str) -> DataFrame:
    return manifest.where("kind = 'assembly'").select(
        F.lit(run).alias("run"), "process", "line_number", "assembly", "scanned", "instrumented", "discoveredMembers", "patchedMembers", "skippedMembers", "patchFailedMembers", "membersWithExactSource", "tracedCalls",
        F.col("sourceUnavailable").alias("source_unavailable"), F.col("sourcePartial").alias("source_partial"),
    )


def counters(manifest: DataFrame, run: str) -> DataFrame:
    """Digest, unruled and writer counters of a run, summed."""
    names = ["valuesDigested", "depthLimited", "blocklisted", "errored", "renderedTruncated", "unreadableFields", "ambiguousMapEntries", "count", "enqueued", "written", "dropped"]
    return manifest.where("kind IN ('digest', 'unruled', 'writer')").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).select(F.lit(run).alias("run"), "*")


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """One column, path: trimmed, with slashes, distinct. A list that is not there is the empty set."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "value string")
    text = raw.select(S.backslashes_to_slashes(F.trim("value")).alias("path"))
    return text.where("path <> ''").distinct()


def changed_between(spark: SparkSession, left: str, right: str, glob: str = "*", skip: tuple[str, ...] = ("bin", "obj")) -> DataFrame:
    """One column, path: files of the left folder that the right one lacks or has with other content, relative and with slashes; folders named as in skip are passed over.

    Contents are hashed where they are read, so only paths and digests are joined. A file is a value, so it is under 2 GB.
    """

    def files(root: str) -> DataFrame:
        base = tables.qualified(spark, root)
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        path = F.ltrim(F.substring(F.regexp_replace("path", r"^file:/+", "file:/"), len(re.sub(r"^file:/+", "file:/", base)) + 1, 1 << 16), F.lit("/"))
        found = read.select(path.alias("path"), F.sha2("content", 256).alias("digest"))
        return found.where(~F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda x: x.isin(*skip)))

    there = files(right).select("path", F.col("digest").alias("other"))
    return files(left).join(there, "path", "left").where("other IS NULL OR other <> digest").select("path")


def first_added_lines(diffs: DataFrame) -> DataFrame:
    """(diff, file, line) of the first added line of each file in unified diffs given as lines (diff, n, text); a diff is one task's work, a file's lines are numbered within it."""
    w = Window.partitionBy("diff").orderBy("n")
    d = diffs.withColumn("file", F.last(F.when(F.startswith("text", F.lit("+++ b/")), F.substring("text", 7, 4096)), True).over(w)).withColumn("start", F.when(F.startswith("text", F.lit("@@")), F.regexp_extract("text", r"^@@ -\S+ \+(\d+)", 1).cast("int")))
    d = d.withColumn("hunk", F.count("start").over(w)).withColumn("begin", F.last("start", True).over(w))
    inside = Window.partitionBy("diff", "file", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start").isNull() & ~F.startswith("text", F.lit("-")), 1).otherwise(0)
    d = d.withColumn("line", F.col("begin") + F.coalesce(F.sum(new).over(inside), F.lit(0)))
    return d.where(F.startswith("text", F.lit("+")) & ~F.startswith("text", F.lit("+++"))).groupBy("diff", "file").agg(F.min("line").cast("int").alias("line"))


def to_lines(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical lines (value, beside keep's columns): the writer's field order, nulls and isHarness=false left out."""
    inverse = {c: w for w, c in schema.EVENT_COLUMNS.items()}
    value = lambda c: F.when(F.col(c), True) if c == "is_harness" else F.col(c)
    return events.select(*keep, F.to_json(F.struct(*[value(c).alias(w) for c, w in inverse.items()])).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    to_lines(events).write.option("lineSep", "\n").text(path)


def normalize(spark: SparkSession, path: str, out: str) -> tuple[int, int]:
    """Writes a run's valid lines in canonical form; returns (written, skipped). Lines are parsed once: the pass that writes them counts both."""
    seen = Observation("normalize")
    error = F.col("error").isNotNull()
    parsed = parse_events(lines(spark, path)).observe(seen, F.count_if(~error).alias("written"), F.count_if(error).alias("skipped"))
    write_events(parsed.where(~error), out)
    return seen.get["written"], seen.get["skipped"]


def to_manifest_lines(records: DataFrame) -> DataFrame:
    """process, value: canonical manifest lines of records (as of read_manifest) in file order, the contract's field order, nulls left out."""
    fields = [f.name for f in schema.WIRE_MANIFEST.fields]
    return records.select("process", "line_number", F.to_json(F.struct(*fields)).alias("value"))


def write_manifests(records: DataFrame, path: str) -> None:
    """A folder per process, its lines in order: a process writes one manifest, so it is one task's small file."""
    lines_ = to_manifest_lines(records)
    lines_.repartition("process").sortWithinPartitions("process", "line_number").select("process", "value").write.partitionBy("process").option("lineSep", "\n").text(path)


def write_snapshot(events: DataFrame, path: str, identity: str = "") -> None:
    """Base runs kept for later comparisons, partitioned by run; refuses to overwrite. What they belong to is written last: it says that the rest is there."""
    events.write.mode("errorifexists").partitionBy("run").parquet(path)
    about = events.select("run").distinct().agg(F.array_join(F.array_sort(F.collect_set("run")), ",").alias("runs"))
    about.select(F.lit(identity).alias("identity"), "runs", F.unix_seconds(F.current_timestamp()).alias("written_at")).coalesce(1).write.json(f"{path}/_about")


def read_snapshot(spark: SparkSession, path: str, identity: str | None = None, max_age_seconds: int | None = None, runs: list[str] | None = None) -> DataFrame:
    """Events of a snapshot; InputError where it is incomplete, of another identity, too old, or without one of the runs."""
    try:
        about = spark.read.schema("identity string, runs string, written_at long").json(f"{path}/_about").withColumn("now", F.unix_seconds(F.current_timestamp())).first()
    except AnalysisException:
        about = None
    if about is None:
        raise InputError(f"{path}: the snapshot is not complete")
    if identity is not None and about["identity"] != identity:
        raise InputError(f"{path}: a snapshot of {about['identity']!r}, not of {identity!r}")
    if max_age_seconds is not None and about["now"] - about["written_at"] > max_age_seconds:
        raise InputError(f"{path}: written {about['now'] - about['written_at']} s ago")
    if missing := set(runs or ()) - set(about["runs"].split(",")):
        raise InputError(f"{path}: no run {', '.join(sorted(missing))}")
    return spark.read.parquet(path).select(*schema.EVENT.names)
