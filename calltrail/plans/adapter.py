"""Driver tables as traced runs: three base runs and a proposed one, derived from events by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calltrail.sources import schema

BASES = ["base1", "base2", "base3"]
CHANGED = ["src/purchase.py", "src/removed.py", "src/error.py", "src/App.py"]
#: Resolutions of a member's source by its manifest record; others have debugInfo.
RESOLUTIONS = {"App.click()": "unresolved", "App.view()": None}
#: run, method, status, skip_reason
MEMBERS = [(r, f"App.{t}()", "Patched", None) for r in [*BASES, "pr"] for t in ("view", "signup", "click", "error", "purchase") if (r, t) != ("pr", "error")]
MEMBERS += [(r, "App.removed()", "Patched", None) for r in BASES]
MEMBERS += [(r, "App.audit()", "Patched", None) for r in BASES] + [("pr", "App.audit()", "Skipped", "UnsupportedShape")]
MEMBERS += [("pr", "App.hidden()", "Skipped", "ExcludedByScope")]
MEMBERS += [(r, "App.flaky()", "Patched", None) for r in ("base1", "base3", "pr")] + [("base2", "App.flaky()", "PatchFailed", None)]


def runs(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = (*BASES, "pr")) -> DataFrame:
    """Trace events with a run column; a purchase changes and a few calls are missing in pr, some values flicker in base2 and base3."""
    return as_runs(calls(spark, sf_dir), names)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their places and parents in a base run and in pr, dealt by test: a row an event, whatever the number of runs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("test_id"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("process"), "event_type", "props", F.round(F.col("value") * 100).cast("long").alias("cents"))
    # places and parents come first: events are moved once, by test
    by_user, by_key = Window.partitionBy("test_id").orderBy("ts", "event_id"), Window.partitionBy("test_id", "event_type").orderBy("ts", "event_id")
    kept, upto, earlier = F.coalesce(F.expr("event_id % 211 <> 0"), F.lit(False)), (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    e = e.withColumn("kept", kept).withColumns({"base_parent": F.lag("event_id").over(by_user), "pr_parent": F.last(F.when(F.col("kept"), F.col("event_id")), ignorenulls=True).over(by_user.rowsBetween(*earlier))})
    return e.withColumns({"base_ordinal": F.row_number().over(by_key) - 1, "pr_ordinal": (F.count_if("kept").over(by_key.rowsBetween(*upto)) - 1).cast("int")}).drop("ts")


def as_runs(e: DataFrame, names: tuple[str, ...] = (*BASES, "pr")) -> DataFrame:
    """calls as a row a run; digests and texts are made where they are read, and only those that are."""
    e = e.withColumn("run", F.explode(F.array(*map(F.lit, names)))).where("run <> 'pr' OR kept")
    bump = F.expr("CASE run WHEN 'base2' THEN int(event_id % 97 = 0) WHEN 'base3' THEN int(event_id % 89 = 0) WHEN 'pr' THEN int(event_type = 'purchase' AND event_id % 50 = 0) ELSE 0 END")
    of = lambda c: F.when(F.col("run") == "pr", F.col(f"pr_{c}")).otherwise(F.col(f"base_{c}"))
    sha = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    cents = (F.col("cents") + bump).cast("string")
    marked = F.concat("props", F.when(F.col("event_id") % 131 == 0, "<depth:T>").otherwise(""))
    return e.select(
        "run", "process", F.col("event_id").cast("int").alias("line_number"), "test_id", F.concat(F.lit("App."), "event_type", F.lit("()")).alias("method"),
        F.concat(F.lit("src/"), "event_type", F.lit(".py")).alias("file_path"), F.when(F.col("event_type") == "click", "unresolved").otherwise("debugInfo").alias("resolution"), F.lit(1).alias("line"), F.lit(0).alias("call_depth"),
        F.col("event_id").alias("call_id"), of("ordinal").alias("ordinal"), F.when(F.col("event_id") % 3 != 0, of("parent")).alias("parent_call_id"),
        sha(F.col("props")).alias("args_digest"), marked.alias("args_rendered"), sha(cents).alias("return_digest"), cents.alias("return_rendered"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), "AppError").alias("exception_type"), (F.col("event_id") % 4).cast("int").alias("thread_id"), (F.col("event_type") == "signup").alias("is_harness"),
        F.concat(F.lit("src/"), "event_type", F.lit(".py")).alias("relative_path"),
    ).select(*schema.EVENT.names)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return runs(spark, sf_dir, (name,))


def members(spark: SparkSession) -> DataFrame:
    rows = [(r, "p0", i, "App", m, s, k, m != "App.signup()", RESOLUTIONS.get(m, "debugInfo")) for i, (r, m, s, k) in enumerate(MEMBERS)]
    return spark.createDataFrame(rows, "run string, process string, line_number int, assembly string, method string, status string, skip_reason string, is_test_root boolean, source_resolution string").withColumn("is_test_root", ~F.col("is_test_root"))


def modules(spark: SparkSession) -> DataFrame:
    rows = [(r, "p0", 0, "App", True, False, r == "pr") for r in [*BASES, "pr"]] + [(r, "p0", 1, "Lib", False, r == "pr", False) for r in [*BASES, "pr"]]
    return spark.createDataFrame(rows, "run string, process string, line_number int, assembly string, instrumented boolean, source_unavailable boolean, source_partial boolean")


def changed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in CHANGED], "path string")


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def page_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as members of their hosts' modules in four runs, by rules on the id: some appear, vanish, flicker or are skipped, some have a second record in another process."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("assembly"))
    r = p.withColumn("run", F.explode(F.array(*map(F.lit, [*BASES, "pr"])))).withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 3 == 0).cast("int"))))
    r = r.where("NOT (run = 'pr' AND page_id % 19 = 0) AND NOT (run = 'base2' AND page_id % 23 = 0) AND NOT (run <> 'pr' AND page_id % 29 = 0)")
    status = F.expr("CASE WHEN copy = 0 AND page_id % 7 = 0 THEN 'Skipped' WHEN run = 'pr' AND page_id % 11 = 0 THEN 'Skipped' WHEN run = 'base3' AND page_id % 31 = 0 THEN 'PatchFailed' ELSE 'Patched' END")
    reason = F.expr("CASE WHEN status = 'Skipped' THEN CASE page_id % 5 WHEN 0 THEN 'ExcludedByScope' WHEN 1 THEN 'UnsupportedShape' WHEN 2 THEN 'Unobservable' END END")
    method = F.concat(F.lit("Ns.T"), (F.col("page_id") % 50).cast("string"), F.lit(".M"), F.col("page_id").cast("string"), F.lit("()"))
    return r.withColumns({"process": F.concat(F.lit("p"), F.col("copy").cast("string")), "method": method, "status": status}).select("run", "process", F.col("page_id").cast("int").alias("line_number"), "assembly", "method", "status", reason.alias("skip_reason"))


def page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts as modules: instrumented ones, and for some a second record that says otherwise; coverage flags that differ between runs."""
    m = page_members(spark, sf_dir).select("run", "assembly").distinct().withColumn("copy", F.explode(F.sequence(F.lit(0), (F.length("assembly") % 2 == 0).cast("int"))))
    flag = lambda text: F.expr(text)
    return m.select("run", F.concat(F.lit("p"), (1 - F.col("copy")).cast("string")).alias("process"), F.lit(1).alias("line_number"), "assembly", flag("copy = 0 AND length(assembly) % 11 <> 0").alias("instrumented"), flag("copy = 1 OR (run = 'base2' AND length(assembly) % 3 = 0)").alias("source_unavailable"), flag("run = 'pr' AND length(assembly) % 4 = 0").alias("source_partial"))


def page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited files: some types' sources, and some modules by their names."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    types = p.where("page_id % 13 = 0").select(F.concat(F.lit("src/T"), (F.col("page_id") % 50).cast("string"), F.lit(".cs")).alias("path"))
    return types.unionByName(p.where("page_id % 17 = 0").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("path"))).distinct()


PAGE_SQL = """
pm AS (
  SELECT run, 'p' || copy AS process, page_id AS line_number, assembly, 'Ns.T' || page_id % 50 || '.M' || page_id || '()' AS method, status,
    CASE WHEN status = 'Skipped' THEN CASE page_id % 5 WHEN 0 THEN 'ExcludedByScope' WHEN 1 THEN 'UnsupportedShape' WHEN 2 THEN 'Unobservable' END END AS skip_reason
  FROM (SELECT *, CASE WHEN copy = 0 AND page_id % 7 = 0 THEN 'Skipped' WHEN run = 'pr' AND page_id % 11 = 0 THEN 'Skipped' WHEN run = 'base3' AND page_id % 31 = 0 THEN 'PatchFailed' ELSE 'Patched' END AS status
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS assembly, unnest(CASE WHEN page_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM pages), (VALUES ('base1'), ('base2'), ('base3'), ('pr')) r(run)
    WHERE NOT (run = 'pr' AND page_id % 19 = 0) AND NOT (run = 'base2' AND page_id % 23 = 0) AND NOT (run <> 'pr' AND page_id % 29 = 0))),
pmm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, method ORDER BY status <> 'Patched', process, line_number) AS n FROM pm) WHERE n = 1),
pmod AS (
  SELECT run, 'p' || (1 - copy) AS process, assembly, copy = 0 AND length(assembly) % 11 <> 0 AS instrumented, copy = 1 OR (run = 'base2' AND length(assembly) % 3 = 0) AS source_unavailable, run = 'pr' AND length(assembly) % 4 = 0 AS source_partial
  FROM (SELECT DISTINCT run, assembly, unnest(CASE WHEN length(assembly) % 2 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM pm)),
pmodm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, assembly ORDER BY NOT instrumented, process) AS n FROM pmod) WHERE n = 1),
pch AS (SELECT 'src/T' || page_id % 50 || '.cs' AS path FROM pages WHERE page_id % 13 = 0 UNION SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) FROM pages WHERE page_id % 17 = 0)"""


def page_gap_sql(left: str, right: str) -> str:
    """Gaps between two runs of the pages' manifests: scope, assembly, method, base_state, pr_state."""
    flags = " UNION ALL ".join(
        f"""SELECT 'assembly:{name}', coalesce(b.assembly, p.assembly), NULL, coalesce(CASE WHEN b.{c} THEN 'True' WHEN NOT b.{c} THEN 'False' END, 'absent'), coalesce(CASE WHEN p.{c} THEN 'True' WHEN NOT p.{c} THEN 'False' END, 'absent')
        FROM (SELECT * FROM pmodm WHERE run = '{left}') b FULL JOIN (SELECT * FROM pmodm WHERE run = '{right}') p ON b.assembly = p.assembly WHERE (coalesce(b.instrumented, false) OR coalesce(p.instrumented, false)) AND b.{c} IS DISTINCT FROM p.{c}"""
        for name, c in (("sourceUnavailable", "source_unavailable"), ("sourcePartial", "source_partial"))
    )
    return f"""SELECT 'member' AS scope, coalesce(b.assembly, p.assembly) AS assembly, coalesce(b.method, p.method) AS method, coalesce(b.status, 'absent') AS base_state, coalesce(p.status, 'absent') AS pr_state
      FROM (SELECT * FROM pmm WHERE run = '{left}') b FULL JOIN (SELECT * FROM pmm WHERE run = '{right}') p ON b.method = p.method
      WHERE coalesce(b.status, 'absent') <> coalesce(p.status, 'absent') AND NOT ((b.status IS NULL OR p.status IS NULL) AND coalesce(b.status, p.status) = 'Skipped' AND coalesce(coalesce(b.skip_reason, p.skip_reason) = 'ExcludedByScope', false))
      UNION ALL {flags}"""


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else quoted(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def sql() -> str:
    """The same runs, members and changed files as common table expressions: tr, mem, changed."""
    return f"""
ev AS (SELECT event_id, ts, user_id, event_type, props, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
rn AS (
  SELECT 'base1' AS run, *, 0 AS bump FROM ev
  UNION ALL SELECT 'base2', *, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END FROM ev
  UNION ALL SELECT 'base3', *, CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END FROM ev
  UNION ALL SELECT 'pr', *, CASE WHEN event_type = 'purchase' AND event_id % 50 = 0 THEN 1 ELSE 0 END FROM ev WHERE event_id % 211 <> 0),
tr AS (
  SELECT run, 'p' || CAST(user_id % 4 AS VARCHAR) AS process, CAST(event_id AS INTEGER) AS line_number, 'u' || CAST(user_id AS VARCHAR) AS test_id,
    'App.' || event_type || '()' AS method, 'src/' || event_type || '.py' AS path, event_id AS call_id,
    CASE WHEN event_type = 'click' THEN 'unresolved' ELSE 'debugInfo' END AS resolution,
    CASE WHEN event_id % 3 <> 0 THEN lag(event_id) OVER (PARTITION BY run, user_id ORDER BY ts, event_id) END AS parent_call_id,
    CAST(row_number() OVER (PARTITION BY run, user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
    'sha256:' || sha256(props) AS args_digest, props || CASE WHEN event_id % 131 = 0 THEN '<depth:T>' ELSE '' END AS args_rendered,
    'sha256:' || sha256(CAST(cents + bump AS VARCHAR)) AS return_digest, CAST(cents + bump AS VARCHAR) AS return_rendered,
    CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'AppError' END AS exception_type, event_id % 4 AS thread_id, event_type = 'signup' AS is_harness
  FROM rn),
mem AS (SELECT * FROM ({_values([(*m, RESOLUTIONS.get(m[1], "debugInfo")) for m in MEMBERS])}) AS m(run, method, status, skip_reason, source_resolution)),
changed AS (SELECT * FROM ({_values([(p,) for p in CHANGED])}) AS c(path))"""
