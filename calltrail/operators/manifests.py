"""Coverage manifests: merging a run's records, gaps between runs, and lifecycle changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = ["scope", "assembly", "method", "base_state", "pr_state", "reason"]


def merge_members(members: DataFrame) -> DataFrame:
    """One record per (run, method): any Patched one, else the first in file order."""
    cols = [c for c in members.columns if c not in ("run", "method")]
    order = F.struct((F.col("status") != "Patched").cast("int"), F.col("process"), F.col("line_number"))
    return members.where("method IS NOT NULL").groupBy("run", "method").agg(F.min_by(F.struct(*cols), order).alias("m")).select("run", "method", "m.*")


def merge_modules(modules: DataFrame) -> DataFrame:
    """One record per (run, assembly): any instrumented one, else the first in file order."""
    cols = [c for c in modules.columns if c not in ("run", "assembly")]
    order = F.struct((~F.coalesce("instrumented", F.lit(False))).cast("int"), F.col("process"), F.col("line_number"))
    return modules.groupBy("run", "assembly").agg(F.min_by(F.struct(*cols), order).alias("m")).select("run", "assembly", "m.*")


def member_gaps(base: DataFrame, pr: DataFrame) -> DataFrame:
    side = lambda df, p: df.select("method", F.col("status").alias(f"{p}_status"), F.col("skip_reason").alias(f"{p}_skip"), F.col("assembly").alias(f"{p}_assembly"))
    both = side(base, "base").join(side(pr, "pr"), "method", "full_outer")
    state = lambda p: F.coalesce(f"{p}_status", F.lit("absent"))
    one_sided = F.col("base_status").isNull() | F.col("pr_status").isNull()
    benign = one_sided & (F.coalesce("base_status", "pr_status") == "Skipped") & F.coalesce(F.coalesce("base_skip", "pr_skip") == "ExcludedByScope", F.lit(False))
    return both.where((state("base") != state("pr")) & ~benign).select(
        F.lit("member").alias("scope"), F.coalesce("base_assembly", "pr_assembly", F.lit("")).alias("assembly"), "method", state("base").alias("base_state"), state("pr").alias("pr_state"),
        F.concat(F.lit("observability differs between runs: "), state("base"), F.lit(" -> "), state("pr")).alias("reason"),
    )


def module_gaps(base: DataFrame, pr: DataFrame) -> DataFrame:
    flags = {"sourceUnavailable": "source_unavailable", "sourcePartial": "source_partial"}
    side = lambda df, p: df.select("assembly", F.col("instrumented").alias(f"{p}_on"), *[F.col(c).alias(f"{p}_{c}") for c in flags.values()])
    both = side(base, "base").join(side(pr, "pr"), "assembly", "full_outer").where("coalesce(base_on, false) OR coalesce(pr_on, false)")
    text = lambda c: F.coalesce(F.when(c, "True").when(~c, "False"), F.lit("absent"))
    each = both.select("assembly", F.explode(F.array(*[F.struct(F.lit(f"assembly:{n}").alias("scope"), F.col(f"base_{c}").alias("b"), F.col(f"pr_{c}").alias("p"), F.lit(f"tracer coverage flag '{n}' differs between runs").alias("reason")) for n, c in flags.items()])).alias("f"))
    return each.where("NOT (f.b <=> f.p)").select("f.scope", "assembly", F.lit(None).cast("string").alias("method"), text(F.col("f.b")).alias("base_state"), text(F.col("f.p")).alias("pr_state"), "f.reason")


def manifest_diff(base_members: DataFrame, pr_members: DataFrame, base_modules: DataFrame, pr_modules: DataFrame) -> DataFrame:
    return member_gaps(base_members, pr_members).unionByName(module_gaps(base_modules, pr_modules))


def manifest_noise(members: DataFrame, modules: DataFrame, runs: list[str]) -> DataFrame:
    """Signatures (scope, assembly, method) of gaps between any two base runs."""
    out = None
    of = lambda df, r: df.where(F.col("run") == r)
    for i, a in enumerate(runs):
        for b in runs[i + 1 :]:
            part = manifest_diff(of(members, a), of(members, b), of(modules, a), of(modules, b)).select("scope", "assembly", "method")
            out = part if out is None else out.unionByName(part)
    return out.distinct()


def without_manifest_noise(gaps: DataFrame, noise: DataFrame) -> DataFrame:
    n = noise.select(F.col("scope").alias("ns"), F.col("assembly").alias("na"), F.coalesce("method", F.lit("")).alias("nm"))
    return gaps.join(n, (F.col("scope") == F.col("ns")) & (F.col("assembly") == F.col("na")) & (F.coalesce("method", F.lit("")) == F.col("nm")), "left_anti")


def is_lifecycle():
    b, p = F.col("base_state"), F.col("pr_state")
    return (F.col("scope") == "member") & (((b == "absent") & (p == "Patched")) | ((b == "Patched") & (p == "absent")))


def method_files(base: DataFrame, pr: DataFrame) -> DataFrame:
    """The first path of each method, base before pr, in load order."""
    rows = base.withColumn("o", F.lit(0)).unionByName(pr.withColumn("o", F.lit(1))).where("method <> '' AND relative_path <> ''")
    return rows.groupBy("method").agg(F.min_by("relative_path", F.struct("o", "process", "line_number")).alias("file_path"))


def lifecycle_divergences(gaps: DataFrame, base: DataFrame, pr: DataFrame, changed: DataFrame) -> DataFrame:
    """MethodAdded and MethodRemoved in edited files, one for each test that called the method on the side that has it."""
    promoted = gaps.where(is_lifecycle()).join(F.broadcast(changed.select(F.col("path").alias("file_path")).distinct()) if _few(changed) else changed.select(F.col("path").alias("file_path")).distinct(), "file_path") if "file_path" in gaps.columns else None
    if promoted is None:
        return lifecycle_divergences(gaps.join(method_files(base, pr), "method", "left"), base, pr, changed)
    kinds = promoted.select("method", "file_path", F.when(F.col("base_state") == "absent", "MethodAdded").otherwise("MethodRemoved").alias("kind"), "reason")
    side = lambda df, kind: df.where("NOT is_harness").select("test_id", "method").distinct().withColumn("kind", F.lit(kind))
    tests = side(pr, "MethodAdded").unionByName(side(base, "MethodRemoved"))
    return kinds.join(tests, ["method", "kind"]).select("test_id", "method", "kind", F.col("reason").alias("detail"), "file_path")


def _few(df: DataFrame, rows: int = 100_000) -> bool:
    """Counted before it is broadcast."""
    return df.limit(rows + 1).count() <= rows


def gap_methods(gaps: DataFrame, changed: DataFrame, base: DataFrame, pr: DataFrame) -> DataFrame:
    """Methods of gaps that stay tooling gaps (lifecycle changes in edited files are results instead)."""
    with_file = gaps.where("method IS NOT NULL").join(method_files(base, pr), "method", "left")
    edited = with_file.where(is_lifecycle()).join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("method")
    return with_file.join(edited, "method", "left_anti").select("method").distinct()


def gaps_by_scope(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("scope").agg(F.count("*").alias("gaps"))
