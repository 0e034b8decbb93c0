"""Call keys (test, method): positions, comparison of two runs, and the noise baseline over several.

Everything about a key is computed in partitions of (test_id, method): positions, per-key counts, first calls and positional
alignment need one exchange between them. Both sides of a comparison travel in it as one table with a side column, so the
full outer join on keys and the join on positions are aggregations with no join at all. A key with more than ``HOT_ROWS`` calls is
cut along its ordinals and spread over tasks (``scans``); alignment then deals by (key, position).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.functions import scalars as S
from calltrail.operators import scans

KEY = ["test_id", "method"]
_COMPARED = ["args_digest", "return_digest", "exception_type"]
_SHOWN = ["exception_type", "args_rendered", "return_rendered", "relative_path", "is_harness"]
_CARRIED = [*_COMPARED, *[c for c in _SHOWN if c not in _COMPARED]]
_PLACED = ["run", "process", "line_number", "ordinal", *KEY, *_CARRIED]
DIVERGENCE = [*KEY, "ordinal", "kind", "detail", "confidence", "markers", "file_path", "base_args", "pr_args", "base_return", "pr_return", "base_exception", "pr_exception", "is_harness"]


#: Calls of one key that are one task's work.
HOT_ROWS = 1_000_000


def placed(calls: DataFrame, beside: tuple[str, ...], hot_rows: int = HOT_ROWS, deal: bool = False) -> DataFrame:
    """Adds pos, a call's place from 0 among those with its key and the columns beside: by ordinal, then process and line. deal: in partitions by key, where no key is hot."""
    found = scans.running(calls, [*beside, *KEY], F.col("ordinal"), [F.col("process"), F.col("line_number")], {"pos": ("count", F.lit(1))}, hot_rows, KEY if deal else ())
    return found.withColumn("pos", (F.col("pos") - 1).cast("int"))


def positions(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds pos, a call's place among its key's calls in its run."""
    return placed(events, ("run",), hot_rows)


def ordinal_violations(events: DataFrame) -> DataFrame:
    """Keys of a process whose ordinals are not 0..n-1."""
    g = events.groupBy("run", "process", *KEY).agg(F.count("*").alias("calls"), F.count_distinct("ordinal").alias("distinct_ordinals"), F.min("ordinal").alias("least"), F.max("ordinal").alias("most"))
    return g.where("least <> 0 OR most <> calls - 1 OR distinct_ordinals <> calls")


def _sides(base: DataFrame, pr: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    side = lambda df, name: df.select(*_PLACED).withColumn("side", F.lit(name))
    # dealt once by key; every aggregation below is content with it
    return placed(side(base, "base").unionByName(side(pr, "pr")), ("side",), hot_rows, deal=True)


def _sides_in(events: DataFrame, base: str, pr: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same of two runs in one table: what is dealt by test stays where it is, which a union would not know."""
    side = F.when(F.col("run") == base, "base").otherwise("pr")
    return placed(events.where(F.col("run").isin(base, pr)).select(*_PLACED, side.alias("side")), ("side",), hot_rows, deal=True)


def _of(side: str, alias: str):
    return F.max(F.when(F.col("side") == side, F.struct(*_CARRIED))).alias(alias)


def _n(side: str, alias: str):
    return F.count_if(F.col("side") == side).alias(alias)


def _firsts(rows: DataFrame) -> DataFrame:
    at0 = F.col("pos") == 0
    first = lambda side, alias: F.max(F.when(at0 & (F.col("side") == side), F.struct(*_SHOWN))).alias(alias)
    return rows.groupBy(*KEY).agg(_n("base", "base_calls"), _n("pr", "pr_calls"), first("base", "b"), first("pr", "p"))


def _described(df: DataFrame) -> DataFrame:
    markers = S.partial_markers(F.col("b.args_rendered"), F.col("b.return_rendered"), F.col("p.args_rendered"), F.col("p.return_rendered"))
    out = df.withColumn("markers", markers).withColumn("confidence", S.confidence(F.col("markers")))
    names = {"base_args": "b.args_rendered", "pr_args": "p.args_rendered", "base_return": "b.return_rendered", "pr_return": "p.return_rendered", "base_exception": "b.exception_type", "pr_exception": "p.exception_type"}
    return out.select("*", *[F.col(v).alias(k) for k, v in names.items()])


def matched_keys(base: DataFrame, pr: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Subject keys on both sides, with call counts and the confidence of their first calls."""
    return _matched(_sides(base, pr, hot_rows))


def matched_keys_in(events: DataFrame, base: str, pr: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """matched_keys of two runs in one table."""
    return _matched(_sides_in(events, base, pr, hot_rows))


def _matched(rows: DataFrame) -> DataFrame:
    both = _firsts(rows).where("base_calls > 0 AND pr_calls > 0 AND NOT b.is_harness")
    return _described(both).select(*KEY, "base_calls", "pr_calls", "confidence", "markers", F.col("b.relative_path").alias("file_path"))


def compare(base: DataFrame, pr: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All divergences of two runs, harness keys included (is_harness): missing keys, changed counts, and the first difference of each aligned call."""
    return _compared(_sides(base, pr, hot_rows))


def compare_in(events: DataFrame, base: str, pr: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """compare of two runs in one table."""
    return _compared(_sides_in(events, base, pr, hot_rows))


def _compared(rows: DataFrame) -> DataFrame:
    owner = F.coalesce("b", "p")
    keys = _firsts(rows)
    level = keys.where("base_calls = 0 OR pr_calls = 0 OR base_calls <> pr_calls").withColumns({
        "kind": F.when(F.col("base_calls") == 0, "MissingInBase").when(F.col("pr_calls") == 0, "MissingInPr").otherwise("CallCountChange"),
        "detail": F.when(F.col("base_calls") == 0, F.format_string("key absent from base, %d call(s) in PR", "pr_calls")).when(F.col("pr_calls") == 0, F.format_string("key absent from PR, %d call(s) in base", "base_calls")).otherwise(F.format_string("called %d time(s) in base, %d in PR", "base_calls", "pr_calls")),
        "ordinal": F.lit(-1), "is_harness": owner["is_harness"], "file_path": owner["relative_path"],
    })
    aligned = rows.groupBy(*KEY, "pos").agg(_of("base", "b"), _of("pr", "p")).where("b IS NOT NULL AND p IS NOT NULL")
    difference = S.first_difference(*[F.col(f"{s}.{c}") for c in _COMPARED for s in ("b", "p")])
    calls = aligned.withColumns({"kind": F.lit("DigestDiff"), "detail": difference, "ordinal": F.col("pos"), "file_path": F.col("b.relative_path")}).where("detail IS NOT NULL")
    # a key is harness or subject by its first base call; only calls that differ ask
    harness = rows.where("side = 'base' AND pos = 0").select(*[F.col(k).alias(f"_{k}") for k in KEY], "is_harness")
    calls = calls.join(harness, (F.col("test_id") == F.col("_test_id")) & (F.col("method") == F.col("_method")))
    return _described(level).select(*DIVERGENCE).unionByName(_described(calls).select(*DIVERGENCE))


def noise_keys(bases: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Subject keys on which any two of the base runs differ: missing in one, called differently often, or unlike at a position.

    One pass for any number of runs; two runs differ in a key exactly if not all runs agree in it.
    """
    runs = bases.select("run").distinct().count()
    at = placed(bases.select("run", "process", "line_number", "ordinal", *KEY, *_COMPARED, "is_harness"), ("run",), hot_rows, deal=True)
    call = F.struct(*[F.coalesce(c, F.lit("\u0000")) for c in _COMPARED])
    # the least and the greatest differ exactly if not all are equal; one sort, where a count of distinct calls takes three
    per = at.groupBy(*KEY, "pos").agg(F.count("*").alias("n"), F.min(call).alias("least"), F.max(call).alias("most"), F.min_by("is_harness", "run").alias("is_harness"))
    keys = per.groupBy(*KEY).agg(F.bool_or((F.col("n") < runs) | (F.col("least") != F.col("most"))).alias("varies"), F.max(F.when(F.col("pos") == 0, F.col("is_harness"))).alias("is_harness"))
    return keys.where("varies AND NOT is_harness").select(*KEY)


def noise_divergences(bases: DataFrame, run_order: list[str]) -> DataFrame:
    """The pairwise form: each noise key's first divergence (earliest pair, key level before calls) and its number of differences."""
    pairs = [(a, b) for i, a in enumerate(run_order) for b in run_order[i + 1 :]]
    found = None
    for n, (a, b) in enumerate(pairs):
        part = compare_in(bases, a, b).where("NOT is_harness").withColumns({"pair": F.lit(n), "left_run": F.lit(a), "right_run": F.lit(b)})
        found = part if found is None else found.unionByName(part)
    kept = [c for c in found.columns if c not in (*KEY, "pair")]
    # one row a key leaves each task; no window over all differences of a key
    first = F.min_by(F.struct(*kept), F.struct("pair", "ordinal", "kind")).alias("first")
    return found.groupBy(*KEY).agg(first, F.count("*").alias("difference_count")).select(*[F.col(k) if k in KEY else F.col(f"first.{k}").alias(k) for k in found.columns if k != "pair"], "difference_count")


def without_noise(divergences: DataFrame, noise: DataFrame, gap_methods: DataFrame | None = None) -> DataFrame:
    """Subject divergences whose key is no noise and whose method has no observability gap."""
    out = divergences.where("NOT is_harness").join(noise.select(*KEY), KEY, "left_anti")
    return out if gap_methods is None else out.join(gap_methods.select("method").distinct(), "method", "left_anti").select(*divergences.columns)


def noise_histogram(noise: DataFrame, limit: int = 15) -> DataFrame:
    """The methods with most noise keys (a report's list, so it has an end)."""
    return noise.groupBy("method").agg(F.count("*").alias("keys")).orderBy(F.desc("keys"), "method").limit(limit)
