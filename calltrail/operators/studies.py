"""Analytics over runs: summaries, noise studies, order stability, test shapes, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.operators import scans, tree
from calltrail.operators.keys import HOT_ROWS, KEY, placed


def _signature() -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in ("args_digest", "return_digest", "exception_type")])


def trace_summary(events: DataFrame) -> DataFrame:
    """Counters of each run; duplicate call ids are counted within processes.

    Distinct values are counted in two levels, a small grouping each, as several distinct counts in one aggregation would multiply every row.
    """
    per = events.groupBy("run", "process").agg(
        F.count("*").alias("events"), F.count_if(F.col("parent_call_id").isNull()).alias("roots"), F.max("call_depth").alias("max_depth"), F.count_if(F.col("exception_type").isNotNull()).alias("threw"),
    ).groupBy("run").agg(F.sum("events").alias("events"), F.sum("roots").alias("roots"), F.max("max_depth").alias("max_depth"), F.sum("threw").alias("threw"))
    for name, column in (("tests", "test_id"), ("methods", "method"), ("threads", "thread_id")):
        per = per.join(events.groupBy("run", column).agg(F.lit(1).alias("one")).groupBy("run").agg(F.count(column).alias(name)), "run")
    calls = events.groupBy("run", "process", "call_id").agg(F.lit(1).alias("one")).groupBy("run").agg(F.count("call_id").alias("calls"))
    return per.join(calls, "run").select("run", "events", "tests", "methods", "threads", "roots", "max_depth", "threw", (F.col("events") - F.col("calls")).alias("duplicate_call_ids"))


def count_spread(events: DataFrame) -> DataFrame:
    """Per method: least, most and spread of its subject calls over the runs (0 where a run lacks it)."""
    runs = events.select("run").distinct().count()
    per = events.where("NOT is_harness").groupBy("method", "run").agg(F.count("*").alias("n")).groupBy("method").agg(F.min("n").alias("lo"), F.max("n").alias("most"), F.count("*").alias("present"))
    return per.select("method", F.when(F.col("present") < runs, 0).otherwise(F.col("lo")).alias("least"), "most").withColumn("spread", F.col("most") - F.col("least"))


def multiset_hash(*values: Column) -> Column:
    """Aggregate: a hash of the values as a multiset, whatever their order. Its state is four sums: the halves of two 64-bit hashes of each row, so that no sum overflows below 2**31 rows."""
    sums = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *values)
        sums += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    return F.sha2(F.concat_ws(",", *[x.cast("string") for x in sums], F.count(F.lit(1)).cast("string")).cast("binary"), 256)


def key_signatures(events: DataFrame) -> DataFrame:
    """Per key and run: calls and a hash of the multiset of call signatures, in constant state per key."""
    return events.where("NOT is_harness").groupBy("run", *KEY).agg(F.count("*").alias("calls"), multiset_hash(_signature()).alias("signature"))


def noise_growth(events: DataFrame, run_order: list[str]) -> DataFrame:
    """n_runs (2..N) and the number of keys that vary within the first n runs."""
    grid = key_signatures(events).groupBy(*KEY).agg(*[F.max(F.when(F.col("run") == r, F.col("signature"))).alias(f"s{i}") for i, r in enumerate(run_order, 1)])
    first = F.coalesce(*[F.when(~F.col("s1").eqNullSafe(F.col(f"s{i}")), F.lit(i)) for i in range(2, len(run_order) + 1)])
    firsts = grid.select(first.alias("first")).where("first IS NOT NULL").groupBy("first").agg(F.count("*").alias("n"))
    sizes = events.sparkSession.createDataFrame([(i,) for i in range(2, len(run_order) + 1)], "n_runs int")
    return sizes.join(firsts, F.col("first") <= F.col("n_runs"), "left").groupBy("n_runs").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("noise_keys"))


def classify_variation(events: DataFrame) -> DataFrame:
    """Varying keys by class: moved (the method's total is the same in all runs) or extra (it is not)."""
    runs = events.select("run").distinct().count()
    s = events.where("NOT is_harness")
    keys = s.groupBy("run", *KEY).agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.count_distinct("n").alias("kinds"), F.count("*").alias("present")).where((F.col("kinds") > 1) | (F.col("present") < runs))
    totals = s.groupBy("run", "method").agg(F.count("*").alias("n")).groupBy("method").agg(((F.count_distinct("n") == 1) & (F.count("*") == runs)).alias("constant"))
    return keys.join(totals, "method").groupBy(F.when(F.col("constant"), "moved").otherwise("extra").alias("class")).agg(F.count("*").alias("keys"), F.count_distinct("method").alias("methods"))


def order_instability(left: DataFrame, right: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys called equally often whose call at some position differs between two runs of the same build, with the first such position."""
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    at = placed(rows, ("side",), hot_rows, deal=True).withColumn("signature", _signature())
    per = at.groupBy(*KEY, "pos").agg(F.count("*").alias("n"), F.count_distinct("signature").alias("kinds"))
    return per.groupBy(*KEY).agg(F.max(F.col("pos")).alias("last"), F.min("n").alias("least"), F.min(F.when(F.col("kinds") > 1, F.col("pos"))).alias("first_unlike")).where("least = 2 AND first_unlike IS NOT NULL").select(*KEY, (F.col("last") + 1).alias("calls"), "first_unlike")


def test_shapes(events: DataFrame) -> DataFrame:
    """Per run and test: threads used, and its shape, a hash of how often it calls each method."""
    per = events.groupBy("run", "test_id", "method").agg(F.count("*").alias("n"))
    shapes = per.groupBy("run", "test_id").agg(multiset_hash(F.col("method"), F.col("n")).alias("shape"))
    threads = events.groupBy("run", "test_id").agg(F.count_distinct("thread_id").cast("int").alias("threads"))
    return shapes.join(threads, ["run", "test_id"])


def shape_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shapes that occur a different number of times in two runs."""
    n = lambda df, c: test_shapes(df).groupBy("shape").agg(F.count("*").alias(c))
    both = n(left, "left_tests").join(n(right, "right_tests"), "shape", "full_outer").na.fill(0, ["left_tests", "right_tests"])
    return both.where("left_tests <> right_tests")


def patched_vs_traced(events: DataFrame, members: DataFrame) -> DataFrame:
    """(method, state): traced without a patched member (orphan), or patched and never called (silent)."""
    traced = events.select("method").distinct()
    patched = members.where("status = 'Patched'").select("method").distinct()
    return traced.join(patched, "method", "left_anti").withColumn("state", F.lit("orphan")).unionByName(patched.join(traced, "method", "left_anti").withColumn("state", F.lit("silent")))


def root_composition(events: DataFrame, members: DataFrame) -> DataFrame:
    """(run, method, calls, is_test_root): what the calls at depth 0 are; a method without a record is no test root."""
    marked = members.groupBy("method").agg(F.bool_or(F.coalesce("is_test_root", F.lit(False))).alias("is_test_root"))
    return events.where("call_depth = 0").groupBy("run", "method").agg(F.count("*").alias("calls")).join(marked, "method", "left").select("run", "method", "calls", F.coalesce("is_test_root", F.lit(False)).alias("is_test_root"))


def process_audit(events: DataFrame, modules: DataFrame, members: DataFrame, writers: DataFrame) -> DataFrame:
    """(process, problem, subject, observed, expected) for what does not add up in a process: module records that occur twice, traced calls of a module against its members' events, members without
    a module, events without a member, written lines against events."""
    row = lambda df, problem, subject, observed, expected: df.select("process", F.lit(problem).alias("problem"), subject.alias("subject"), observed.cast("long").alias("observed"), expected.cast("long").alias("expected"))
    zero, one = F.lit(0), F.lit(1)
    calls = events.groupBy("process", "method").agg(F.count("*").alias("calls"))
    twice = modules.groupBy("process", "assembly").agg(F.count("*").alias("n")).where("n > 1")
    owner = members.select("process", "assembly", "method").distinct()
    traced = owner.join(calls, ["process", "method"]).groupBy("process", "assembly").agg(F.sum("calls").alias("calls"))
    off = modules.groupBy("process", "assembly").agg(F.max("traced_calls").alias("traced_calls")).join(traced, ["process", "assembly"], "left").where("traced_calls <> coalesce(calls, 0)")
    lone = members.select("process", "assembly").distinct().join(modules, ["process", "assembly"], "left_anti")
    strange = calls.join(owner, ["process", "method"], "left_anti")
    lines = writers.select("process", "written").join(calls.groupBy("process").agg(F.sum("calls").alias("calls")), "process", "left").where("written <> coalesce(calls, 0)")
    parts = [
        row(twice, "module recorded twice", F.col("assembly"), F.col("n"), one), row(off, "traced calls of a module", F.col("assembly"), F.coalesce("calls", zero), F.col("traced_calls")),
        row(lone, "members without a module", F.col("assembly"), one, zero), row(strange, "events without a member", F.col("method"), F.col("calls"), zero), row(lines, "written lines", F.lit(""), F.coalesce("calls", zero), F.col("written")),
    ]
    return reduce(DataFrame.unionByName, parts)


def source_census(events: DataFrame) -> DataFrame:
    return events.groupBy("run", F.coalesce("resolution", F.lit("unresolved")).alias("resolution")).agg(F.count("*").alias("events"), F.count_distinct("method").alias("methods"))


def run_integrity(events: DataFrame, modules: DataFrame, expected_tests: int | None = None) -> DataFrame:
    """(check, observed, expected) that do not hold: events without a test, roots, traced calls against events."""
    traced = modules.agg(F.coalesce(F.sum("tracedCalls"), F.lit(0)).alias("traced"))
    e = events.agg(F.count("*").alias("events"), F.count_if(F.col("test_id") == "(no-test)").alias("unlabelled"), F.count_distinct(F.when(F.col("parent_call_id").isNull(), F.col("test_id"))).alias("roots"))
    one = e.withColumn("one", F.lit(1)).join(traced.withColumn("one", F.lit(1)), "one")  # one row each
    checks = [("traced_calls", F.col("traced"), F.col("events")), ("unlabelled", F.col("unlabelled"), F.lit(0))] + ([("roots", F.col("roots"), F.lit(expected_tests))] if expected_tests is not None else [])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), o.cast("long").alias("observed"), x.cast("long").alias("expected")) for n, o, x in checks])).alias("c")).select("c.*")
    return rows.where("observed <> expected")


def first_roots(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Synthetic test ids: root#n, the n-th call of a root method in entry order."""
    roots = events.where("parent_call_id IS NULL").select("run", "process", "method", "call_id")
    found = scans.running(roots, ["run", "process", "method"], F.col("call_id"), [], {"n": ("count", F.lit(1))}, hot_rows)
    return found.select("run", "process", "call_id", F.concat_ws("#", "method", F.col("n").cast("string")).alias("synthetic_test_id"))


def entry_ordinals(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds entry_ordinal: a call's place among its key's calls of a process in the order in which they began (ids are given on entry), not ended."""
    found = scans.running(events, ["run", "process", *KEY], F.col("call_id"), [], {"entry_ordinal": ("count", F.lit(1))}, hot_rows)
    return found.withColumn("entry_ordinal", (F.col("entry_ordinal") - 1).cast("int"))


def nearest_roots(events: DataFrame, members: DataFrame) -> DataFrame:
    """(run, process, call_id, root_call_id, distance): the nearest call of a test root at or above each call; calls without one are left out."""
    roots = events.join(members.where("is_test_root").select("method").distinct(), "method", "left_semi").select(*tree.CALL)
    below = tree.closure(events, roots, down=True).select("run", "process", "call_id", F.col("origin").alias("root_call_id"), "distance")
    own = roots.select("run", "process", "call_id", F.col("call_id").alias("root_call_id"), F.lit(0).alias("distance"))
    nearest = F.min_by(F.struct("root_call_id", "distance"), "distance").alias("r")
    return below.unionByName(own).groupBy(*tree.CALL).agg(nearest).select(*tree.CALL, "r.root_call_id", F.col("r.distance").cast("int").alias("distance"))
