"""The call tree: parents within a process, orphans, transitive closures and call paths.

Closures double their reach each round: a table of jumps (call, ancestor 2**k calls up) steps what was found by 2**k calls and then
itself, so a tree of depth d takes about log2(d) rounds of joins on (run, process, call_id). What a round finds is written to the
shared folder, so lineage does not grow and a lost executor costs one round. Only calls that are asked for are kept.

``labels`` numbers the calls of a forest in depth-first order by the same jumps: how many calls lie below each, then, going down, what comes before it. A subtree is then
an interval of numbers, and the order in which a walk would discover calls is a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltrail.operators import scans
from calltrail.tables import stored

CALL = ["run", "process", "call_id"]


def orphans(events: DataFrame) -> DataFrame:
    """Calls whose parent does not exist in their process."""
    parents = events.select("run", "process", F.col("call_id").alias("parent_call_id"))
    return events.where("parent_call_id IS NOT NULL").join(parents, ["run", "process", "parent_call_id"], "left_anti")


def roots(events: DataFrame) -> DataFrame:
    return events.where("parent_call_id IS NULL")


def _jumps(events: DataFrame) -> DataFrame:
    """(run, process, lo, hi): hi is lo's parent."""
    return stored(events.where("parent_call_id IS NOT NULL").select("run", "process", F.col("call_id").alias("lo"), F.col("parent_call_id").alias("hi")).distinct())


def _twice(jumps: DataFrame, single: bool = False) -> DataFrame:
    """single: no call has two parents, so no jump comes twice."""
    further = jumps.select("run", "process", F.col("lo").alias("hi"), F.col("hi").alias("top"))
    twice = jumps.join(further, ["run", "process", "hi"]).select("run", "process", "lo", F.col("top").alias("hi"))
    return stored(twice if single else twice.distinct())


class Steps:
    """The jumps of 1, 2, 4, ... calls of some events, each made when it is first asked for and kept for later closures over the same events."""

    def __init__(self, events: DataFrame):
        self.events, self.levels, self.single = events, [], False

    def of(self, level: int) -> DataFrame:
        if not self.levels:
            parents = self.events.where("parent_call_id IS NOT NULL").groupBy("run", "process", F.col("call_id").alias("lo")).agg(F.min("parent_call_id").alias("hi"), F.max("parent_call_id").alias("other"))
            parents = stored(parents)
            self.single = parents.where("hi <> other").isEmpty()
            self.levels.append(parents.drop("other") if self.single else _jumps(self.events))
        while len(self.levels) <= level:
            self.levels.append(_twice(self.levels[-1], self.single))
        return self.levels[level]

    def circling(self) -> DataFrame | None:
        """(run, process, call_id) of the calls in a cycle and below one; None if there are none."""
        level, most = 0, self.of(0).count().bit_length()
        while not self.of(level).isEmpty():
            if level == most:  # jumps longer than there are calls run in circles
                return self.of(level).select("run", "process", F.col("lo").alias("call_id")).distinct()
            level += 1
        return None


def closure(events: DataFrame, start: DataFrame, down: bool, steps: Steps | None = None) -> DataFrame:
    """(run, process, origin, call_id, distance) for every proper descendant (down) or ancestor of start's calls; a cycle ends where it closes. steps: those of events, if there are any."""
    at, to = ("hi", "lo") if down else ("lo", "hi")
    pair = ["run", "process", "origin", "call_id"]
    steps, level = steps or Steps(events), 0
    found = stored(start.select("run", "process", F.col("call_id").alias("origin"), "call_id").distinct().withColumn("distance", F.lit(0)))
    while True:
        on = steps.of(level).select("run", "process", F.col(at).alias("call_id"), F.col(to).alias("next"))
        further = found.join(on, ["run", "process", "call_id"]).select("run", "process", "origin", F.col("next").alias("call_id"), (F.col("distance") + 2**level).alias("distance"))
        further = stored(further.groupBy(*pair).agg(F.min("distance").alias("distance")).join(found.select(*pair), pair, "left_anti"))
        if further.isEmpty():
            return found.where("distance > 0")
        found, level = found.unionByName(further), level + 1


def labels(events: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """(run, process, call_id, pre, size): a call's number in the depth-first walk of its process, from 0, and the number of calls of its subtree, itself included.

    Roots and siblings are walked in the order of their lines. d lies below c exactly if pre(c) < pre(d) < pre(c) + size(c) in the same process. A call whose parent does not exist
    counts as a root; calls in a cycle and below one have no row. Both passes take as many rounds as the depth has binary digits; siblings of a call with very
    many children are cut over tasks.
    """
    calls = events.select(*CALL, "parent_call_id", F.col("line_number").cast("long").alias("line_number"))
    known = events.select("run", "process", F.col("call_id").alias("parent_call_id"), F.lit(True).alias("known")).distinct()
    calls = stored(calls.join(known, ["run", "process", "parent_call_id"], "left").select(*CALL, F.when(F.col("known"), F.col("parent_call_id")).alias("parent"), "line_number"))
    jumps = stored(calls.where("parent IS NOT NULL").select("run", "process", F.col("call_id").alias("lo"), F.col("parent").alias("hi")))
    sizes = calls.select(*CALL, F.lit(1).cast("long").alias("size"))
    levels, most = [], calls.count().bit_length() + 1
    # a subtree to twice the depth: what is known of it, and of those that begin just below
    while not jumps.isEmpty() and len(levels) < most:
        levels.append(jumps)
        below = jumps.join(sizes.withColumnRenamed("call_id", "lo"), ["run", "process", "lo"]).groupBy("run", "process", F.col("hi").alias("call_id")).agg(F.sum("size").alias("more"))
        sizes = stored(sizes.join(below, CALL, "left").select(*CALL, (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        jumps = _twice(jumps)
    if not jumps.isEmpty():  # jumps longer than there are calls run in circles
        circling = jumps.select("run", "process", F.col("lo").alias("call_id")).distinct()
        calls = stored(calls.join(circling, CALL, "left_anti"))
    sized = stored(calls.join(sizes, CALL))
    ordered = scans.running(sized, ["run", "process", "parent"], F.col("line_number"), [F.col("call_id")], {"upto": ("sum", F.col("size"))}, hot_rows)
    # what comes between a call and its parent's own number: one, and the earlier siblings' subtrees
    pre = stored(ordered.select(*CALL, "size", (F.col("upto") - F.col("size") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("pre")))
    for jump in levels:
        above = jump.select("run", "process", F.col("lo").alias("call_id"), "hi").join(pre.select("run", "process", F.col("call_id").alias("hi"), F.col("pre").alias("before")), ["run", "process", "hi"])
        pre = stored(pre.join(above.select(*CALL, "before"), CALL, "left").select(*CALL, "size", (F.col("pre") + F.coalesce("before", F.lit(0))).alias("pre")))
    return pre.select(*CALL, "pre", "size")


#: Numbers that one row is spread into at a time, and calls whose followers one window finds.
SPAN = 4096


def below(order: DataFrame, calls: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(run, process, origin, call_id, pre) for every proper descendant of calls, by the intervals of labels: one equi-join, no rounds.

    An interval is spread into its numbers in steps, so that no array grows with a subtree. keep: further columns of calls, which have a row a call. Further columns of order stay.
    """
    own = order.select(*CALL, "pre", "size").join(calls.select(*CALL, *keep).distinct(), CALL).where("size > 1")
    steps = own.select("run", "process", F.col("call_id").alias("origin"), *keep, (F.col("pre") + F.col("size") - 1).alias("last"), F.explode(F.sequence(F.col("pre") + 1, F.col("pre") + F.col("size") - 1, F.lit(SPAN).cast("long"))).alias("from"))
    numbers = steps.select("run", "process", "origin", *keep, F.explode(F.sequence("from", F.least(F.col("from") + SPAN - 1, "last"))).alias("pre"))
    return numbers.join(order.drop("size"), ["run", "process", "pre"])


def with_any_below(order: DataFrame, calls: DataFrame) -> DataFrame:
    """(run, process, call_id) of those of calls that have another one of them below: the next of them in depth-first order lies in the subtree.

    Followers are found in spans of numbers, and past a span by a table of each span's first.
    """
    mine = order.join(calls.select(*CALL).distinct(), CALL).withColumn("span", F.floor(F.col("pre") / SPAN))
    firsts = mine.groupBy("run", "process", "span").agg(F.min("pre").alias("first"))
    firsts = firsts.select("run", "process", "span", F.lead("first").over(Window.partitionBy("run", "process").orderBy("span")).alias("later"))
    inside = mine.withColumn("next", F.lead("pre").over(Window.partitionBy("run", "process", "span").orderBy("pre")))
    return inside.join(firsts, ["run", "process", "span"]).where(F.coalesce("next", "later") < F.col("pre") + F.col("size")).select(*CALL)


def marked(events: DataFrame, start: DataFrame, down: bool, steps: Steps | None = None) -> DataFrame:
    """(run, process, call_id) of every proper descendant (down) or ancestor of any of start's calls; each call is kept once. steps: those of events, if there are any."""
    at, to = ("hi", "lo") if down else ("lo", "hi")
    steps, level = steps or Steps(events), 0
    moved = lambda calls, k: calls.join(steps.of(k).select("run", "process", F.col(at).alias("call_id"), F.col(to).alias("next")), CALL).select("run", "process", F.col("next").alias("call_id")).distinct()
    seen = stored(moved(start.select(*CALL).distinct(), 0))
    while True:
        further = stored(moved(seen, level).join(seen, CALL, "left_anti"))
        if further.isEmpty():
            return seen
        seen, level = seen.unionByName(further), level + 1


def marked_ancestors(events: DataFrame, start: DataFrame) -> DataFrame:
    """(run, process, call_id) of every proper ancestor of any of start's calls; each call is kept once."""
    return marked(events, start, down=False)


def call_paths(events: DataFrame, start: DataFrame, steps: Steps | None = None) -> DataFrame:
    """(run, process, call_id, path) from the root to each of start's calls, however deep; an unresolved parent or a cycle gives an empty path. steps: those of events, if there are any.

    The ancestors of the calls asked for come from the doubling closure, then a path is put together once, by distance; a call's path must fit
    in a row, as it is one value.
    """
    node = F.struct(F.col("method").alias("member"), F.col("relative_path").alias("file_path"), "line", "is_harness")
    asked = start.select(*CALL).distinct().join(events.select(*CALL), CALL, "left_semi")
    up = closure(events, asked, down=False, steps=steps).select("run", "process", "origin", "call_id", "distance")
    own = asked.select("run", "process", F.col("call_id").alias("origin"), "call_id", F.lit(0).alias("distance"))
    nodes = events.select(*CALL, node.alias("node"), F.col("parent_call_id").isNull().alias("top"))
    steps = up.unionByName(own).join(nodes, CALL, "left")
    # without a root among them the chain is broken or runs in a circle
    rows = steps.groupBy("run", "process", "origin").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "node"))).alias("steps"), F.bool_or(F.coalesce("top", F.lit(False))).alias("rooted"), F.bool_and(F.col("node").isNotNull()).alias("whole"))
    path = F.transform("steps", lambda x: x["node"])
    return rows.select("run", "process", F.col("origin").alias("call_id"), F.when(F.col("rooted") & F.col("whole"), path).otherwise(F.array().cast(rows.select(path.alias("p")).schema["p"].dataType)).alias("path"))
