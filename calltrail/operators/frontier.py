"""The frontier: lowest diverged keys of the call tree, why a node is not verified, and what edited files explain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.functions import scalars as S
from calltrail.operators import tree
from calltrail.operators.keys import KEY

REASONS = ("MemberLifecycle", "SubtreeUnalignable", "NodePartial", "DescendantPartial", "DescendantSkipped", "DescendantSourceUnresolved")
# The texts of reasons; %s stands for what the reason is about.
REASON_TEXT = {
    "MemberLifecycle": "MemberLifecycle: the member exists on only one side, so it has no counterpart to compare descendants against. This says the PR added or removed it, not that it caused anything.",
    "SubtreeUnalignable": "SubtreeUnalignable: call count differs, descendants are not alignable",
    "NodePartial": "NodePartial: this key's own digest is Partial",
    "DescendantPartial": "DescendantPartial: %s has a Partial digest, so 'identical' does not establish identical behavior",
    "DescendantSkipped": "DescendantSkipped: %s, which was never instrumented, so a call to it from this subtree would be invisible",
    "DescendantSourceUnresolved": "DescendantSourceUnresolved: %s, so a divergence in it could not be attributed",
}


def diverged_keys(divergences: DataFrame) -> DataFrame:
    """A row per key: distinct symptoms (kind:detail, by kind, then first occurrence), how often each occurs, and whether its calls can be aligned between the runs."""
    kinds = F.col("kind")
    per = divergences.groupBy(*KEY, "kind", "detail").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("n"), F.min_by("file_path", "ordinal").alias("file_path"))
    s = F.array_sort(F.collect_list(F.struct("kind", "ordinal", "detail", "n")))  # a row per kind and detail
    return per.groupBy(*KEY).agg(
        F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["detail"])).alias("symptoms"), F.transform(s, lambda x: x["n"]).alias("symptom_counts"),
        F.min_by("file_path", F.struct("ordinal", "kind")).alias("file_path"),
        F.bool_or(kinds.isin("MethodAdded", "MethodRemoved")).alias("lifecycle"),
        F.bool_or(kinds.isin("MethodAdded", "MethodRemoved", "CallCountChange")).alias("unalignable"),
    )


def _calls_of(keys: DataFrame, base_events: DataFrame, circling: DataFrame | None) -> DataFrame:
    """The calls of keys, with their keys, but for those in a cycle and below one: nothing is above or below these."""
    calls = base_events.join(keys.select(*KEY), KEY, "left_semi").select(*tree.CALL, *KEY)
    return tree.stored(calls if circling is None else calls.join(circling, tree.CALL, "left_anti"))


def collateral_keys(keys: DataFrame, base_events: DataFrame, steps: tree.Steps) -> DataFrame:
    """Alignable diverged keys with a diverged call below one of theirs; steps: those of the base events."""
    calls = _calls_of(keys, base_events, steps.circling())
    above = calls.join(tree.marked(base_events, calls, down=False, steps=steps), tree.CALL, "left_semi").select(*KEY).distinct()
    return keys.where("NOT unalignable").select(*KEY).join(above, KEY, "left_semi")


def subtrees(nodes: DataFrame, base_events: DataFrame, steps: tree.Steps) -> DataFrame:
    """The base events that are an alignable node's calls or lie below one; what else the run did is not numbered."""
    calls = _calls_of(nodes.where("NOT unalignable"), base_events, steps.circling()).select(*tree.CALL)
    mine = calls.unionByName(tree.marked(base_events, calls, down=True, steps=steps)).distinct()
    return tree.stored(base_events.select(*tree.CALL, "parent_call_id", "line_number", *KEY).join(mine, tree.CALL, "left_semi"))


def descendants(nodes: DataFrame, base_events: DataFrame, order: DataFrame) -> DataFrame:
    """(test_id, method, d_test_id, d_method, found_at): distinct keys below each alignable node's calls, and where a walk of these calls, as they were loaded, first meets each.

    base_events may be the nodes' subtrees only; order: tree.labels of them."""
    calls = base_events.join(nodes.where("NOT unalignable").select(*KEY), KEY, "left_semi").select(*tree.CALL, *KEY, F.col("line_number").alias("from_line"))
    named = order.join(base_events.select(*tree.CALL, F.col("test_id").alias("d_test_id"), F.col("method").alias("d_method")), tree.CALL)
    found_at = F.struct("process", F.col("from_line").alias("line_number"), "pre")
    return tree.below(named, calls, (*KEY, "from_line")).groupBy(*KEY, "d_test_id", "d_method").agg(F.min(found_at).alias("found_at"))


def downgrade_reasons(nodes: DataFrame, below: DataFrame, matched: DataFrame, members: DataFrame, strict_aliases: bool = False) -> DataFrame:
    """(test_id, method, reasons): of each category the first that a walk meets (the node's own method comes after those below it), in the order of REASONS; none means verified.

    A member's source is unresolved where its own manifest record says so; a record without a resolution says nothing.
    """
    partial = matched.where("confidence = 'Partial'").select(*KEY)
    usable = S.USABLE_RESOLUTIONS[2:] if strict_aliases else S.USABLE_RESOLUTIONS
    unresolved = members.where(F.col("source_resolution").isNotNull() & ~F.col("source_resolution").isin(*usable)).groupBy("method").agg(F.max_by("source_resolution", F.struct("process", "line_number")).alias("resolution"))
    skipped = members.where("status = 'Skipped' AND NOT (skip_reason <=> 'Unobservable')").select(S.declaring_type(F.col("method")).alias("type"), F.concat(F.col("method"), F.coalesce(F.concat(F.lit(" ("), "skip_reason", F.lit(")")), F.lit(""))).alias("text"), "process", "line_number")
    last_skipped = skipped.groupBy("type").agg(F.max_by("text", F.struct("process", "line_number")).alias("skipped"))
    category = lambda df, name, what: df.select(*KEY, F.lit(name).alias("category"), what.alias("what"), "at")
    at = F.struct(F.lit(0).alias("own"), "found_at").alias("at")
    of_node = nodes.withColumn("at", F.struct(F.lit(1).alias("own"), F.lit(None).cast(below.schema["found_at"].dataType).alias("found_at")))
    seen = below.select(*KEY, "d_test_id", "d_method", at)
    d_partial = seen.join(partial.select(F.col("test_id").alias("d_test_id"), F.col("method").alias("d_method")), ["d_test_id", "d_method"], "left_semi")
    methods = seen.drop("d_test_id").unionByName(of_node.select(*KEY, F.col("method").alias("d_method"), "at"))
    d_skipped = methods.withColumn("type", S.declaring_type(F.col("d_method"))).join(last_skipped, "type")
    d_unresolved = seen.select(*KEY, F.col("d_method").alias("dm"), "at").join(unresolved.withColumnRenamed("method", "dm"), "dm")
    parts = [
        category(of_node.where("lifecycle"), "MemberLifecycle", F.lit("")),
        category(of_node.where("unalignable AND NOT lifecycle"), "SubtreeUnalignable", F.lit("")),
        category(of_node.join(partial, KEY, "left_semi"), "NodePartial", F.lit("")),
        category(d_partial, "DescendantPartial", F.col("d_method")),
        category(d_skipped, "DescendantSkipped", F.concat_ws(" also declares ", "type", "skipped")),
        category(d_unresolved, "DescendantSourceUnresolved", F.concat("dm", F.lit(" resolved its source as '"), "resolution", F.lit("'"))),
    ]
    first = reduce(DataFrame.unionByName, parts).groupBy(*KEY, "category").agg(F.min_by("what", F.struct("at", "what")).alias("what"))
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("category"))
    texts = F.create_map(*[F.lit(x) for pair in REASON_TEXT.items() for x in pair])
    text = F.replace(texts[F.col("category")], F.lit("%s"), F.col("what"))
    return first.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.alias("t")))), lambda x: x["t"]).alias("reasons"))


def reacting_tests(harness_divergences: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Tests whose own trace diverged; rows of methods known not to be test roots do not count, unknown ones do."""
    if members is not None:
        harness_divergences = harness_divergences.join(members.where("is_test_root = false").select("method").distinct(), "method", "left_anti")
    return harness_divergences.select("test_id").distinct()


def frontier(divergences: DataFrame, harness_divergences: DataFrame, base_events: DataFrame, matched: DataFrame, members: DataFrame, strict_aliases: bool = False, steps: tree.Steps | None = None) -> DataFrame:
    """A row per diverged key: classification (frontier, frontier_unverified, collateral), symptoms, reasons, descendants compared, untested.

    Descendants come from the base run's tree only: a key that the base lacks has none and is a node. steps: those of the base events, if there are any.
    """
    keys, steps = tree.stored(diverged_keys(divergences)), steps or tree.Steps(base_events)
    collateral = tree.stored(collateral_keys(keys, base_events, steps))
    nodes = tree.stored(keys.join(collateral, KEY, "left_anti"))
    under = subtrees(nodes, base_events, steps)
    below = tree.stored(descendants(nodes, under, tree.labels(under)))
    reasons = downgrade_reasons(nodes, below, matched, members, strict_aliases)
    compared = below.groupBy(*KEY).agg(F.count("*").alias("descendant_keys_compared"))
    line = base_events.join(keys.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min_by("line", F.struct("process", "line_number")).alias("line"))
    reacted = reacting_tests(harness_divergences, members).withColumn("reacted", F.lit(True))
    empty = F.array().cast("array<string>")
    out = keys.join(collateral.withColumn("is_collateral", F.lit(True)), KEY, "left").join(reasons, KEY, "left").join(compared, KEY, "left").join(line, KEY, "left").join(reacted, "test_id", "left")
    hidden = F.coalesce("is_collateral", F.lit(False))
    found = F.when(hidden, empty).otherwise(F.coalesce("reasons", empty))
    return out.select(
        *KEY, "file_path", "line", "symptoms", "symptom_counts", found.alias("reasons"), F.when(hidden, "collateral").when(F.size(found) > 0, "frontier_unverified").otherwise("frontier").alias("classification"),
        F.coalesce("descendant_keys_compared", F.lit(0)).cast("long").alias("descendant_keys_compared"), F.coalesce("reacted", F.lit(False)).__invert__().alias("untested"),
    )


def attribute(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Adds attribution: EXPECTED in an edited file, UNEXPECTED elsewhere and without a path."""
    files = changed.select(F.col("path").alias("file_path")).distinct().withColumn("edited", F.lit(True))
    return nodes.join(files, "file_path", "left").withColumn("attribution", F.when(F.col("edited"), "EXPECTED").otherwise("UNEXPECTED")).drop("edited").select(*nodes.columns, "attribution")


def members_of_files(changed: DataFrame, members: DataFrame) -> DataFrame:
    """(path, method, status, skip_reason) by module name = path, or by type name = file stem; two equi-joins instead of one disjunction."""
    files = changed.select("path").distinct()
    m = members.select("assembly", "method", "status", "skip_reason")
    by_module = files.join(m, F.col("assembly") == F.col("path"))
    by_type = files.withColumn("stem", S.file_stem(F.col("path"))).join(m.withColumn("stem", S.simple_type(S.declaring_type(F.col("method")))), "stem")
    cols = ["path", "assembly", "method", "status", "skip_reason"]
    return by_module.select(*cols).unionByName(by_type.select(*cols)).distinct()


def skip_reasons(changed: DataFrame, members: DataFrame) -> DataFrame:
    """(path, skip_reason, members): why members of edited files were not observed."""
    skipped = members_of_files(changed, members).where("status = 'Skipped'")
    return skipped.groupBy("path", F.coalesce("skip_reason", F.lit("")).alias("skip_reason")).agg(F.count("*").alias("members"))


def changed_file_coverage(changed: DataFrame, base_events: DataFrame, pr_events: DataFrame) -> DataFrame:
    """Per edited file: distinct members, distinct call sites (keys), calls of either run, exercised."""
    side = lambda df, b: df.where("NOT is_harness").select(F.col("relative_path").alias("path"), *KEY, F.lit(b).alias("in_base"))
    rows = side(base_events, True).unionByName(side(pr_events, False))
    joined = changed.select("path").distinct().join(rows, "path", "left")
    out = joined.groupBy("path").agg(
        F.count_distinct("method").alias("members"), F.count_distinct("test_id", "method").alias("call_sites"),
        F.count_if(F.col("in_base")).alias("base_calls"), F.count_if(~F.col("in_base")).alias("pr_calls"),
    )
    return out.withColumn("exercised", (F.col("base_calls") + F.col("pr_calls")) > 0)


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """One row over changed_file_coverage: sums of the files' own distinct counts."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return coverage.agg(
        F.count("*").alias("edited_files"), F.count_if("exercised").alias("exercised_files"), total("members").alias("traced_members"), total("call_sites").alias("observed_call_sites"),
        total("base_calls").alias("base_calls"), total("pr_calls").alias("pr_calls"), (total("base_calls") + total("pr_calls")).alias("total_calls"),
    )


def attribution_refusals(nodes: DataFrame, changed: DataFrame, base_events: DataFrame, members: DataFrame) -> DataFrame:
    """(code, message, observed, required) of gates that fail; empty means attribution can be trusted."""
    spark = nodes.sparkSession
    n_nodes, n_changed = nodes.where("classification <> 'collateral'").count(), changed.select("path").distinct().count()
    paths = base_events.where("relative_path <> ''").select(F.col("relative_path").alias("path")).distinct()
    exact = changed.join(paths, "path", "left_semi").select("path").distinct().count()
    segment = lambda df: df.select(S.first_segment(F.col("path")).alias("seg")).distinct()
    shared = segment(changed).join(segment(paths), "seg", "left_semi").count()
    out = []
    if n_changed == 0 and n_nodes > 0:
        out.append(("ATTRIBUTION_EMPTY", "no changed files, but there are frontier nodes to attribute", n_nodes, 0))
    if n_changed > 0 and shared == 0:
        out.append(("ATTRIBUTION_NAMESPACE", "no changed path shares a root segment with a traced path", shared, 1))
    if n_changed > 0 and n_nodes > 0 and exact == 0:
        per = changed.select("path").distinct().join(members_of_files(changed, members), "path", "left")
        untraced = per.groupBy("path").agg(F.bool_and(F.coalesce((F.col("status") == "Skipped") & F.col("skip_reason").isin("ExcludedByScope", "Unobservable"), F.lit(False))).alias("all_skipped"))
        if untraced.where("NOT all_skipped").count() > 0:
            out.append(("ATTRIBUTION_UNOBSERVED", "no changed file contributed a traced member", exact, 1))
    return spark.createDataFrame(out, "code string, message string, observed long, required long")
