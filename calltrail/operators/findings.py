"""Findings: evidence with call paths, roll-ups by member, consequences, and the model of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltrail.functions import scalars as S
from calltrail.operators import tree
from calltrail.operators.keys import KEY

_ATTRIBUTED = "classification <> 'collateral'"


Above = tuple[tree.Steps | None, tree.Steps | None]  # of the base and of the proposed run's events


def _paths(divergences: DataFrame, events: DataFrame, name: str, above: tree.Steps | None) -> DataFrame:
    """(test_id, method, ordinal, name): the call path of the call whose own ordinal a divergence names."""
    calls = events.join(divergences.where("ordinal >= 0").select(*KEY, "ordinal").distinct(), [*KEY, "ordinal"])
    first = tree.stored(calls.groupBy(*KEY, "ordinal").agg(F.min_by(F.struct(*tree.CALL), F.struct("process", "line_number")).alias("c")).select(*KEY, "ordinal", "c.*"))
    paths = tree.call_paths(events, first, above)
    return first.join(paths, tree.CALL).select(*KEY, "ordinal", F.col("path").alias(name))


def _described(rows: DataFrame, nodes: DataFrame, base_events: DataFrame, pr_events: DataFrame, changed: DataFrame, above: Above) -> DataFrame:
    """Divergences with values and paths of exact occurrences, whether an assertion reacted (null: not known), and edited files on the paths; other columns stay."""
    reaction = nodes.where(_ATTRIBUTED).groupBy("test_id").agg(F.bool_and("untested").alias("untested"))
    rows = rows.join(_paths(rows, base_events, "base_path", above[0]), [*KEY, "ordinal"], "left").join(_paths(rows, pr_events, "pr_path", above[1]), [*KEY, "ordinal"], "left").join(reaction, "test_id", "left")
    empty = F.array().cast(rows.schema["base_path"].dataType)
    both = F.concat(F.coalesce("base_path", empty), F.coalesce("pr_path", empty))
    shown = ("base_args", "pr_args", "base_return", "pr_return", "base_exception", "pr_exception")
    out = rows.withColumns({c: F.when(F.col("ordinal") >= 0, F.col(c)) for c in shown} | {"assertion_reacted": ~F.col("untested"), "files": F.array_distinct(F.array_compact(F.transform(both, lambda n: n["file_path"])))}).drop("untested")
    on_path = out.select(*KEY, "ordinal", "kind", F.explode("files").alias("path")).join(changed.select("path").distinct(), "path", "left_semi").groupBy(*KEY, "ordinal", "kind").agg(F.array_sort(F.collect_set("path")).alias("changed_files_on_path"))
    return out.drop("files").join(on_path, [*KEY, "ordinal", "kind"], "left").withColumn("changed_files_on_path", F.coalesce("changed_files_on_path", F.array().cast("array<string>")))


def of_members(divergences: DataFrame, nodes: DataFrame) -> DataFrame:
    """The divergences of frontier members, as evidence has them before it is described."""
    return divergences.join(nodes.where(_ATTRIBUTED).select("method").distinct(), "method", "left_semi")


def with_base_paths(divergences: DataFrame, nodes: DataFrame, base_events: DataFrame, steps: tree.Steps | None = None) -> DataFrame:
    """(test_id, method, ordinal, base_path) of each piece of evidence: what asks for no other path walks no other run."""
    rows = of_members(divergences, nodes).select(*KEY, "ordinal")
    return rows.join(_paths(rows, base_events, "base_path", steps), [*KEY, "ordinal"], "left")


EVIDENCE = [*KEY, "ordinal", "kind", "detail", "confidence", "base_args", "pr_args", "base_return", "pr_return", "base_exception", "pr_exception", "base_path", "pr_path", "assertion_reacted", "changed_files_on_path"]


def evidence(divergences: DataFrame, nodes: DataFrame, base_events: DataFrame, pr_events: DataFrame, changed: DataFrame, above: Above = (None, None)) -> DataFrame:
    """A row per divergence of a frontier member, as of _described. above: steps that consequences can go on with."""
    return _described(of_members(divergences, nodes), nodes, base_events, pr_events, changed, above).select(*EVIDENCE)


def first_evidence(ev: DataFrame) -> DataFrame:
    """The first evidence of each member and test: by ordinal, then kind and detail."""
    kept = [c for c in ev.columns if c not in KEY]
    return ev.groupBy("method", "test_id").agg(F.min_by(F.struct(*kept), F.struct("ordinal", "kind", "detail")).alias("e")).select("test_id", "method", "e.*").select(*ev.columns)


def members(nodes: DataFrame, divergences: DataFrame, base_events: DataFrame, pr_events: DataFrame) -> DataFrame:
    """A row per frontier member, from attributed nodes."""
    n = nodes.where(_ATTRIBUTED)
    # distinct texts first: a member may have very many call sites with the same few
    distinct = lambda c: n.select("method", F.explode(c).alias("x")).distinct().groupBy("method").agg(F.array_sort(F.collect_list("x")).alias(c))
    rolled = n.groupBy("method").agg(
        F.min_by(F.struct("attribution", "file_path", "line", "classification"), "test_id").alias("first"), F.count("*").alias("call_sites"),
        F.sum("descendant_keys_compared").cast("long").alias("descendants_compared"), F.count_if("untested").alias("untested_call_sites"),
    )
    empty = F.array().cast("array<string>")
    rolled = rolled.join(distinct("symptoms"), "method", "left").join(distinct("reasons"), "method", "left").withColumns({c: F.coalesce(c, empty) for c in ("symptoms", "reasons")})
    executing = base_events.select(*KEY).unionByName(pr_events.select(*KEY)).join(n.select("method").distinct(), "method", "left_semi").groupBy("method").agg(F.count_distinct("test_id").alias("executing_tests"))
    observing = divergences.select("test_id", "method").distinct().join(n.select("test_id", "method", "untested"), KEY, "left").groupBy("method").agg(F.count("*").alias("observing_tests"), F.count_if(~F.col("untested")).alias("reacting_tests"))
    out = rolled.join(executing, "method", "left").join(observing, "method", "left").na.fill(0, ["executing_tests", "observing_tests", "reacting_tests"])
    return out.select(
        "method", F.lower("first.attribution").alias("attribution"), F.col("first.file_path").alias("file_path"), F.col("first.line").alias("line"), S.is_generated_source(F.col("first.file_path")).alias("source_generated"),
        "call_sites", "executing_tests", "observing_tests", "reacting_tests", S.assertion_reaction(F.col("executing_tests"), F.col("reacting_tests")).alias("assertion_reaction"), (F.col("first.classification") == "frontier").alias("verified"),
        "symptoms", "reasons", "descendants_compared", "untested_call_sites",
    )


def reaching_files(ev: DataFrame) -> DataFrame:
    """(method, changed_files): the edited files on the paths of a member's evidence."""
    return ev.select("method", F.explode("changed_files_on_path").alias("path")).distinct().groupBy("method").agg(F.array_sort(F.collect_list("path")).alias("changed_files"))


def observing_tests(divergences: DataFrame, nodes: DataFrame) -> DataFrame:
    """(method, test_id, reacted): the tests that observed each frontier member's change, and whether one of their assertions reacted."""
    mine = nodes.where(_ATTRIBUTED).select("test_id", "method", (~F.col("untested")).alias("reacted"))
    seen = divergences.select("test_id", "method").distinct().join(mine.select("method").distinct(), "method", "left_semi")
    return seen.join(mine, KEY, "left").select("method", "test_id", F.coalesce("reacted", F.lit(False)).alias("reacted"))


def summary(found: DataFrame) -> DataFrame:
    """Totals over members: by attribution, call sites, verified, untested, clean."""
    is_ = lambda a: F.col("attribution") == a
    one = found.agg(
        F.count("*").alias("members"), F.count_if(is_("unexpected")).alias("unexpected_members"), F.count_if(is_("expected")).alias("expected_members"),
        F.coalesce(F.sum(F.when(is_("unexpected"), F.col("call_sites"))), F.lit(0)).alias("unexpected_call_sites"), F.coalesce(F.sum(F.when(is_("expected"), F.col("call_sites"))), F.lit(0)).alias("expected_call_sites"),
        F.count_if("verified").alias("verified_members"), F.coalesce(F.sum("untested_call_sites"), F.lit(0)).alias("untested_call_sites"),
    )
    return one.withColumn("is_clean", F.col("unexpected_members") == 0)


def consequences(ev: DataFrame, divergences: DataFrame, nodes: DataFrame, base_events: DataFrame, pr_events: DataFrame, changed: DataFrame, above: Above = (None, None)) -> DataFrame:
    """(member, test_id, consequence, and the rest of an evidence row): the outermost subject ancestor on a member's evidence path, at its first call whose result differs."""
    product = lambda c: F.filter(F.coalesce(c, F.array().cast(ev.schema["base_path"].dataType)), lambda n: ~n["is_harness"] & (n["member"] != F.col("method")))
    first = lambda c: F.try_element_at(product(F.col(c)), F.lit(1))["member"]
    outer = ev.select(F.col("method").alias("member"), "test_id", F.coalesce(first("base_path"), first("pr_path")).alias("method")).where("method IS NOT NULL").distinct()
    differs = divergences.where("ordinal >= 0 AND NOT (base_return <=> pr_return AND base_exception <=> pr_exception)").join(outer.select(*KEY).distinct(), KEY, "left_semi")
    kept = [c for c in EVIDENCE if c in divergences.columns and c not in KEY]
    d = tree.stored(differs.groupBy(*KEY).agg(F.min_by(F.struct(*kept), F.struct("ordinal", "kind")).alias("d")).select(*KEY, "d.*"))
    described = _described(d, nodes, base_events, pr_events, changed, above)
    return outer.join(described, KEY).select("member", "test_id", F.col("method").alias("consequence"), *[c for c in EVIDENCE if c not in KEY])


def observations(ev: DataFrame) -> DataFrame:
    """Identical observations of a member collapsed, with the number of tests that saw them; ev: evidence, described or not."""
    shown = [S.display_text(F.coalesce(c, F.lit(""))).alias(c) for c in ("base_args", "base_return", "pr_return", "base_exception", "pr_exception")]
    return ev.where("ordinal >= 0").select("method", "test_id", *shown).groupBy("method", "base_args", "base_return", "pr_return", "base_exception", "pr_exception").agg(F.count("*").alias("times"), F.count_distinct("test_id").alias("tests"))


def argument_values(ev: DataFrame) -> DataFrame:
    """Per member and argument name the values seen, as name={a,b}; ev: evidence, described or not."""
    pair = F.explode(F.split(S.display_text(F.col("base_args")), ", "))
    rows = ev.where("ordinal >= 0 AND base_args IS NOT NULL").select("method", pair.alias("pair")).select("method", F.substring_index("pair", "=", 1).alias("name"), F.expr("substring(pair, instr(pair, '=') + 1)").alias("value"))
    return rows.groupBy("method", "name").agg(F.array_sort(F.collect_set("value")).alias("vs")).select("method", "name", F.concat(F.col("name"), F.lit("={"), F.array_join("vs", ","), F.lit("}")).alias("seen"))


def distinct_paths(ev: DataFrame) -> DataFrame:
    """Call paths of each member with how often they occur; ev: evidence or with_base_paths."""
    text = F.array_join(F.transform("base_path", lambda n: S.short_member(n["member"])), " > ")
    return ev.where("base_path IS NOT NULL").select("method", text.alias("path")).groupBy("method", "path").agg(F.count("*").alias("times"))


def comment_model(found: DataFrame, limit: int = 100) -> DataFrame:
    """Members in report order with their section: gap (untested call sites) or covered; the first is the lead."""
    order = [F.when(F.col("attribution") == "unexpected", 0).otherwise(1), F.desc("call_sites"), "method"]
    top = found.orderBy(*order).limit(limit)
    w = Window.orderBy(*order)  # over at most limit rows
    return top.withColumn("place", F.row_number().over(w)).withColumn("section", F.when(F.col("untested_call_sites") > 0, "gap").otherwise("covered")).withColumn("lead", F.col("place") == 1)


def within_budget(rows: DataFrame, text: str, partition: str, order: str, budget: int = 56_000) -> DataFrame:
    """Rows of a partition in order while their texts fit the budget together."""
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length(text)).over(w)).where(F.col("used") <= budget)


def ungrounded(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """claims (claim_id, citations) with the citations that the corpus (citation) does not hold; none left means accepted."""
    each = claims.select("claim_id", F.explode_outer("citations").alias("citation"))
    bad = each.where("citation IS NOT NULL").join(corpus.select("citation").distinct(), "citation", "left_anti").groupBy("claim_id").agg(F.array_sort(F.collect_set("citation")).alias("missing"))
    return claims.select("claim_id").join(bad, "claim_id", "left").select("claim_id", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.col("missing").isNull().alias("accepted"))

