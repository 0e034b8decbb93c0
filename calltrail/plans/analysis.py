"""The whole analysis: base runs and a proposed run in, attributed frontier and findings out, or a refusal.

Refusals are rows, collected from every gate before anything is decided; a refused result has no members table at all,
so that it can't be mistaken for a clean one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from calltrail import tables
from calltrail.operators import checks, findings, frontier, keys, manifests, tree


#: What is kept of the base run's calls to answer for a path.
CALL_TREE = ["run", "process", "line_number", "call_id", "parent_call_id", *keys.KEY, "ordinal", "relative_path", "line", "is_harness"]


@dataclass
class Divergences:
    """The comparison stage: what is left after noise and gaps, and everything that was set aside."""

    remaining: DataFrame
    harness: DataFrame
    matched: DataFrame
    noise: DataFrame
    gaps: DataFrame
    manifest_noise: DataFrame
    measures: DataFrame
    refusals: DataFrame
    #: rows of each step, counted by the pass that made it
    steps: dict[str, Observation] = field(default_factory=dict)

    def step_counts(self) -> list[tuple[str, int]]:
        return [(name, seen.get["rows"]) for name, seen in self.steps.items()]


@dataclass
class Analysis:
    status: str  # analyzed or refused
    refusals: list = field(default_factory=list)
    exit_code: int = 0
    divergences: Divergences | None = None
    nodes: DataFrame | None = None
    members: DataFrame | None = None
    evidence: DataFrame | None = None
    consequences: DataFrame | None = None
    coverage: DataFrame | None = None
    call_tree: DataFrame | None = None
    known_members: DataFrame | None = None
    skip_reasons: DataFrame | None = None


def diff(events: DataFrame, members: DataFrame, modules: DataFrame, changed: DataFrame, bases: list[str], pr: str = "pr") -> Divergences:
    """events, members and modules of all runs in one table each, told apart by run."""
    of = lambda df, r: df.where(F.col("run") == r)
    base_events, pr_events = of(events, bases[0]), of(events, pr)
    steps: dict[str, Observation] = {}

    def step(name: str, df: DataFrame) -> DataFrame:
        out, steps[name] = tables.counted(df)
        return out

    merged, mods = step("members", manifests.merge_members(members)), step("modules", manifests.merge_modules(modules))
    quiet = manifests.manifest_noise(merged, mods, bases)
    gaps = step("gaps", manifests.without_manifest_noise(manifests.manifest_diff(of(merged, bases[0]), of(merged, pr), of(mods, bases[0]), of(mods, pr)), quiet))
    noise = step("noise_keys", keys.noise_keys(events.where(F.col("run").isin(bases))))
    found = step("divergences", keys.compare(base_events, pr_events))
    left = keys.without_noise(found, noise, manifests.gap_methods(gaps, changed, base_events, pr_events))
    born = manifests.lifecycle_divergences(gaps, base_events, pr_events, changed)
    missing = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in ("base_args", "pr_args", "base_return", "pr_return", "base_exception", "pr_exception")]
    born = born.select("test_id", "method", F.lit(-1).alias("ordinal"), "kind", "detail", F.lit("Exact").alias("confidence"), F.array().cast("array<string>").alias("markers"), "file_path", *missing, F.lit(False).alias("is_harness"))
    matched = step("matched_keys", keys.matched_keys(base_events, pr_events))
    measures = checks.volume(events, matched, noise, bases[0], bases[1], pr)
    return Divergences(step("remaining", left.unionByName(born)), found.where("is_harness"), matched, noise, gaps, quiet, measures, checks.volume_refusals(measures), steps)


def analyze(events: DataFrame, members: DataFrame, modules: DataFrame, changed: DataFrame, bases: list[str], pr: str = "pr", load: DataFrame | None = None, accounting: DataFrame | None = None) -> Analysis:
    """accounting: rows of checks.manifest_violations, none where all manifests add up.

    exit_code: 0 clean, 1 unexpected changes, 3 attribution impossible, 4 invalid or degenerate input."""
    of = lambda df, r: df.where(F.col("run") == r)
    d = diff(events, members, modules, changed, bases, pr)
    refusals = d.refusals.collect() + (checks.input_refusals(load).collect() if load is not None else [])
    gaps = keys.ordinal_violations(events.where(F.col("run").isin(*bases, pr))).count()
    if gaps:
        refusals.append(("ORDINALS", "keys whose calls are not numbered from 0 without a gap", float(gaps), 0.0))
    unaccounted = 0 if accounting is None else accounting.count()
    if unaccounted:
        refusals.append(("MANIFESTS", "manifests whose records and sums do not add up", float(unaccounted), 0.0))
    lost = tree.orphans(of(events, bases[0])).count()
    if lost:
        refusals.append(("ORPHANS", "calls whose parent is not in their process", float(lost), 0.0))
    if refusals:
        return Analysis("refused", [tuple(r) for r in refusals], 4, d)
    base_events, pr_events = of(events, bases[0]), of(events, pr)
    known = tree.stored(of(manifests.merge_members(members), bases[0]))
    above = tree.Steps(base_events), tree.Steps(pr_events)
    nodes = tree.stored(frontier.attribute(frontier.frontier(d.remaining, d.harness, base_events, d.matched, known, steps=above[0]), changed))
    gates = [tuple(r) for r in frontier.attribution_refusals(nodes, changed, base_events, known).collect()]
    if gates:
        return Analysis("refused", gates, 3 if any(g[0] == "ATTRIBUTION_UNOBSERVED" for g in gates) else 4, d)
    found = findings.members(nodes, d.remaining, base_events, pr_events)
    evidence = tree.stored(findings.evidence(d.remaining, nodes, base_events, pr_events, changed, above))
    effects = findings.consequences(evidence, d.remaining, nodes, base_events, pr_events, changed, above)
    code = 1 if found.where("attribution = 'unexpected'").limit(1).count() else 0
    return Analysis("analyzed", [], code, d, nodes, found, evidence, effects, frontier.changed_file_coverage(changed, base_events, pr_events), base_events.select(*CALL_TREE), known, frontier.skip_reasons(changed, known))
