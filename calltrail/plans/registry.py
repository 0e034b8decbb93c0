"""The trace engine's registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrail import tables
from calltrail.functions import digest
from calltrail.functions import scalars as S
from calltrail.operators import checks, findings, frontier, keys, manifests, studies, tree
from calltrail.plans import adapter, audits, inputs
from calltrail.sources import traces

Query = Callable[[SparkSession, str], DataFrame]
_B = adapter.BASES
_KEY_SQL = "test_id, method"


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


def _of(spark, sf_dir, name):
    return adapter.run(spark, sf_dir, name)


def _bases(spark, sf_dir):
    return adapter.runs(spark, sf_dir, tuple(_B))


def _compare(spark, sf_dir):
    return keys.compare(_of(spark, sf_dir, "base1"), _of(spark, sf_dir, "pr"))


def _matched(spark, sf_dir):
    return keys.matched_keys(_of(spark, sf_dir, "base1"), _of(spark, sf_dir, "pr"))


def _remaining(spark, sf_dir):
    return keys.without_noise(_compare(spark, sf_dir), keys.noise_keys(_bases(spark, sf_dir)))


def _members(spark, name="base1"):
    return manifests.merge_members(adapter.members(spark)).where(F.col("run") == name)


def _modules(spark, name):
    return manifests.merge_modules(adapter.modules(spark)).where(F.col("run") == name)


def _gaps(spark):
    return manifests.manifest_diff(_members(spark, "base1"), _members(spark, "pr"), _modules(spark, "base1"), _modules(spark, "pr"))


def _nodes(spark, sf_dir):
    return _walked(spark, sf_dir)[0]


def _walked(spark, sf_dir):
    """Nodes of the frontier, what was left to walk, and the runs: each read many times, so each a table."""
    calls = tables.bucketed(adapter.calls(spark, sf_dir), "test_id")
    of = lambda *names: adapter.as_runs(calls, names)
    base, pr, both = of("base1"), of("pr"), of("base1", "pr")
    found = tree.stored(keys.compare_in(both, "base1", "pr"))
    left = tree.stored(keys.without_noise(found, keys.noise_keys(of(*_B))))
    nodes = frontier.frontier(left, found.where("is_harness"), base, keys.matched_keys_in(both, "base1", "pr"), _members(spark))
    return tree.stored(frontier.attribute(nodes, adapter.changed(spark))), left, base, pr


def _found(spark, sf_dir):
    return findings.members(*_walked(spark, sf_dir))


def _documents(spark, sf_dir, *cols):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols)


def _conversation_events(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.lit("c").alias("run"), F.lit("p0").alias("process"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("test_id"), F.lit("turn").alias("method"), F.col("turn").cast("int").alias("ordinal"))


def _path_sql_input() -> str:
    return "CASE WHEN page_id % 5 = 0 THEN '/_/' || substr(url, 9) WHEN page_id % 5 = 1 THEN 'C:\\\\Repo\\\\' || replace(substr(url, 9), '/', '\\\\') WHEN page_id % 5 = 2 THEN 'src\\\\' || substr(url, 9) WHEN page_id % 5 = 3 THEN '/elsewhere/' || substr(url, 9) END"


def _paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(_path_sql_input()).alias("path"))
    root = F.lit("c:/repo/")
    return p.select("page_id", S.path_class(F.col("path"), root).alias("path_class"), S.normalize_path(F.col("path"), root).alias("relative"))


def _digests(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", digest.json_digest("props").alias("d")).select("event_id", "d.*")


def _parsed_back(spark, sf_dir):
    """Events written as canonical lines and parsed again."""
    events = _of(spark, sf_dir, "base1")
    raw = traces.to_lines(events).select(F.lit("p").alias("process"), F.lit(1).alias("line_number"), F.col("value").alias("raw"))
    return traces.parse_events(raw).select("test_id", "method", "call_id", "parent_call_id", "ordinal", "return_rendered", "is_harness", "error")


def _descendants(spark, sf_dir):
    e = _of(spark, sf_dir, "base1")
    return tree.closure(e, tree.roots(e), down=True).groupBy(F.col("origin").alias("call_id")).agg(F.count("*").alias("descendants"), F.max("distance").cast("long").alias("depth"))


def queries() -> dict[str, Query]:
    d = adapter.changed
    return {
        "trace_summary": lambda s, p: studies.trace_summary(adapter.runs(s, p).withColumn("call_depth", F.when(F.col("parent_call_id").isNull(), 0).otherwise(F.col("call_id") % 9).cast("int")).select("run", "process", "test_id", "method", "thread_id", "call_id", "parent_call_id", "call_depth", "exception_type")),
        "call_positions": lambda s, p: keys.positions(_of(s, p, "base1")).select("test_id", "method", "call_id", "pos"),
        "ordinal_gaps": lambda s, p: keys.ordinal_violations(_conversation_events(s, p).where("NOT (test_id LIKE '%7' AND ordinal = 1)")).select("test_id", "calls", "least", "most"),
        "key_compare": lambda s, p: _compare(s, p).where("ordinal < 0").select("test_id", "method", "kind", "detail", "confidence", "is_harness"),
        "matched_keys": lambda s, p: _matched(s, p).select("test_id", "method", "base_calls", "pr_calls", "confidence", _joined("markers"), "file_path"),
        "digest_divergences": lambda s, p: _compare(s, p).where("ordinal >= 0").select("test_id", "method", "ordinal", "detail", "confidence", "base_return", "pr_return", "is_harness"),
        "noise_keys": lambda s, p: keys.noise_keys(_bases(s, p)),
        "noise_first_divergence": lambda s, p: keys.noise_divergences(tables.bucketed(_bases(s, p), "test_id"), _B).select("test_id", "method", "left_run", "right_run", "ordinal", "kind", "difference_count"),
        "noise_growth": lambda s, p: studies.noise_growth(_bases(s, p), _B),
        "noise_classification": lambda s, p: studies.classify_variation(adapter.runs(s, p)),
        "count_spread": lambda s, p: studies.count_spread(adapter.runs(s, p)),
        "divergences_after_noise": lambda s, p: _remaining(s, p).select("test_id", "method", "ordinal", "kind", "detail"),
        "divergences_by_kind": lambda s, p: _remaining(s, p).groupBy("kind").agg(F.count("*").alias("n")),
        "volume_gate": lambda s, p: checks.volume(adapter.runs(s, p), _matched(s, p), keys.noise_keys(_bases(s, p))),
        "orphans": lambda s, p: tree.orphans(_of(s, p, "pr").where("call_id % 7 <> 0")).select("test_id", "call_id", "parent_call_id"),
        "descendant_counts": _descendants,
        "call_paths": lambda s, p: tree.call_paths(_of(s, p, "base1"), _of(s, p, "base1")).select("call_id", F.array_join(F.transform("path", lambda n: n["member"]), " > ").alias("path")),
        "frontier_nodes": lambda s, p: _nodes(s, p).select("test_id", "method", "classification", "untested", "descendant_keys_compared", _joined("symptoms")),
        "downgrade_reasons": lambda s, p: _nodes(s, p).where("classification <> 'collateral'").select("test_id", "method", _joined("reasons")),
        "attribution": lambda s, p: _nodes(s, p).where("classification <> 'collateral'").groupBy("attribution", "classification").agg(F.count("*").alias("nodes"), F.count_distinct("method").alias("members")),
        "changed_file_coverage": lambda s, p: frontier.changed_file_coverage(d(s), _of(s, p, "base1"), _of(s, p, "pr")),
        "findings_members": lambda s, p: _found(s, p).select("method", "attribution", "file_path", "call_sites", "executing_tests", "observing_tests", "reacting_tests", "assertion_reaction", "descendants_compared", "untested_call_sites"),
        "findings_summary": lambda s, p: findings.summary(_found(s, p)),
        "top_untested": lambda s, p: _nodes(s, p).where("classification <> 'collateral' AND untested").groupBy("method", "attribution").agg(F.count("*").alias("call_sites")).orderBy(F.desc("call_sites"), "method").limit(50),
        "path_normalize": _paths,
        "declaring_type": lambda s, p: _documents(s, p, "doc_id", F.concat_ws(".", F.lit("App"), "lang", F.concat("source", F.lit("`1")), F.concat(F.lit("Run("), "lang", F.lit(".X)"))).alias("m")).select("doc_id", S.declaring_type(F.col("m")).alias("type"), S.simple_type(S.declaring_type(F.col("m"))).alias("simple"), S.short_member(F.col("m")).alias("short")),
        "redact": lambda s, p: _documents(s, p, "doc_id", F.sha2(S.redact(F.col("text")), 256).alias("shown"), S.sensitive_name(F.col("text")).alias("sensitive")),
        "sensitive_members": lambda s, p: _of(s, p, "base1").select("call_id", S.sensitive_name(F.concat("method", "args_rendered")).alias("sensitive"), S.digest_only_path(F.col("file_path"), ("src/click.py", "purchase.py")).alias("digest_only_path"), S.digest_only_type(F.concat(S.declaring_type(F.col("method")), F.lit("."), F.substring_index(F.substring_index("method", "(", 1), ".", -1)), ("app.view", "App.cl", "app.error")).alias("digest_only_type")),
        "side_identifiers": lambda s, p: _documents(s, p, "doc_id", S.side_identifiers(F.concat(F.lit("+"), F.replace("text", F.lit(". "), F.lit("\n-")))).alias("i")).select("doc_id", F.array_join(F.array_sort("i"), " ").alias("identifiers")),
        "sha_digest": lambda s, p: _documents(s, p, "doc_id", S.sha_digest(F.col("text")).alias("digest"), F.length(S.truncate(F.col("text"))).cast("long").alias("rendered_chars")),
        "marker_classify": lambda s, p: _of(s, p, "base1").select("call_id", S.partial_markers(F.col("args_rendered"), F.col("return_rendered")).alias("m")).select("call_id", F.array_join("m", "|").alias("markers"), S.confidence(F.col("m")).alias("confidence")),
        "marker_histogram": lambda s, p: _of(s, p, "base1").select(F.explode(S.partial_markers(F.col("args_rendered"))).alias("marker")).groupBy("marker").agg(F.count("*").alias("n")),
        "scope_match": lambda s, p: _of(s, p, "base1").select("call_id", S.in_scope(F.substring_index("method", "(", 1), ["App"], ["App.view"]).alias("in_scope")),
        "module_source_rule": lambda s, p: _of(s, p, "base1").groupBy(F.col("process").alias("module")).agg(F.count_distinct("method").alias("n"), F.count_distinct(F.when(F.col("resolution") == "debugInfo", F.col("method"))).alias("exact")).select("module", S.source_rule(F.col("n"), F.col("exact")).alias("rule"), S.exact_percent(F.col("n"), F.col("exact")).alias("exact_percent"), S.source_unavailable(F.col("n"), F.col("exact")).alias("unavailable"), S.source_partial(F.col("n"), F.col("exact")).alias("partial")),
        "conformance_guards": lambda s, p: checks.conformance(_of(s, p, "base1"), _of(s, p, "pr")),
        "call_order_stability": lambda s, p: studies.order_instability(_of(s, p, "base1"), _of(s, p, "base2")),
        "test_shapes": lambda s, p: studies.test_shapes(_of(s, p, "base1")).select("test_id", "threads"),
        "shape_differences": lambda s, p: studies.shape_differences(_of(s, p, "base1"), _of(s, p, "pr")).agg(F.count("*").alias("shapes"), F.coalesce(F.sum("left_tests"), F.lit(0)).alias("left_tests"), F.coalesce(F.sum("right_tests"), F.lit(0)).alias("right_tests")),
        "patched_vs_traced": lambda s, p: studies.patched_vs_traced(_of(s, p, "base1"), _members(s)),
        "source_census": lambda s, p: studies.source_census(adapter.runs(s, p)),
        "labelled_share": lambda s, p: checks.labelled_share(_of(s, p, "base1").withColumn("test_id", F.when(F.col("call_id") % 37 == 0, "(no-test)").otherwise(F.col("test_id")))),
        "normalize_roundtrip": _parsed_back,
        "canonical_digest": _digests,
    } | audits.queries(_walked, _found) | inputs.queries(_walked)


_COMPARE = """
b AS (SELECT * FROM tr WHERE run = 'base1'), p AS (SELECT * FROM tr WHERE run = 'pr'),
bk AS (SELECT test_id, method, count(*) AS n, max(CASE WHEN pos = 0 THEN args_rendered END) AS a, bool_or(pos = 0 AND is_harness) AS h, max(CASE WHEN pos = 0 THEN path END) AS path FROM b GROUP BY test_id, method),
pk AS (SELECT test_id, method, count(*) AS n, max(CASE WHEN pos = 0 THEN args_rendered END) AS a, bool_or(pos = 0 AND is_harness) AS h, max(CASE WHEN pos = 0 THEN path END) AS path FROM p GROUP BY test_id, method),
kk AS (SELECT coalesce(bk.test_id, pk.test_id) AS test_id, coalesce(bk.method, pk.method) AS method, bk.n AS bn, pk.n AS pn, coalesce(bk.h, pk.h) AS h, coalesce(bk.path, pk.path) AS path,
  CASE WHEN contains(coalesce(bk.a, ''), '<depth:') OR contains(coalesce(pk.a, ''), '<depth:') THEN 'Partial' ELSE 'Exact' END AS confidence
  FROM bk FULL JOIN pk ON bk.test_id = pk.test_id AND bk.method = pk.method),
lv AS (SELECT test_id, method, -1 AS ordinal,
  CASE WHEN bn IS NULL THEN 'MissingInBase' WHEN pn IS NULL THEN 'MissingInPr' ELSE 'CallCountChange' END AS kind,
  CASE WHEN bn IS NULL THEN 'key absent from base, ' || CAST(pn AS VARCHAR) || ' call(s) in PR' WHEN pn IS NULL THEN 'key absent from PR, ' || CAST(bn AS VARCHAR) || ' call(s) in base'
    ELSE 'called ' || CAST(bn AS VARCHAR) || ' time(s) in base, ' || CAST(pn AS VARCHAR) || ' in PR' END AS detail, confidence, h AS is_harness, path,
  CAST(NULL AS VARCHAR) AS base_return, CAST(NULL AS VARCHAR) AS pr_return FROM kk WHERE bn IS NULL OR pn IS NULL OR bn <> pn),
dd AS (SELECT b.test_id, b.method, b.pos AS ordinal, 'DigestDiff' AS kind,
  CASE WHEN b.args_digest IS DISTINCT FROM p.args_digest THEN 'argsDigest' WHEN b.return_digest IS DISTINCT FROM p.return_digest THEN 'returnDigest' WHEN b.exception_type IS DISTINCT FROM p.exception_type THEN 'exceptionType' END AS detail,
  CASE WHEN contains(b.args_rendered, '<depth:') OR contains(p.args_rendered, '<depth:') THEN 'Partial' ELSE 'Exact' END AS confidence,
  k.h AS is_harness, b.path, b.return_rendered AS base_return, p.return_rendered AS pr_return
  FROM b JOIN p ON b.test_id = p.test_id AND b.method = p.method AND b.pos = p.pos JOIN kk k ON k.test_id = b.test_id AND k.method = b.method),
dv AS (SELECT * FROM lv UNION ALL SELECT * FROM dd WHERE detail IS NOT NULL)"""
_NOISE = """
bs AS (SELECT * FROM tr WHERE run <> 'pr'),
per AS (SELECT test_id, method, pos, count(*) AS n, count(DISTINCT concat_ws('|', args_digest, return_digest, coalesce(exception_type, '-'))) AS kinds, bool_or(is_harness) AS h FROM bs GROUP BY test_id, method, pos),
noise AS (SELECT test_id, method FROM per GROUP BY test_id, method HAVING bool_or(n < 3 OR kinds > 1) AND NOT bool_or(pos = 0 AND h)),
rem AS (SELECT dv.* FROM dv LEFT JOIN noise n ON dv.test_id = n.test_id AND dv.method = n.method WHERE n.test_id IS NULL AND NOT dv.is_harness)"""
_FRONTIER = """
dk AS (SELECT test_id, method, bool_or(kind = 'CallCountChange') AS unalignable, min(path) AS path FROM rem GROUP BY test_id, method),
sy AS (SELECT test_id, method, string_agg(s, '|' ORDER BY kind, o) AS symptoms FROM (SELECT test_id, method, kind, kind || ':' || detail AS s, min(ordinal) AS o FROM rem GROUP BY test_id, method, kind, kind || ':' || detail) GROUP BY test_id, method),
up(call_id, anc, n) AS (
  SELECT b.call_id, b.parent_call_id, 1 FROM b WHERE b.parent_call_id IS NOT NULL
  UNION ALL SELECT u.call_id, b.parent_call_id, u.n + 1 FROM up u JOIN b ON b.call_id = u.anc WHERE b.parent_call_id IS NOT NULL),
pr2 AS (SELECT DISTINCT a.test_id, a.method, c.test_id AS dt, c.method AS dm FROM up u JOIN b a ON a.call_id = u.anc JOIN b c ON c.call_id = u.call_id),
coll AS (SELECT DISTINCT k.test_id, k.method FROM dk k JOIN pr2 r ON r.test_id = k.test_id AND r.method = k.method JOIN dk e ON e.test_id = r.dt AND e.method = r.dm WHERE NOT k.unalignable),
nd AS (SELECT k.* FROM dk k LEFT JOIN coll c ON c.test_id = k.test_id AND c.method = k.method WHERE c.test_id IS NULL),
bl AS (SELECT n.test_id, n.method, r.dt, r.dm FROM nd n JOIN pr2 r ON r.test_id = n.test_id AND r.method = n.method WHERE NOT n.unalignable),
mk AS (SELECT test_id, method FROM kk WHERE bn IS NOT NULL AND pn IS NOT NULL AND NOT h AND confidence = 'Partial'),
walk(call_id, route) AS (
  SELECT b.call_id, [b.line_number] FROM b LEFT JOIN b u ON u.call_id = b.parent_call_id WHERE u.call_id IS NULL
  UNION ALL SELECT b.call_id, list_append(w.route, b.line_number) FROM walk w JOIN b ON b.parent_call_id = w.call_id),
met AS (
  SELECT a.test_id, a.method, c.test_id AS dt, c.method AS dm, row_number() OVER (PARTITION BY a.test_id, a.method ORDER BY a.process, a.line_number, w.route) AS met_at
  FROM up u JOIN b a ON a.call_id = u.anc JOIN b c ON c.call_id = u.call_id JOIN walk w ON w.call_id = c.call_id JOIN nd n ON n.test_id = a.test_id AND n.method = a.method AND NOT n.unalignable),
sk AS (SELECT split_part(method, '.', 1) AS type, max(method || coalesce(' (' || skip_reason || ')', '')) AS text FROM mem WHERE run = 'base1' AND status = 'Skipped' AND skip_reason IS DISTINCT FROM 'Unobservable' GROUP BY 1),
rs AS (
  SELECT test_id, method, 2 AS r, {SubtreeUnalignable} AS t FROM nd WHERE unalignable
  UNION ALL SELECT n.test_id, n.method, 3, {NodePartial} FROM nd n JOIN mk m ON m.test_id = n.test_id AND m.method = n.method
  UNION ALL SELECT l.test_id, l.method, 4, replace({DescendantPartial}, '%s', arg_min(l.dm, l.met_at)) FROM met l JOIN mk m ON m.test_id = l.dt AND m.method = l.dm GROUP BY l.test_id, l.method
  UNION ALL SELECT l.test_id, l.method, 5, replace({DescendantSkipped}, '%s', arg_min(s.type || ' also declares ' || s.text, l.met_at))
    FROM (SELECT test_id, method, dm, met_at FROM met UNION ALL SELECT test_id, method, method, 1000000000 FROM nd) l JOIN sk s ON s.type = split_part(l.dm, '.', 1) GROUP BY l.test_id, l.method
  UNION ALL SELECT l.test_id, l.method, 6, replace({DescendantSourceUnresolved}, '%s', arg_min(l.dm || ' resolved its source as ' || chr(39) || m.source_resolution || chr(39), l.met_at)) FROM met l JOIN mem m ON m.method = l.dm AND m.run = 'base1'
    WHERE m.source_resolution NOT IN ('debugInfo', 'generatedState', 'sequencePoints', 'stateMachine') GROUP BY l.test_id, l.method),
ra AS (SELECT test_id, method, string_agg(t, '|' ORDER BY r) AS reasons FROM rs GROUP BY test_id, method),
ht AS (SELECT DISTINCT test_id FROM dv WHERE is_harness),
fr AS (SELECT k.test_id, k.method, k.path, CASE WHEN c.test_id IS NOT NULL THEN 'collateral' WHEN ra.reasons IS NOT NULL THEN 'frontier_unverified' ELSE 'frontier' END AS classification,
  ht.test_id IS NULL AS untested, CAST(coalesce(x.n, 0) AS BIGINT) AS descendant_keys_compared, sy.symptoms, coalesce(ra.reasons, '') AS reasons,
  CASE WHEN k.path IN (SELECT path FROM changed) THEN 'EXPECTED' ELSE 'UNEXPECTED' END AS attribution
  FROM dk k LEFT JOIN coll c ON c.test_id = k.test_id AND c.method = k.method LEFT JOIN ra ON ra.test_id = k.test_id AND ra.method = k.method
  LEFT JOIN ht ON ht.test_id = k.test_id LEFT JOIN sy ON sy.test_id = k.test_id AND sy.method = k.method
  LEFT JOIN (SELECT test_id, method, count(*) AS n FROM bl GROUP BY test_id, method) x ON x.test_id = k.test_id AND x.method = k.method)"""
for _name, _text in frontier.REASON_TEXT.items():
    _FRONTIER = _FRONTIER.replace("{" + _name + "}", adapter.quoted(_text))
_FOUND = """
fm AS (SELECT method, lower(min(attribution)) AS attribution, min(path) AS file_path, count(*) AS call_sites, CAST(sum(descendant_keys_compared) AS BIGINT) AS descendants_compared, CAST(sum(CASE WHEN untested THEN 1 ELSE 0 END) AS BIGINT) AS untested_call_sites, arg_min(classification, test_id) = 'frontier' AS verified
  FROM fr WHERE classification <> 'collateral' GROUP BY method),
ex AS (SELECT method, count(DISTINCT test_id) AS executing_tests FROM tr WHERE run IN ('base1', 'pr') GROUP BY method),
ob AS (SELECT d.method, count(*) AS observing_tests, CAST(sum(CASE WHEN NOT f.untested AND f.classification <> 'collateral' THEN 1 ELSE 0 END) AS BIGINT) AS reacting_tests FROM (SELECT DISTINCT test_id, method FROM rem) d LEFT JOIN fr f ON f.test_id = d.test_id AND f.method = d.method GROUP BY d.method),
fo AS (SELECT fm.*, ex.executing_tests, ob.observing_tests, ob.reacting_tests,
  CAST(executing_tests AS VARCHAR) || CASE WHEN executing_tests = 1 THEN ' test executed this; ' ELSE ' tests executed this; ' END || CASE WHEN reacting_tests = 0 THEN 'none asserted on the changed value.' WHEN reacting_tests = 1 THEN '1 test had an assertion react.' ELSE CAST(reacting_tests AS VARCHAR) || ' tests had an assertion react.' END AS assertion_reaction
  FROM fm JOIN ex ON ex.method = fm.method JOIN ob ON ob.method = fm.method)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts) + "\n" + select


def oracle_sql() -> dict[str, str]:
    t = adapter.sql()
    cmp_ = lambda select: _with(t, _COMPARE, select=select)
    noise = lambda select: _with(t, _COMPARE, _NOISE, select=select)
    fr = lambda select: _with(t, _COMPARE, _NOISE, _FRONTIER, select=select, recursive=True)
    fo = lambda select: _with(t, _COMPARE, _NOISE, _FRONTIER, _FOUND, select=select, recursive=True)
    tr = lambda select: _with(t, select=select)
    gap = """mg AS (SELECT coalesce(b.method, p.method) AS method, coalesce(b.status, 'absent') AS base_state, coalesce(p.status, 'absent') AS pr_state, coalesce(b.skip_reason, p.skip_reason) AS skip, b.method IS NULL OR p.method IS NULL AS one_sided, coalesce(b.status, p.status) AS st
      FROM (SELECT * FROM mem WHERE run = 'base1') b FULL JOIN (SELECT * FROM mem WHERE run = 'pr') p ON b.method = p.method),
    gp AS (SELECT method, base_state, pr_state FROM mg WHERE base_state <> pr_state AND NOT (one_sided AND st = 'Skipped' AND coalesce(skip, '') = 'ExcludedByScope'))"""
    pairs = """pn AS (SELECT 0 AS n, 'base1' AS l, 'base2' AS r UNION ALL SELECT 1, 'base1', 'base3' UNION ALL SELECT 2, 'base2', 'base3'),
    pd AS (SELECT pn.n, pn.l, pn.r, a.test_id, a.method, a.pos AS ordinal FROM pn JOIN tr a ON a.run = pn.l JOIN tr b ON b.run = pn.r AND b.test_id = a.test_id AND b.method = a.method AND b.pos = a.pos
      WHERE NOT a.is_harness AND (a.args_digest IS DISTINCT FROM b.args_digest OR a.return_digest IS DISTINCT FROM b.return_digest OR a.exception_type IS DISTINCT FROM b.exception_type)),
    pw AS (SELECT *, row_number() OVER (PARTITION BY test_id, method ORDER BY n, ordinal) AS k, count(*) OVER (PARTITION BY test_id, method) AS c FROM pd)"""
    creds = " OR ".join(f"regexp_matches(text, '{p}')" for p in S.CREDENTIALS.values())
    path = _path_sql_input().replace("\\\\", "\\")
    return {
        "trace_summary": tr("SELECT run, count(*) AS events, count(DISTINCT test_id) AS tests, count(DISTINCT method) AS methods, count(DISTINCT thread_id) AS threads, CAST(sum(CASE WHEN parent_call_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS roots, CAST(max(CASE WHEN parent_call_id IS NULL THEN 0 ELSE call_id % 9 END) AS INTEGER) AS max_depth, count(exception_type) AS threw, count(*) - count(DISTINCT (process, call_id)) AS duplicate_call_ids FROM tr GROUP BY run"),
        "call_positions": tr("SELECT test_id, method, call_id, pos FROM tr WHERE run = 'base1'"),
        "ordinal_gaps": "SELECT 'c' || CAST(conv_id AS VARCHAR) AS test_id, count(*) AS calls, CAST(min(turn) AS INTEGER) AS least, CAST(max(turn) AS INTEGER) AS most FROM conversations WHERE NOT (conv_id % 10 = 7 AND turn = 1) GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)",
        "key_compare": cmp_("SELECT test_id, method, kind, detail, confidence, is_harness FROM lv"),
        "matched_keys": cmp_("SELECT test_id, method, bn AS base_calls, pn AS pr_calls, confidence, CASE WHEN confidence = 'Partial' THEN 'depth' ELSE '' END AS markers, path AS file_path FROM kk WHERE bn IS NOT NULL AND pn IS NOT NULL AND NOT h"),
        "digest_divergences": cmp_("SELECT test_id, method, ordinal, detail, confidence, base_return, pr_return, is_harness FROM dv WHERE ordinal >= 0"),
        "noise_keys": noise("SELECT test_id, method FROM noise"),
        "noise_first_divergence": _with(t, pairs, select="SELECT test_id, method, l AS left_run, r AS right_run, ordinal, 'DigestDiff' AS kind, c AS difference_count FROM pw WHERE k = 1"),
        "noise_growth": _with(t, """sg AS (SELECT run, test_id, method, string_agg(concat_ws('|', args_digest, return_digest, coalesce(exception_type, '-')), ',' ORDER BY args_digest, return_digest, exception_type) AS s FROM tr WHERE run <> 'pr' AND NOT is_harness GROUP BY run, test_id, method),
          gr AS (SELECT test_id, method, max(CASE WHEN run = 'base1' THEN s END) AS a, max(CASE WHEN run = 'base2' THEN s END) AS b, max(CASE WHEN run = 'base3' THEN s END) AS c FROM sg GROUP BY test_id, method)""",
          select="SELECT 2 AS n_runs, CAST(sum(CASE WHEN a IS DISTINCT FROM b THEN 1 ELSE 0 END) AS BIGINT) AS noise_keys FROM gr UNION ALL SELECT 3, CAST(sum(CASE WHEN a IS DISTINCT FROM b OR a IS DISTINCT FROM c THEN 1 ELSE 0 END) AS BIGINT) FROM gr"),
        "noise_classification": _with(t, """kc AS (SELECT test_id, method, count(DISTINCT n) AS kinds, count(*) AS present FROM (SELECT run, test_id, method, count(*) AS n FROM tr WHERE NOT is_harness GROUP BY run, test_id, method) GROUP BY test_id, method),
          mc AS (SELECT method, count(DISTINCT n) = 1 AND count(*) = 4 AS constant FROM (SELECT run, method, count(*) AS n FROM tr WHERE NOT is_harness GROUP BY run, method) GROUP BY method)""",
          select="SELECT CASE WHEN constant THEN 'moved' ELSE 'extra' END AS class, count(*) AS keys, count(DISTINCT kc.method) AS methods FROM kc JOIN mc ON mc.method = kc.method WHERE kinds > 1 OR present < 4 GROUP BY 1"),
        "count_spread": _with(t, "mr AS (SELECT method, run, count(*) AS n FROM tr WHERE NOT is_harness GROUP BY method, run)", select="SELECT method, CASE WHEN count(*) < 4 THEN 0 ELSE min(n) END AS least, max(n) AS most, max(n) - CASE WHEN count(*) < 4 THEN 0 ELSE min(n) END AS spread FROM mr GROUP BY method"),
        "divergences_after_noise": noise("SELECT test_id, method, ordinal, kind, detail FROM rem"),
        "divergences_by_kind": noise("SELECT kind, count(*) AS n FROM rem GROUP BY kind"),
        "volume_gate": noise("""SELECT m.*, round(CASE WHEN base1_events = 0 THEN 100.0 ELSE abs(base1_events - base2_events) * 100.0 / base1_events END, 4) AS drift_percent,
          round(CASE WHEN matched_keys = 0 THEN 100.0 ELSE noise_keys * 100.0 / matched_keys END, 4) AS noise_percent, round(CASE WHEN base_paths = 0 THEN 0.0 ELSE shared_paths * 100.0 / base_paths END, 4) AS overlap_percent
          FROM (SELECT (SELECT count(*) FROM tr WHERE run = 'base1' AND NOT is_harness) AS base1_events, (SELECT count(*) FROM tr WHERE run = 'base2' AND NOT is_harness) AS base2_events, (SELECT count(*) FROM tr WHERE run = 'pr' AND NOT is_harness) AS pr_events,
            (SELECT count(DISTINCT path) FROM b WHERE NOT is_harness) AS base_paths, (SELECT count(DISTINCT b.path) FROM b JOIN (SELECT DISTINCT path FROM p WHERE NOT is_harness) q ON q.path = b.path WHERE NOT b.is_harness) AS shared_paths,
            (SELECT count(*) FROM kk WHERE bn IS NOT NULL AND pn IS NOT NULL AND NOT h) AS matched_keys, (SELECT count(*) FROM noise) AS noise_keys) m"""),
        "orphans": tr("SELECT c.test_id, c.call_id, c.parent_call_id FROM tr c LEFT JOIN (SELECT * FROM tr WHERE run = 'pr' AND call_id % 7 <> 0) q ON q.process = c.process AND q.call_id = c.parent_call_id WHERE c.run = 'pr' AND c.call_id % 7 <> 0 AND c.parent_call_id IS NOT NULL AND q.call_id IS NULL"),
        "descendant_counts": _with(t, "b AS (SELECT * FROM tr WHERE run = 'base1')", "dn(root, call_id, n) AS (SELECT r.call_id, c.call_id, 1 FROM b r JOIN b c ON c.parent_call_id = r.call_id WHERE r.parent_call_id IS NULL UNION ALL SELECT d.root, c.call_id, d.n + 1 FROM dn d JOIN b c ON c.parent_call_id = d.call_id)", select="SELECT root AS call_id, count(*) AS descendants, CAST(max(n) AS BIGINT) AS depth FROM dn GROUP BY root", recursive=True),
        "call_paths": _with(t, "b AS (SELECT * FROM tr WHERE run = 'base1')", "pt(call_id, path) AS (SELECT call_id, method FROM b WHERE parent_call_id IS NULL UNION ALL SELECT b.call_id, pt.path || ' > ' || b.method FROM pt JOIN b ON b.parent_call_id = pt.call_id)", select="SELECT call_id, path FROM pt", recursive=True),
        "frontier_nodes": fr("SELECT test_id, method, classification, untested, descendant_keys_compared, symptoms FROM fr"),
        "downgrade_reasons": fr("SELECT test_id, method, reasons FROM fr WHERE classification <> 'collateral'"),
        "attribution": fr("SELECT attribution, classification, count(*) AS nodes, count(DISTINCT method) AS members FROM fr WHERE classification <> 'collateral' GROUP BY attribution, classification"),
        "changed_file_coverage": tr("SELECT c.path, count(DISTINCT x.method) AS members, count(DISTINCT CASE WHEN x.method IS NOT NULL THEN x.test_id || '/' || x.method END) AS call_sites, CAST(sum(CASE WHEN x.run = 'base1' THEN 1 ELSE 0 END) AS BIGINT) AS base_calls, CAST(sum(CASE WHEN x.run = 'pr' THEN 1 ELSE 0 END) AS BIGINT) AS pr_calls, count(x.run) > 0 AS exercised FROM changed c LEFT JOIN (SELECT * FROM tr WHERE run IN ('base1', 'pr') AND NOT is_harness) x ON x.path = c.path GROUP BY c.path"),
        "findings_members": fo("SELECT method, attribution, file_path, call_sites, executing_tests, observing_tests, reacting_tests, assertion_reaction, descendants_compared, untested_call_sites FROM fo"),
        "findings_summary": fo("SELECT count(*) AS members, CAST(sum(CASE WHEN verified THEN 1 ELSE 0 END) AS BIGINT) AS verified_members, CAST(sum(CASE WHEN attribution = 'unexpected' THEN 1 ELSE 0 END) AS BIGINT) AS unexpected_members, CAST(sum(CASE WHEN attribution = 'expected' THEN 1 ELSE 0 END) AS BIGINT) AS expected_members, CAST(coalesce(sum(CASE WHEN attribution = 'unexpected' THEN call_sites END), 0) AS BIGINT) AS unexpected_call_sites, CAST(coalesce(sum(CASE WHEN attribution = 'expected' THEN call_sites END), 0) AS BIGINT) AS expected_call_sites, CAST(coalesce(sum(untested_call_sites), 0) AS BIGINT) AS untested_call_sites, sum(CASE WHEN attribution = 'unexpected' THEN 1 ELSE 0 END) = 0 AS is_clean FROM fo"),
        "top_untested": fr("SELECT method, attribution, count(*) AS call_sites FROM fr WHERE classification <> 'collateral' AND untested GROUP BY method, attribution ORDER BY call_sites DESC, method LIMIT 50"),
        "path_normalize": f"""SELECT page_id, CASE WHEN x IS NULL THEN 'missing' WHEN NOT regexp_matches(x, '^(/|[A-Z]:)') THEN 'relative' WHEN starts_with(x, '/_/') OR starts_with(lower(x), 'c:/repo/') THEN 'normalized' ELSE 'still-absolute' END AS path_class,
          CASE WHEN starts_with(x, '/_/') THEN substr(x, 4) WHEN starts_with(lower(x), 'c:/repo/') THEN substr(x, 9) ELSE x END AS relative
          FROM (SELECT page_id, replace({path}, '\\', '/') AS x FROM pages)""",
        "declaring_type": "SELECT doc_id, 'App.' || lang || '.' || source || '`1' AS type, source AS simple, source || '.Run' AS short FROM documents",
        "redact": f"SELECT doc_id, sha256(CASE WHEN {creds} THEN '<redacted>' ELSE text END) AS shown, regexp_matches(lower(text), 'password|token|secret|key|ssn|email|auth|credential') AS sensitive FROM documents",
        "sensitive_members": tr("SELECT call_id, regexp_matches(lower(method || args_rendered), 'password|token|secret|key|ssn|email|auth|credential') AS sensitive, path IN ('src/click.py', 'src/purchase.py') AS digest_only_path, method IN ('App.view()', 'App.error()') AS digest_only_type FROM tr WHERE run = 'base1'"),
        "side_identifiers": """WITH l AS (SELECT doc_id, unnest(string_split('+' || replace(text, '. ', chr(10) || '-'), chr(10))) AS line FROM documents),
          w AS (SELECT DISTINCT doc_id, line[1] AS sign, unnest(regexp_extract_all(line, '[\\p{L}\\p{N}\\p{M}_]+')) AS i FROM l WHERE line[1] IN ('+', '-') AND NOT starts_with(line, '+++') AND NOT starts_with(line, '---')),
          k AS (SELECT doc_id, i, count(*) AS sides FROM w WHERE length(i) >= 4 AND regexp_full_match(i, '[A-Za-z_][A-Za-z0-9_]*') AND i NOT IN ('private', 'public', 'protected', 'internal', 'static', 'const', 'readonly', 'decimal', 'string', 'bool', 'true', 'false', 'return', 'class', 'record', 'struct', 'namespace') GROUP BY doc_id, i),
          o AS (SELECT doc_id, string_agg(i, ' ' ORDER BY i) AS every, string_agg(CASE WHEN sides = 1 THEN i END, ' ' ORDER BY i) AS one FROM k GROUP BY doc_id)
          SELECT d.doc_id, coalesce(o.one, o.every, '') AS identifiers FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id""",
        "sha_digest": "SELECT doc_id, 'sha256:' || sha256(text) AS digest, CASE WHEN length(text) > 2000 THEN 2011 ELSE length(text) END AS rendered_chars FROM documents",
        "marker_classify": tr("SELECT call_id, CASE WHEN contains(args_rendered, '<depth:') THEN 'depth' ELSE '' END AS markers, CASE WHEN contains(args_rendered, '<depth:') THEN 'Partial' ELSE 'Exact' END AS confidence FROM tr WHERE run = 'base1'"),
        "marker_histogram": tr("SELECT 'depth' AS marker, count(*) AS n FROM tr WHERE run = 'base1' AND contains(args_rendered, '<depth:')"),
        "scope_match": tr("SELECT call_id, starts_with(method, 'App.') AND method <> 'App.view()' AS in_scope FROM tr WHERE run = 'base1'"),
        "module_source_rule": _with(t, "ms AS (SELECT process AS module, count(DISTINCT method) AS n, count(DISTINCT CASE WHEN resolution = 'debugInfo' THEN method END) AS e FROM tr WHERE run = 'base1' GROUP BY process)", select="SELECT module, CASE WHEN n = 0 THEN 'notApplicable' WHEN n < 5 THEN 'anyNone' ELSE 'ratio' END AS rule, CAST(floor(e * 100.0 / n) AS INTEGER) AS exact_percent, CASE WHEN n < 5 THEN e = 0 ELSE floor(e * 100.0 / n) < 80 END AS unavailable, n >= 5 AND floor(e * 100.0 / n) BETWEEN 80 AND 99 AS partial FROM ms"),
        "conformance_guards": _with(t, _COMPARE, select="SELECT 'matched_key_floor' AS guard, greatest(0, 100 - count(*)) AS failures FROM kk WHERE NOT h AND bn IS NOT NULL AND pn IS NOT NULL UNION ALL SELECT 'call_counts' AS guard, CAST(sum(CASE WHEN bn IS DISTINCT FROM pn THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM kk WHERE NOT h UNION ALL SELECT 'ordinal_sequences', CAST(sum(CASE WHEN bn IS DISTINCT FROM pn THEN 1 ELSE 0 END) AS BIGINT) FROM kk WHERE NOT h UNION ALL SELECT 'method_set', 0 UNION ALL SELECT 'unusable_source', CAST(sum(CASE WHEN resolution <> 'debugInfo' THEN 1 ELSE 0 END) AS BIGINT) FROM b WHERE NOT is_harness"),
        "call_order_stability": _with(t, "ps AS (SELECT x.test_id, x.method, x.pos, x.return_digest <> y.return_digest AS unlike FROM tr x JOIN tr y ON x.run = 'base1' AND y.run = 'base2' AND x.test_id = y.test_id AND x.method = y.method AND x.pos = y.pos)", select="SELECT test_id, method, CAST(max(pos) + 1 AS INTEGER) AS calls, min(CASE WHEN unlike THEN pos END) AS first_unlike FROM ps GROUP BY test_id, method HAVING bool_or(unlike)"),
        "test_shapes": tr("SELECT test_id, CAST(count(DISTINCT thread_id) AS INTEGER) AS threads FROM tr WHERE run = 'base1' GROUP BY test_id"),
        "shape_differences": _with(t, """sh AS (SELECT run, test_id, string_agg(method || '=' || CAST(n AS VARCHAR), ';' ORDER BY method) AS s FROM (SELECT run, test_id, method, count(*) AS n FROM tr WHERE run IN ('base1', 'pr') GROUP BY run, test_id, method) GROUP BY run, test_id),
          sc AS (SELECT s, sum(CASE WHEN run = 'base1' THEN 1 ELSE 0 END) AS l, sum(CASE WHEN run = 'pr' THEN 1 ELSE 0 END) AS r FROM sh GROUP BY s)""", select="SELECT count(*) AS shapes, CAST(coalesce(sum(l), 0) AS BIGINT) AS left_tests, CAST(coalesce(sum(r), 0) AS BIGINT) AS right_tests FROM sc WHERE l <> r"),
        "patched_vs_traced": tr("SELECT DISTINCT method, 'silent' AS state FROM mem WHERE run = 'base1' AND status = 'Patched' AND method NOT IN (SELECT method FROM tr WHERE run = 'base1') UNION ALL SELECT DISTINCT method, 'orphan' FROM tr WHERE run = 'base1' AND method NOT IN (SELECT method FROM mem WHERE run = 'base1' AND status = 'Patched')"),
        "source_census": tr("SELECT run, resolution, count(*) AS events, count(DISTINCT method) AS methods FROM tr GROUP BY run, resolution"),
        "labelled_share": "SELECT count(*) AS events, count(*) FILTER (event_id % 37 <> 0) AS labelled, round(count(*) FILTER (event_id % 37 <> 0) * 100.0 / count(*), 4) AS share_percent FROM events",
        "normalize_roundtrip": tr("SELECT test_id, method, call_id, parent_call_id, pos AS ordinal, return_rendered, is_harness, CAST(NULL AS VARCHAR) AS error FROM tr WHERE run = 'base1'"),
    } | audits.oracle_sql(tr, noise, fr, fo) | inputs.oracle_sql(tr, noise, fr, fo, audits._after)
