"""Registered queries over what an analysis hands on and refuses: evidence, consequences, accounting, report model; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail import tables
from calltrail.functions import scalars as S
from calltrail.operators import checks, claims, findings, frontier, keys, manifests, scopes, studies, tree
from calltrail.plans import adapter, analysis
from calltrail.sources import documents, traces

_B = adapter.BASES


def _members(spark, run: str) -> DataFrame:
    return manifests.merge_members(adapter.members(spark)).where(F.col("run") == run)


def _gaps(spark) -> DataFrame:
    return manifests.member_gaps(_members(spark, "base1"), _members(spark, "pr"))


def _evidence(walked):
    """Evidence and divergences of the walked runs."""

    def of(spark, sf_dir):
        nodes, left, base, pr = walked(spark, sf_dir)
        above = tree.Steps(base), tree.Steps(pr)
        return tree.stored(findings.evidence(left, nodes, base, pr, adapter.changed(spark), above)), left, nodes, base, pr, adapter.changed(spark), above

    return of


def _base_paths(nodes, left, base):
    return findings.with_base_paths(left, nodes, base)


def _pages(spark, sf_dir):
    """Merged members and modules of the pages' manifests."""
    return manifests.merge_members(adapter.page_members(spark, sf_dir)), manifests.merge_modules(adapter.page_modules(spark, sf_dir))


def _page_gaps(spark, sf_dir):
    (members, modules), of = _pages(spark, sf_dir), lambda df, r: df.where(F.col("run") == r)
    return manifests.manifest_diff(of(members, "base1"), of(members, "pr"), of(modules, "base1"), of(modules, "pr"))


def _consequences(ev):
    files = lambda c: F.array_join(c, "|")
    path = lambda c: F.array_join(F.transform(c, lambda n: n["member"]), " > ")
    return lambda s, p: findings.consequences(*ev(s, p)).select("member", "test_id", "consequence", "ordinal", "detail", "base_return", "pr_return", "assertion_reacted", path("base_path").alias("base_path"), path("pr_path").alias("pr_path"), files("changed_files_on_path").alias("changed_files"))


def _roots(spark, sf_dir):
    """The inferred root of each host's pages, as if they were files."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("path", F.regexp_replace("url", "^[a-z]+:/", ""))
    return p.groupBy((F.col("page_id") % 7).alias("part"), F.regexp_extract("path", "^/([^/]*)", 1).alias("host")).agg(S.common_root(F.col("path")).alias("root"))


def _trace_lines(spark, sf_dir):
    """Line numbers of a run's trace files, each process' file written in its order and read in splits."""
    folder = f"{tables.shared_dir(spark)}/traces-{uuid.uuid4().hex}"
    events = adapter.run(spark, sf_dir, "base1").repartition("process").sortWithinPartitions("process", "line_number")
    traces.to_lines(events, keep=("process",)).write.partitionBy("process").option("lineSep", "\n").text(folder)
    found = traces.parse_events(traces.lines(spark, folder, "*.txt"))
    return found.where("error IS NULL").select("call_id", "line_number")


def _manifests(spark, sf_dir):
    """Conversations as processes with manifests: a member for each turn, and by the id some that do not add up."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("c"), "conv_id").alias("process"), "conv_id", "role")
    members = c.select(F.lit("c").alias("run"), "process", F.lit("A").alias("assembly"))
    n = c.groupBy("process", "conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"))
    modules = n.select(F.lit("c").alias("run"), "process", F.lit("A").alias("assembly"), F.lit(True).alias("scanned"), (F.col("n") + (F.col("conv_id") % 13 == 0).cast("int")).alias("discoveredMembers"), "u", "conv_id", "n")
    modules = modules.withColumns({"patchedMembers": F.col("u"), "skippedMembers": F.col("n") - F.col("u"), "patchFailedMembers": (F.col("conv_id") % 26 == 0).cast("long")})
    lost = (F.col("conv_id") % 11 == 0).cast("int")
    writers = n.select(F.lit("c").alias("run"), "process", F.col("n").alias("enqueued"), (F.col("n") - lost).alias("written"), lost.alias("dropped"))
    return members, modules, writers, n.select(F.lit("c").alias("run"), "process", F.col("n").alias("records"))


def _integrity(events: DataFrame) -> DataFrame:
    modules = events.groupBy("process").agg((F.count("*") - (F.col("process") == "p1").cast("int")).alias("tracedCalls"))
    return studies.run_integrity(events, modules, expected_tests=1)


def _host_names(spark, sf_dir):
    """Hosts and their upper domains turned around, com.example.www, by the id with or without the path's first segment."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#.]*)", 1).alias("first"))
    turned = F.array_join(F.reverse(F.split("host", r"[.]")), ".")
    return p.select(F.when(F.col("page_id") % 3 == 0, turned).otherwise(F.concat(turned, F.lit("."), "first")).alias("name"))


def _steps(spark, sf_dir):
    """Rows of each step of a comparison, as the passes that made them counted."""
    members, modules = adapter.members(spark), adapter.modules(spark)
    d = analysis.diff(tables.stored(adapter.runs(spark, sf_dir)), members, modules, adapter.changed(spark), _B)
    return spark.createDataFrame(d.step_counts(), "step string, rows long").where("step IN ('noise_keys', 'divergences', 'matched_keys')")


def _document(spark, sf_dir):
    """Customers written as one document and read back: names as text, balances that are no whole number by default, ids as they are or as text."""
    path = f"{tables.shared_dir(spark)}/customers-{uuid.uuid4().hex}.json"
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    odd = F.col("c_custkey") % 2 == 0
    rows = c.select(F.when(odd, F.col("c_custkey").cast("string")).alias("text_id"), F.when(~odd, F.col("c_custkey")).alias("id"), F.col("c_name").alias("name"), odd.alias("even"), F.split("c_name", "#").alias("words"))
    documents.write_document({"customers": rows}, "customers/1", path)
    row = documents.section(documents.read_document(spark, path, "customers/1"), "customers")
    either = F.coalesce(documents.id_of("row", "id"), documents.id_of("row", "text_id"))
    return row.select(either.alias("id"), documents.string_of("row", "name", "").alias("name"), documents.long_of("row", "name", -1).alias("no_number"), documents.bool_of("row", "even").alias("even"), F.size(documents.strings_of("row", "words")).alias("words"), documents.string_of("row", "id", "none").alias("no_text"))


def _cited(spark, sf_dir):
    """Words of whole documents as citations about their source, of a kind that the word gives."""
    kinds = F.array(*map(F.lit, ("OBSERVATION", "DIFF", "CONSEQUENCE", "RELATED")))
    of = lambda w: F.concat(F.element_at(kinds, (F.length(w) % 4 + 1).cast("int")), F.lit(": "), w)
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("member"), F.explode(F.split("text", " ")).alias("w")).distinct()
    corpus = words.select("member", F.substring_index(of(F.col("w")), ": ", 1).alias("kind"), of(F.col("w")).alias("citation"))
    return corpus, of


def _items(spark, sf_dir):
    """Benchmark items as claims about a source, each of which is chosen by the id."""
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct().agg(F.array_sort(F.collect_list("source")).alias("s"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").crossJoin(F.broadcast(sources))  # one row: the sources are a handful of names
    return items.select(F.col("item_id").alias("claim_id"), F.element_at("s", (F.col("item_id") % F.size("s") + 1).cast("int")).alias("member"), "text")


def _claims(spark, sf_dir):
    """Items that cite each of their words from what whole documents hold."""
    corpus, of = _cited(spark, sf_dir)
    items = _items(spark, sf_dir).select("claim_id", F.transform(F.split("text", " "), of).alias("citations"))
    return findings.ungrounded(items, corpus).select("claim_id", F.array_join("missing", " ").alias("missing"), "accepted")


def _judged(spark, sf_dir):
    """Items as claims whose why cites every word of theirs and whose test the first half; the last word of an item is an observed value."""
    corpus, of = _cited(spark, sf_dir)
    items = _items(spark, sf_dir)
    cited = F.transform(F.split("text", " "), of)
    rows = items.select("claim_id", "member", F.col("text").alias("why"), cited.alias("why_citations"), F.lit("").alias("test"), F.slice(cited, F.lit(1), F.floor(F.size(cited) / 2).cast("int")).alias("test_citations"))
    values = items.where("claim_id % 5 = 0").select("member", F.element_at(F.split("text", " "), -1).alias("value"))
    found = claims.judged(rows, corpus, values)
    return found.select("claim_id", F.size("problems").cast("long").alias("n_problems"), F.sha2(F.array_join("problems", "\n").cast("binary"), 256).alias("problems_sha256"), "accepted")


def _restated(spark, sf_dir):
    """Which whole documents hold the second and third word of which benchmark item, as a value of the document's source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("claim_id"), F.lit(1).alias("member"), "text")
    phrase = F.array_join(F.slice(F.split("text", " "), 2, 2), " ")
    values = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit(1).alias("member"), phrase.alias("value"))
    return claims.restated(docs, values)


def _names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("u"))
    path = F.when(F.col("page_id") % 3 == 0, F.concat("u", F.lit("/obj/x.g.cs"))).when(F.col("page_id") % 3 == 1, F.concat("u", F.lit(".generated.ts"))).otherwise(F.col("u"))
    p = p.withColumn("path", path)
    time = F.concat((F.col("page_id") % 50).cast("string"), F.when(F.col("page_id") % 2 == 0, "h").otherwise("d"))
    shown = F.concat(F.lit("<a>k__BackingField=Primitive:"), "u", F.lit("`"))
    return p.select("page_id", S.first_segment(F.col("path")).alias("segment"), S.file_stem(F.col("path")).alias("stem"), S.is_generated_source(F.col("path")).alias("generated"), S.duration_seconds(time).alias("seconds"), S.display_text(shown).alias("shown"), S.escape_cell(F.concat("u", F.lit("|\n"))).alias("cell"), F.array_join(S.list_items(F.concat("u", F.lit("; a,"), "u")), " ").alias("items"))


def queries(walked, found) -> dict:
    """walked: nodes, divergences left, base and proposed events; found: the members of a report."""
    of = lambda s, p, name: adapter.run(s, p, name)
    bases = lambda s, p: adapter.runs(s, p, tuple(_B))
    ev = _evidence(walked)
    changed = adapter.changed
    lifecycle = lambda s, p: manifests.lifecycle_divergences(_gaps(s), of(s, p, "base1"), of(s, p, "pr"), changed(s))
    measures = lambda s, p: checks.volume(adapter.runs(s, p), keys.matched_keys(of(s, p, "base1"), of(s, p, "pr")), keys.noise_keys(bases(s, p)))
    return {
        "noise_histogram": lambda s, p: keys.noise_histogram(keys.noise_keys(bases(s, p))),
        "gaps_by_scope": lambda s, p: manifests.gaps_by_scope(_page_gaps(s, p)),
        "members_of_files": lambda s, p: frontier.members_of_files(adapter.page_changes(s, p), _pages(s, p)[0].where("run = 'pr'")),
        "skip_reasons": lambda s, p: frontier.skip_reasons(adapter.page_changes(s, p), _pages(s, p)[0].where("run = 'pr'")),
        "lifecycle_divergences": lifecycle,
        "gap_methods": lambda s, p: manifests.gap_methods(_gaps(s), changed(s), of(s, p, "base1"), of(s, p, "pr")),
        "manifest_gaps": lambda s, p: _page_gaps(s, p).select("scope", "assembly", "method", "base_state", "pr_state"),
        "manifest_noise": lambda s, p: manifests.manifest_noise(*_pages(s, p), _B),
        "gaps_after_noise": lambda s, p: manifests.without_manifest_noise(_page_gaps(s, p), manifests.manifest_noise(*_pages(s, p), _B)).select("scope", "assembly", "method", "base_state", "pr_state"),
        "lifecycle": lambda s, p: _page_gaps(s, p).where(manifests.is_lifecycle()).select("method", "base_state", "pr_state"),
        "merged_members": lambda s, p: _pages(s, p)[0].select("run", "method", "process", "status", "skip_reason"),
        "merged_modules": lambda s, p: _pages(s, p)[1].select("run", "assembly", "process", "instrumented", "source_unavailable", "source_partial"),
        "inferred_roots": _roots,
        "trace_lines": _trace_lines,
        "collapsed_hosts": lambda s, p: scopes.collapsed(_host_names(s, p)),
        "covering_hosts": lambda s, p: scopes.covering(_host_names(s, p)),
        "step_counts": _steps,
        "read_document": _document,
        "restated": _restated,
        "judged_claims": _judged,
        "manifest_accounting": lambda s, p: checks.manifest_violations(*_manifests(s, p)),
        "volume_refusals": lambda s, p: checks.volume_refusals(measures(s, p)).select("code", F.round("observed", 4).alias("observed"), "required"),
        "run_integrity": lambda s, p: _integrity(of(s, p, "base1")),
        "first_roots": lambda s, p: studies.first_roots(of(s, p, "base1")).select("call_id", "synthetic_test_id"),
        "entry_ordinals": lambda s, p: studies.entry_ordinals(of(s, p, "base1")).select("call_id", "entry_ordinal"),
        "nearest_roots": lambda s, p: studies.nearest_roots(of(s, p, "base1"), _members(s, "base1")).select("call_id", "root_call_id", "distance"),
        "reacting_tests": lambda s, p: frontier.reacting_tests(keys.compare(of(s, p, "base1"), of(s, p, "pr")).where("is_harness"), _members(s, "base1")),
        "observations": lambda s, p: findings.observations(findings.of_members(*reversed(walked(s, p)[:2]))),
        "argument_values": lambda s, p: findings.argument_values(findings.of_members(*reversed(walked(s, p)[:2]))),
        "distinct_paths": lambda s, p: findings.distinct_paths(_base_paths(*walked(s, p)[:3])),
        "consequences": _consequences(ev),
        "first_evidence": lambda s, p: findings.first_evidence(ev(s, p)[0]).select("method", "test_id", "ordinal", "kind", "detail"),
        "report_order": lambda s, p: findings.comment_model(found(s, p)).select("method", "place", "section", "lead"),
        "within_budget": lambda s, p: findings.within_budget(s.read.parquet(f"{p}/conversations.parquet").select("conv_id", "turn", "text"), "text", "conv_id", "turn", 900).select("conv_id", "turn", "used"),
        "ungrounded": _claims,
        "report_texts": _names,
    }


def oracle_sql(tr, noise, fr, fo) -> dict[str, str]:
    """tr, noise, fr, fo: makers of a query after the common tables of the runs, the noise, the frontier, the members."""
    gap = """mg AS (SELECT coalesce(b.method, p.method) AS method, coalesce(b.status, 'absent') AS base_state, coalesce(p.status, 'absent') AS pr_state, coalesce(b.skip_reason, p.skip_reason) AS skip, b.method IS NULL OR p.method IS NULL AS one_sided, coalesce(b.status, p.status) AS st
      FROM (SELECT * FROM mem WHERE run = 'base1') b FULL JOIN (SELECT * FROM mem WHERE run = 'pr') p ON b.method = p.method),
    gp AS (SELECT method, base_state, pr_state, (base_state = 'absent' AND pr_state = 'Patched') OR (base_state = 'Patched' AND pr_state = 'absent') AS born FROM mg WHERE base_state <> pr_state AND NOT (one_sided AND st = 'Skipped' AND coalesce(skip, '') = 'ExcludedByScope')),
    mf AS (SELECT method, min(path) AS path FROM tr WHERE run IN ('base1', 'pr') GROUP BY method),
    ed AS (SELECT gp.*, mf.path FROM gp JOIN mf ON mf.method = gp.method JOIN changed c ON c.path = mf.path WHERE born)"""
    with_ = lambda more, select: _after(tr(""), more, select)
    seen = """mine AS (SELECT rem.* FROM rem WHERE ordinal >= 0 AND method IN (SELECT method FROM fr WHERE classification <> 'collateral')),
    va AS (SELECT m.test_id, m.method, m.ordinal, b.call_id AS b_call, p.call_id AS p_call, replace(coalesce(b.args_rendered, ''), '`', '''') AS base_args, b.args_rendered AS raw_args, coalesce(b.return_rendered, '') AS base_return, coalesce(p.return_rendered, '') AS pr_return,
      coalesce(b.exception_type, '') AS base_exception, coalesce(p.exception_type, '') AS pr_exception FROM mine m
      LEFT JOIN b ON b.test_id = m.test_id AND b.method = m.method AND b.pos = m.ordinal LEFT JOIN p ON p.test_id = m.test_id AND p.method = m.method AND p.pos = m.ordinal)"""
    paths = """bp(call_id, path) AS (SELECT call_id, [method] FROM b WHERE parent_call_id IS NULL UNION ALL SELECT b.call_id, list_append(bp.path, b.method) FROM bp JOIN b ON b.parent_call_id = bp.call_id),
    pp(call_id, path) AS (SELECT call_id, [method] FROM p WHERE parent_call_id IS NULL UNION ALL SELECT p.call_id, list_append(pp.path, p.method) FROM pp JOIN p ON p.parent_call_id = pp.call_id)"""
    outer_ = "list_filter({0}.path, lambda x: x <> 'App.signup()' AND x <> va.method)[1]"
    refusal = lambda code, observed, required, broken: f"SELECT '{code}' AS code, CAST({observed} AS DOUBLE) AS observed, CAST({required} AS DOUBLE) AS required FROM v WHERE {broken}"
    volume = """v AS (SELECT (SELECT count(*) FROM tr WHERE run = 'base1' AND NOT is_harness) AS e1, (SELECT count(*) FROM tr WHERE run = 'base2' AND NOT is_harness) AS e2, (SELECT count(*) FROM tr WHERE run = 'pr' AND NOT is_harness) AS ep,
      (SELECT count(*) FROM kk WHERE bn IS NOT NULL AND pn IS NOT NULL AND NOT h) AS mk, (SELECT count(*) FROM noise) AS nk, (SELECT count(DISTINCT path) FROM b WHERE NOT is_harness) AS bp, (SELECT count(DISTINCT path) FROM b WHERE NOT is_harness AND path IN (SELECT path FROM p WHERE NOT is_harness)) AS sp)"""
    page = lambda select: f"WITH {adapter.PAGE_SQL} {select}" if not select.startswith(",") else f"WITH {adapter.PAGE_SQL}{select}"
    flicker = " UNION ALL ".join(adapter.page_gap_sql(a, b) for i, a in enumerate(_B) for b in _B[i + 1 :])
    hosts = """WITH h AS (SELECT DISTINCT name FROM (SELECT CASE WHEN page_id % 3 = 0 THEN turned ELSE turned || '.' || regexp_extract(url, '^[a-z]+://[^/]*/([^/?#.]*)', 1) END AS name
      FROM (SELECT *, array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '.')), '.') AS turned FROM pages)) WHERE name <> '') """
    of_files = """, fm AS (SELECT DISTINCT c.path, m.assembly, m.method, m.status, m.skip_reason FROM pch c JOIN pmm m ON m.run = 'pr'
      AND (m.assembly = c.path OR regexp_replace(regexp_extract(c.path, '[^/]*$'), '[.][^.]*$', '') = regexp_extract(m.method, '^Ns[.](T[0-9]+)[.]', 1))) """
    cited = """WITH kinds AS (SELECT ['OBSERVATION', 'DIFF', 'CONSEQUENCE', 'RELATED'] AS kinds),
      corpus AS (SELECT DISTINCT member, kinds[length(w) % 4 + 1] AS kind, kinds[length(w) % 4 + 1] || ': ' || w AS citation FROM (SELECT source AS member, unnest(string_split(text, ' ')) AS w FROM documents), kinds),
      s AS (SELECT list(DISTINCT source ORDER BY source) AS s FROM documents),
      items AS (SELECT item_id, s[item_id % len(s) + 1] AS member, text FROM benchmark, s)"""
    return {
        "noise_histogram": noise("SELECT method, count(*) AS keys FROM noise GROUP BY method ORDER BY keys DESC, method LIMIT 15"),
        "manifest_gaps": page(adapter.page_gap_sql("base1", "pr")),
        "manifest_noise": page(f"SELECT DISTINCT scope, assembly, method FROM ({flicker})"),
        "gaps_after_noise": page(f"SELECT g.* FROM ({adapter.page_gap_sql('base1', 'pr')}) g WHERE (scope, assembly, coalesce(method, '')) NOT IN (SELECT (scope, assembly, coalesce(method, '')) FROM ({flicker}))"),
        "lifecycle": page(f"SELECT method, base_state, pr_state FROM ({adapter.page_gap_sql('base1', 'pr')}) WHERE scope = 'member' AND ((base_state = 'absent' AND pr_state = 'Patched') OR (base_state = 'Patched' AND pr_state = 'absent'))"),
        "gaps_by_scope": page(f"SELECT scope, count(*) AS gaps FROM ({adapter.page_gap_sql('base1', 'pr')}) GROUP BY scope"),
        "merged_members": page("SELECT run, method, process, status, skip_reason FROM pmm"),
        "merged_modules": page("SELECT run, assembly, process, instrumented, source_unavailable, source_partial FROM pmodm"),
        "members_of_files": page(of_files + "SELECT * FROM fm"),
        "skip_reasons": page(of_files + "SELECT path, coalesce(skip_reason, '') AS skip_reason, count(*) AS members FROM fm WHERE status = 'Skipped' GROUP BY 1, 2"),
        "inferred_roots": """WITH f AS (SELECT page_id % 7 AS part, regexp_replace(url, '^[a-z]+:/', '') AS path FROM pages),
          g AS (SELECT part, regexp_extract(path, '^/([^/]*)', 1) AS host, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS s FROM f),
          c AS (SELECT part, host, s[1:k] AS head, k, count(*) AS n FROM (SELECT part, host, s, unnest(range(1, len(s) + 1)) AS k FROM g) GROUP BY ALL),
          n AS (SELECT part, host, count(*) AS every FROM g GROUP BY ALL)
          SELECT n.part, n.host, coalesce(array_to_string(arg_max(c.head, c.k), '/'), '') AS root FROM n LEFT JOIN c ON c.part = n.part AND c.host = n.host AND c.n = n.every GROUP BY n.part, n.host""",
        "trace_lines": tr("SELECT call_id, CAST(row_number() OVER (PARTITION BY process ORDER BY call_id) AS INTEGER) AS line_number FROM tr WHERE run = 'base1'"),
        "first_evidence": _after(fr(""), "fe AS (SELECT method, test_id, ordinal, kind, detail, row_number() OVER (PARTITION BY method, test_id ORDER BY ordinal, kind, detail) AS n FROM rem WHERE method IN (SELECT method FROM fr WHERE classification <> 'collateral'))", "SELECT method, test_id, ordinal, kind, detail FROM fe WHERE n = 1"),
        "collapsed_hosts": hosts + "SELECT name FROM h WHERE NOT EXISTS (SELECT 1 FROM h q WHERE starts_with(h.name, q.name || '.'))",
        "covering_hosts": hosts + "SELECT h.name, (SELECT arg_min(q.name, length(q.name)) FROM h q WHERE q.name = h.name OR starts_with(h.name, q.name || '.')) AS covers FROM h",
        "step_counts": noise("SELECT 'noise_keys' AS step, count(*) AS rows FROM noise UNION ALL SELECT 'divergences', count(*) FROM dv UNION ALL SELECT 'matched_keys', count(*) FROM kk WHERE bn IS NOT NULL AND pn IS NOT NULL AND NOT h"),
        "read_document": "SELECT c_custkey AS id, c_name AS name, -1 AS no_number, c_custkey % 2 = 0 AS even, CAST(len(string_split(c_name, '#')) AS INTEGER) AS words, 'none' AS no_text FROM customer",
        "restated": """WITH v AS (SELECT DISTINCT lower(array_to_string(string_split(text, ' ')[2:3], ' ')) AS value FROM benchmark)
          SELECT doc_id AS claim_id, value FROM documents, v WHERE value <> '' AND regexp_matches(lower(text), '(^|[^a-z0-9_])' || regexp_escape(value) || '($|[^a-z0-9_])')""",
        "judged_claims": cited + """, c AS (SELECT item_id AS claim_id, member, text AS why, list_transform(string_split(text, ' '), lambda w: kinds[length(w) % 4 + 1] || ': ' || w) AS wc FROM items, kinds),
          u AS (SELECT claim_id, member, unnest(wc) AS citation FROM c),
          p AS (
            SELECT claim_id, 'cites what is not in the corpus: ' || citation AS problem FROM u WHERE (member, citation) NOT IN (SELECT (member, citation) FROM corpus)
            UNION SELECT claim_id, 'why cites no ' || k FROM c, (VALUES ('OBSERVATION'), ('DIFF'), ('CONSEQUENCE'), ('RELATED')) t(k) WHERE (k IN ('OBSERVATION', 'DIFF') OR (member, k) IN (SELECT (member, kind) FROM corpus)) AND len(list_filter(wc, lambda x: starts_with(x, k))) = 0
            UNION SELECT claim_id, 'test cites no OBSERVATION' FROM c WHERE len(list_filter(wc[1:len(wc) // 2], lambda x: starts_with(x, 'OBSERVATION'))) = 0
            UNION SELECT claim_id, 'why has more than two sentences' FROM c WHERE len(regexp_extract_all(why, '[.!?](\\s|$)')) > 2
            UNION SELECT claim_id, 'why tells an outcome' FROM c WHERE regexp_matches(why, '(?i)\\b(returns?|returned|results?|outputs?|succeed|succeeds|succeeded|success|fail|fails|failed|failure)\\b')
            UNION SELECT c.claim_id, 'why restates ' || v.value FROM c JOIN (SELECT DISTINCT member, lower(string_split(text, ' ')[-1]) AS value FROM items WHERE item_id % 5 = 0) v ON v.member = c.member
              WHERE regexp_matches(lower(c.why), '(^|[^a-z0-9_])' || regexp_escape(v.value) || '($|[^a-z0-9_])'))
          SELECT c.claim_id, count(p.problem) AS n_problems, sha256(coalesce(string_agg(p.problem, chr(10) ORDER BY p.problem), '')) AS problems_sha256, count(p.problem) = 0 AS accepted FROM c LEFT JOIN p ON p.claim_id = c.claim_id GROUP BY c.claim_id""",
        "lifecycle_divergences": with_(gap, "SELECT DISTINCT t.test_id, t.method, CASE WHEN ed.base_state = 'absent' THEN 'MethodAdded' ELSE 'MethodRemoved' END AS kind, 'observability differs between runs: ' || ed.base_state || ' -> ' || ed.pr_state AS detail, ed.path AS file_path FROM ed JOIN tr t ON t.method = ed.method AND t.run = CASE WHEN ed.base_state = 'absent' THEN 'pr' ELSE 'base1' END WHERE NOT t.is_harness"),
        "gap_methods": with_(gap, "SELECT DISTINCT method FROM gp WHERE method NOT IN (SELECT method FROM ed)"),
        "manifest_accounting": """WITH n AS (SELECT conv_id, 'c' || conv_id AS process, count(*) AS n FROM conversations GROUP BY conv_id),
          m AS (SELECT *, n + CASE WHEN conv_id % 13 = 0 THEN 1 ELSE 0 END AS found, n + CASE WHEN conv_id % 26 = 0 THEN 1 ELSE 0 END AS parts FROM n)
          SELECT 'c' AS run, process, 'MODULE_SUM' AS code, 'A: discovered ' || found || ', accounted ' || parts AS detail FROM m WHERE found <> parts
          UNION ALL SELECT 'c', process, 'MODULE_RECORDS', 'A: discovered ' || found || ', records ' || n FROM m WHERE found <> n
          UNION ALL SELECT 'c', process, 'WRITER', 'enqueued ' || n || ', written ' || (n - 1) || ', dropped 1, records ' || n FROM m WHERE conv_id % 11 = 0""",
        "volume_refusals": _after(noise(""), volume, " UNION ALL ".join([
            *[refusal("VOLUME_EMPTY", e, 1, f"{e} = 0") for e in ("e1", "e2", "ep")],
            refusal("VOLUME_DRIFT", "round(abs(e1 - e2) * 100.0 / e1, 4)", 10, "abs(e1 - e2) * 100.0 / e1 > 10"), refusal("VOLUME_MATCHED", "mk", 100, "mk < 100"),
            refusal("VOLUME_NOISE", "round(nk * 100.0 / mk, 4)", 20, "nk * 100.0 / mk > 20"), refusal("VOLUME_OVERLAP", "round(sp * 100.0 / bp, 4)", 50, "sp * 100.0 / bp < 50")])),
        "run_integrity": tr("SELECT 'traced_calls' AS \"check\", count(*) - 1 AS observed, count(*) AS expected FROM tr WHERE run = 'base1' HAVING count(CASE WHEN process = 'p1' THEN 1 END) > 0 UNION ALL SELECT 'roots', count(DISTINCT CASE WHEN parent_call_id IS NULL THEN test_id END), 1 FROM tr WHERE run = 'base1' HAVING count(DISTINCT CASE WHEN parent_call_id IS NULL THEN test_id END) <> 1"),
        "first_roots": tr("SELECT call_id, method || '#' || row_number() OVER (PARTITION BY process, method ORDER BY call_id) AS synthetic_test_id FROM tr WHERE run = 'base1' AND parent_call_id IS NULL"),
        "entry_ordinals": tr("SELECT call_id, CAST(row_number() OVER (PARTITION BY process, test_id, method ORDER BY call_id) - 1 AS INTEGER) AS entry_ordinal FROM tr WHERE run = 'base1'"),
        "nearest_roots": _after(tr("").replace("WITH ", "WITH RECURSIVE ", 1), """b AS (SELECT * FROM tr WHERE run = 'base1'),
          up(call_id, anc, n) AS (SELECT call_id, call_id, 0 FROM b UNION ALL SELECT u.call_id, b.parent_call_id, u.n + 1 FROM up u JOIN b ON b.call_id = u.anc WHERE b.parent_call_id IS NOT NULL)""",
          "SELECT u.call_id, arg_min(u.anc, u.n) AS root_call_id, CAST(min(u.n) AS INTEGER) AS distance FROM up u JOIN b a ON a.call_id = u.anc WHERE a.method = 'App.signup()' GROUP BY u.call_id"),
        "reacting_tests": noise("SELECT DISTINCT test_id FROM dv WHERE is_harness AND method NOT IN ('App.view()', 'App.click()', 'App.error()', 'App.purchase()')"),
        "observations": _after(fr(""), seen, "SELECT method, base_args, base_return, pr_return, base_exception, pr_exception, count(*) AS times, count(DISTINCT test_id) AS tests FROM va GROUP BY ALL"),
        "argument_values": _after(fr(""), seen + ", ap AS (SELECT method, unnest(string_split(base_args, ', ')) AS pair FROM va WHERE raw_args IS NOT NULL)", "SELECT method, split_part(pair, '=', 1) AS name, split_part(pair, '=', 1) || '={' || string_agg(DISTINCT substr(pair, instr(pair, '=') + 1), ',' ORDER BY substr(pair, instr(pair, '=') + 1)) || '}' AS seen FROM ap GROUP BY method, split_part(pair, '=', 1)"),
        "distinct_paths": _after(fr(""), seen + "," + paths, "SELECT va.method, array_to_string(list_transform(bp.path, lambda x: replace(x, '()', '')), ' > ') AS path, count(*) AS times FROM va JOIN bp ON bp.call_id = va.b_call GROUP BY ALL"),
        "consequences": _after(fr(""), seen + "," + paths + f""",
          ou AS (SELECT DISTINCT va.method AS member, va.test_id, coalesce({outer_.format('bp')}, {outer_.format('pp')}) AS consequence FROM va LEFT JOIN bp ON bp.call_id = va.b_call LEFT JOIN pp ON pp.call_id = va.p_call),
          ch AS (SELECT r.test_id, r.method, r.ordinal, r.detail, b.call_id AS b_call, p.call_id AS p_call, b.return_rendered AS base_return, p.return_rendered AS pr_return, row_number() OVER (PARTITION BY r.test_id, r.method ORDER BY r.ordinal) AS k FROM rem r
            JOIN b ON b.test_id = r.test_id AND b.method = r.method AND b.pos = r.ordinal JOIN p ON p.test_id = r.test_id AND p.method = r.method AND p.pos = r.ordinal
            WHERE r.ordinal >= 0 AND (b.return_rendered IS DISTINCT FROM p.return_rendered OR b.exception_type IS DISTINCT FROM p.exception_type))""",
          """SELECT ou.member, ou.test_id, ou.consequence, ch.ordinal, ch.detail, ch.base_return, ch.pr_return, (SELECT NOT bool_and(untested) FROM fr WHERE fr.test_id = ou.test_id AND classification <> 'collateral') AS assertion_reacted,
            array_to_string(bp.path, ' > ') AS base_path, array_to_string(pp.path, ' > ') AS pr_path,
            (SELECT coalesce(string_agg(DISTINCT c.path, '|' ORDER BY c.path), '') FROM changed c WHERE list_contains(bp.path || pp.path, replace(replace(c.path, 'src/', 'App.'), '.py', '()'))) AS changed_files
          FROM ou JOIN ch ON ch.test_id = ou.test_id AND ch.method = ou.consequence AND ch.k = 1 LEFT JOIN bp ON bp.call_id = ch.b_call LEFT JOIN pp ON pp.call_id = ch.p_call"""),
        "report_order": fo("SELECT method, CAST(row_number() OVER w AS INTEGER) AS place, CASE WHEN untested_call_sites > 0 THEN 'gap' ELSE 'covered' END AS section, row_number() OVER w = 1 AS lead FROM fo WINDOW w AS (ORDER BY CASE WHEN attribution = 'unexpected' THEN 0 ELSE 1 END, call_sites DESC, method)"),
        "within_budget": "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 900",
        "ungrounded": cited + """, i AS (SELECT item_id, unnest(list_transform(string_split(text, ' '), lambda w: kinds[length(w) % 4 + 1] || ': ' || w)) AS w FROM items, kinds),
          x AS (SELECT item_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS missing FROM i WHERE w NOT IN (SELECT citation FROM corpus) GROUP BY item_id)
          SELECT b.item_id AS claim_id, coalesce(x.missing, '') AS missing, x.item_id IS NULL AS accepted FROM benchmark b LEFT JOIN x ON x.item_id = b.item_id""",
        "report_texts": """WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS u FROM pages),
          q AS (SELECT *, CASE page_id % 3 WHEN 0 THEN u || '/obj/x.g.cs' WHEN 1 THEN u || '.generated.ts' ELSE u END AS path FROM p)
          SELECT page_id, split_part(path, '/', 1) AS segment, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') AS stem, page_id % 3 < 2 AS generated,
            (page_id % 50) * CASE WHEN page_id % 2 = 0 THEN 3600 ELSE 86400 END AS seconds, 'a=' || u || '''' AS shown, replace(u, '|', '\\|') || '\\| ' AS cell,
            array_to_string(list_distinct_in_order, ' ') AS items FROM (SELECT *, CASE WHEN u = 'a' THEN ['a'] ELSE [u, 'a'] END AS list_distinct_in_order FROM q)""",
    }


def _after(head: str, more: str, select: str) -> str:
    """A query with more common tables after those of head."""
    return f"{head.rstrip()},\n{more}\n{select}"
