"""Claims about a member and what grounds them: a typed corpus of citations, rules on which kinds a claim must cite, and claims that restate an observed value.

A corpus is a table (member, kind, citation), a claim a row (claim_id, member, why, why_citations, test, test_citations). Citations are looked up by equi-joins on (member, citation). Observed
values are searched in claims as whole tokens by an inverted index: a value goes by its longest token, claims by their distinct tokens, and only pairs that share
one are compared as texts. Values without a token go by the member alone, against what its claims hold besides tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of citations, and words that tell an outcome.
KINDS = ("MEMBER", "SOURCE", "ASSERTION", "OBSERVATION", "CALL_PATH", "CONSEQUENCE", "RELATED", "DIFF")
OUTCOME_WORDS = r"(?i)\b(?:return(?:s|ed)?|result(?:s)?|output(?:s)?|succeed(?:s|ed)?|success|fail(?:s|ed|ure)?)\b"
MAX_SENTENCES = 2


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?](?:\s|$)"))


def sanitized(text: Column) -> Column:
    """Fit for HTML and for a comment: markup, Latin-1 and supplementary characters as entities, mentions made harmless, one line."""
    entity = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "@": "(at)", "\r": " ", "\n": " "}
    code = lambda c: F.ascii(c)  # noqa: E731  # a code point, whatever the name says
    named = F.create_map(*[F.lit(x) for pair in entity.items() for x in pair])
    one = lambda c: F.coalesce(F.try_element_at(named, c), F.when(code(c).between(160, 255) | (code(c) > 0xFFFF), F.concat(F.lit("&#"), code(c).cast("string"), F.lit(";"))), c)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), one), "")


def _fields(kind: str, **values: Column) -> Column:
    return F.concat(F.lit(f"{kind}: "), F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in values.items()]))


def _first(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows of each member (all without n); each task keeps its own first n before any row is moved."""
    if n is None:
        return rows
    w = Window.partitionBy("method").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def corpus(members: DataFrame, evidence: DataFrame, consequences: DataFrame, related: DataFrame, patches: DataFrame, shown: int | None = 3) -> DataFrame:
    """(member, kind, citation) of every member.

    members, evidence and consequences are those of findings; related: (method, related), other members whose first observation supports it; patches: (file_path, line), lines of unified
    diffs of the members' files. shown: how many observations and consequences of a member are citable (None: all).
    """
    c = F.col
    at = [F.coalesce(c(x).cast("string"), F.lit("unresolved")) for x in ("file_path", "line")]
    m = members.select(c("method"), F.explode(F.array(F.concat(F.lit("MEMBER: "), "method"), F.concat(F.lit("SOURCE: "), at[0], F.lit(":"), at[1]), F.concat(F.lit("ASSERTION: "), "assertion_reaction"))).alias("citation"))
    seen = _first(evidence, shown, "test_id", "ordinal", "kind", "detail")
    values = {"baseArgs": c("base_args"), "prArgs": c("pr_args"), "baseReturn": c("base_return"), "prReturn": c("pr_return")}
    thrown = {"baseException": c("base_exception"), "prException": c("pr_exception")}
    path = F.concat(F.lit("CALL_PATH: "), F.array_join(F.coalesce(F.transform("pr_path", lambda n: n["member"]), F.array().cast("array<string>")), " -> "))
    observed = seen.select("method", F.explode(F.array(_fields("OBSERVATION", test=c("test_id"), **values, **thrown), path)).alias("citation"))
    after = _first(consequences.withColumnRenamed("member", "method"), shown, "test_id", "consequence")
    followed = after.select("method", _fields("CONSEQUENCE", test=c("test_id"), member=c("consequence"), baseReturn=c("base_return"), prReturn=c("pr_return"), **thrown).alias("citation"))
    one = _first(evidence, 1, "test_id", "ordinal", "kind", "detail").withColumnRenamed("method", "related")
    beside = related.join(one, "related").select("method", _fields("RELATED", member=c("related"), test=c("test_id"), **values).alias("citation"))
    line = F.rtrim(c("text"), F.lit("\r"))
    edited = patches.withColumn("text", line).where("(text LIKE '+%' AND text NOT LIKE '+++%') OR (text LIKE '-%' AND text NOT LIKE '---%')")
    diff = members.select("method", "file_path").join(edited, "file_path").select("method", F.concat(F.lit("DIFF: "), "file_path", F.lit(": "), "text").alias("citation"))
    rows = reduce(DataFrame.unionByName, [m, observed, followed, beside, diff])
    return rows.select(c("method").alias("member"), F.substring_index("citation", ": ", 1).alias("kind"), "citation").distinct()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), 0)


def restated(claims: DataFrame, values: DataFrame) -> DataFrame:
    """(claim_id, value): values (member, value) that occur in a claim's text (claim_id, member, text) as whole tokens, whatever the case."""
    low = F.lower("value")
    v = values.where("value <> ''").select("member", low.alias("value")).distinct()
    # ties between longest tokens: the greatest
    longest = F.array_max(F.transform(tokens(F.col("value")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    v = v.withColumn("token", longest)
    c = claims.select("claim_id", "member", F.lower("text").alias("text"))
    indexed = c.select("claim_id", "member", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    pairs = indexed.join(v.where("token IS NOT NULL"), ["member", "token"]).select("claim_id", "member", "value")
    odd = c.select("claim_id", "member").join(v.where("token IS NULL").select("member", "value"), "member").select("claim_id", "member", "value")
    inside = F.rlike("text", F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9_])")))
    # most pairs share a token only: a plain search comes before the pattern, which is made anew for each pair
    return pairs.unionByName(odd).join(c.select("claim_id", "text"), "claim_id").where(F.contains("text", "value") & inside).select("claim_id", "value").distinct()


def outcome_values(evidence: DataFrame, consequences: DataFrame) -> DataFrame:
    """(member, value): scalar results that a member's evidence and consequences show, as they would be restated."""
    rows = evidence.select(F.col("method").alias("member"), F.explode(F.array("base_return", "pr_return")).alias("shown")).unionByName(consequences.select("member", F.explode(F.array("base_return", "pr_return")).alias("shown")))
    scalar = F.regexp_extract("shown", r"^Primitive:([^,;\]\}\s]+)$", 1)
    return rows.where(F.col("shown").isNotNull()).select("member", F.trim(scalar, F.lit('"')).alias("value")).where("value <> ''").distinct()


def judged(claims: DataFrame, known: DataFrame, values: DataFrame) -> DataFrame:
    """(claim_id, problems, accepted) of every claim; known: a corpus, values: as of outcome_values. All problems are named, in alphabetical order.

    A why must cite an OBSERVATION and a DIFF, and a CONSEQUENCE and a RELATED where its member's corpus has one; a test must cite an OBSERVATION. Every citation must be in the corpus. A
    why has two sentences at most and restates no outcome.
    """
    each = claims.select("claim_id", "member", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(f"{p}_citations", F.array().cast("array<string>")).alias("cited")) for p in ("why", "test")])).alias("p"))
    cited = each.select("claim_id", "member", "p.part", F.explode("p.cited").alias("citation"))
    problem = lambda df, text: df.select("claim_id", (text if isinstance(text, Column) else F.lit(text)).alias("problem"))
    unknown = problem(cited.join(known.select("member", "citation"), ["member", "citation"], "left_anti"), F.concat(F.lit("cites what is not in the corpus: "), "citation"))
    kind = F.substring_index("citation", ": ", 1)
    has = cited.groupBy("claim_id").agg(*[F.bool_or((F.col("part") == p) & (kind == k)).alias(f"{p}_{k}") for p, k in (("why", "OBSERVATION"), ("why", "DIFF"), ("why", "CONSEQUENCE"), ("why", "RELATED"), ("test", "OBSERVATION"))])
    offered = known.groupBy("member").agg(*[F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in ("CONSEQUENCE", "RELATED")])
    wide = claims.select("claim_id", "member", "why").join(has, "claim_id", "left").join(offered, "member", "left")
    lacks = lambda p, k: ~F.coalesce(f"{p}_{k}", F.lit(False))
    told = lambda k: F.coalesce(f"has_{k}", F.lit(False))
    rules = [
        (lacks("why", "OBSERVATION"), "why cites no OBSERVATION"), (lacks("why", "DIFF"), "why cites no DIFF"), (lacks("test", "OBSERVATION"), "test cites no OBSERVATION"),
        (told("CONSEQUENCE") & lacks("why", "CONSEQUENCE"), "why cites no CONSEQUENCE"), (told("RELATED") & lacks("why", "RELATED"), "why cites no RELATED"),
        (sentence_count(F.col("why")) > MAX_SENTENCES, "why has more than two sentences"), (F.rlike("why", F.lit(OUTCOME_WORDS)), "why tells an outcome"),
    ]
    broken = problem(wide, F.explode(F.array_compact(F.array(*[F.when(c, text) for c, text in rules]))))
    told_again = problem(restated(claims.select("claim_id", "member", F.col("why").alias("text")), values), F.concat(F.lit("why restates "), "value"))
    found = reduce(DataFrame.unionByName, [unknown, broken, told_again]).distinct().groupBy("claim_id").agg(F.array_sort(F.collect_list("problem")).alias("problems"))
    return claims.select("claim_id").join(found, "claim_id", "left").select("claim_id", F.coalesce("problems", F.array().cast("array<string>")).alias("problems"), F.col("problems").isNull().alias("accepted"))
