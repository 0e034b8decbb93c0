"""The registered queries of the training-data operators, over the tables in sf_dir."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from calltrail.llm import chat, cws, decontaminate, importance, langid, minhash, mixing, packing, prefixtrie, suffixtree, toxicity, urllists, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(key: str, n: int):
    return F.crc32(F.col(key).cast("string")) % n


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _fold("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model, ["doc_id", held_out.alias("held_out")])


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score_texts(_table(spark, sf_dir, "documents"), _fold("doc_id", 5) == 1, files=True)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("_mix.*", "probability", "kept")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), _fold("doc_id", 5) == 0
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model, ["doc_id", held_out.alias("held_out")])


def op5_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


_START = 1704067200  # 2024-01-01
_DAY = 86400


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def url_history(captures: DataFrame) -> DataFrame:
    """Dated entries for the hosts of captures, by a rule on a hash of the name: ad hosts come, go and some return; malware domains; one path."""
    hosts = captures.select(urllists.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("long")
    h = hosts.withColumn("h", number(F.col("host")))
    d = hosts.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("domain")).distinct().withColumn("h", number(F.col("domain"))).where("h % 4 = 0")
    row = lambda df, name, key, action, day: df.select(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), F.timestamp_seconds(F.expr(f"{_START} + {_DAY} * ({day})")).alias("at"))
    host = F.col("host")
    parts = [
        row(h, "ads", host, "add", "h % 300"),
        row(h, "ads", host, "remove", "h % 300 + 20 + h % 50"),
        row(h.where("h % 3 = 0"), "ads", host, "add", "h % 300 + 100"),
        row(d, "malware", F.col("domain"), "add", "h % 200"),
        row(d, "malware", F.col("domain"), "remove", "h % 200 + 30"),
        row(h.where("h % 5 = 0"), "adult", F.concat(host, F.lit("/en")), "add", "h % 365"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a time that its id gives (within 2024), against the entries active then."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_seconds(F.lit(_START) + F.col("page_id") * 7919 % (366 * _DAY)).alias("fetched_at"))
    found = urllists.evaluate(pages, urllists.intervals(url_history(pages)))
    return found.withColumns({"fetched_at": F.unix_seconds("fetched_at"), "listed_from": F.unix_seconds("listed_from")})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations whose head is that of the first conversation of their five."""
    turns = prefixtrie.hashed(prefixtrie.numbered(_table(spark, sf_dir, "conversations")))
    return prefixtrie.prefix_trie(*prefixtrie.rebuilt(turns, 5, _fold("conv_id", 9), 8))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_words=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_tree": op1_suffix_tree,
        "op2_mixing": op2_mixing,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_weighted_fingerprints": op5_weighted_fingerprints,
        "op6_chat_format": op6_chat_format,
        "op7_url_lists": op7_url_lists,
        "op8_language_id": op8_language_id,
        "op9_decontamination": op9_decontamination,
        "op10_warc": op10_warc,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_best_fit_packing": op13_best_fit_packing,
        "pipeline": corpus_pipeline.run,
    }


def _op6_sql() -> str:
    t = chat.Template()
    escaped = "replace(text, '\\', '\\\\')"
    for c in t.controls:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
walked AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(length({escaped}) + CASE role {marks} END) AS BIGINT) AS formatted_chars,
  bool_and((before = '' AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant'))
    AND max_by(role, turn) = 'assistant' AS valid
FROM walked GROUP BY conv_id"""


_OP7_SQL = f"""
WITH caps AS (
  SELECT page_id, regexp_extract(lower(url), '{urllists._HOST}', 1) AS host, regexp_extract(lower(url), '{urllists._SEGMENT}', 1) AS segment,
         {_START} + (page_id * 7919) % {366 * _DAY} AS fetched_at FROM pages),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT host FROM caps WHERE host <> '')),
d AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT regexp_replace(host, '^[^.]+[.]', '') AS domain FROM h)),
history AS (
  SELECT 'ads' AS list, host AS key, 'add' AS action, {_START} + {_DAY} * (h % 300) AS t FROM h
  UNION ALL SELECT 'ads', host, 'remove', {_START} + {_DAY} * (h % 300 + 20 + h % 50) FROM h
  UNION ALL SELECT 'ads', host, 'add', {_START} + {_DAY} * (h % 300 + 100) FROM h WHERE h % 3 = 0
  UNION ALL SELECT 'malware', domain, 'add', {_START} + {_DAY} * (h % 200) FROM d WHERE h % 4 = 0
  UNION ALL SELECT 'malware', domain, 'remove', {_START} + {_DAY} * (h % 200 + 30) FROM d WHERE h % 4 = 0
  UNION ALL SELECT 'adult', host || '/en', 'add', {_START} + {_DAY} * (h % 365) FROM h WHERE h % 5 = 0),
state AS (SELECT list, key, t, max(action) AS action FROM history GROUP BY list, key, t),
changed AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY list, key ORDER BY t) AS before FROM state) WHERE before IS NULL OR before <> action),
spans AS (SELECT * FROM (SELECT list, key, action, t AS valid_from, lead(t) OVER (PARTITION BY list, key ORDER BY t) AS valid_to FROM changed) WHERE action = 'add'),
hits AS (
  SELECT c.page_id, s.list, s.key, s.valid_from,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.key) DESC, s.key, s.valid_from, s.list) AS n
  FROM caps c JOIN spans s
    ON (c.host = s.key OR ends_with(c.host, '.' || s.key) OR (c.segment <> '' AND s.key = c.host || '/' || c.segment))
   AND s.valid_from <= c.fetched_at AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)),
found AS (
  SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
         max(CASE WHEN n = 1 THEN key END) AS rule, max(CASE WHEN n = 1 THEN valid_from END) AS listed_from FROM hits GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched_at, f.page_id IS NOT NULL AS blocked, CAST(coalesce(n_entries, 0) AS BIGINT) AS n_entries,
       coalesce(lists, '') AS lists, rule, listed_from
FROM caps c LEFT JOIN found f ON c.page_id = f.page_id"""

_OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END AS refers_to
FROM g"""


def _op2_sql(rounds: int = 30, tolerance: float = 1e-6, keep_share: float = 0.3) -> str:
    """The same rounds as a chain of small tables over the cells; s says whether the round before was the last."""
    parts = ["""
d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE WHEN length(t) = 0 THEN 'empty' WHEN (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) / length(t) > 0.08 THEN 'numeric'
       WHEN (length(t) - length(regexp_replace(t, '[-!#$%&*+/<=>@^_|~{}()\\[\\]]', '', 'g'))) / length(t) > 0.08 THEN 'symbols'
       WHEN length(t) < 1000 THEN 'short' WHEN length(t) >= 5000 THEN 'long' ELSE 'prose' END AS topic,
  CASE WHEN length(t) > 0 THEN length(t) - length(replace(t, ' ', '')) + 1 ELSE 0 END AS tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY source, lang, topic)"""]
    for x in mixing.DIMENSIONS:
        parts.append(f"m_{x} AS (SELECT {x}, sqrt(sum(tokens)) AS s FROM cells GROUP BY {x} HAVING sum(tokens) > 0)")
        parts.append(f"aim_{x} AS MATERIALIZED (SELECT {x}, s / (SELECT sum(s) FROM m_{x}) * (SELECT sum(tokens) FROM cells) AS aim FROM m_{x})")
    last = "(SELECT source, lang, topic, tokens, tokens AS w FROM cells)"
    parts.append("s0 AS MATERIALIZED (SELECT false AS s)")
    for i in range(rounds):
        for x in mixing.DIMENSIONS:
            name = f"w{i}_{x}"
            parts.append(f"f{i}_{x} AS MATERIALIZED (SELECT a.{x}, CASE WHEN (SELECT s FROM s{i}) THEN 1.0 ELSE max(a.aim) / sum(p.w) END AS by_ FROM {last} p JOIN aim_{x} a ON p.{x} = a.{x} GROUP BY a.{x} HAVING sum(p.w) > 0)")
            parts.append(f"{name} AS MATERIALIZED (SELECT p.source, p.lang, p.topic, p.tokens, p.w * coalesce(f.by_, 0) AS w FROM {last} p LEFT JOIN f{i}_{x} f ON p.{x} = f.{x})")
            last = name
        offs = " UNION ALL ".join(f"SELECT abs(1 / by_ - 1) AS off FROM f{i}_{x}" for x in mixing.DIMENSIONS)
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT coalesce(max(off), 0) <= {tolerance} AS s FROM ({offs}))")
    parts.append(f"final AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS factor FROM {last})")
    parts.append(f"r0 AS MATERIALIZED (SELECT CAST({keep_share} AS DOUBLE) AS rate)")
    for i in range(12):
        parts.append(f"""r{i + 1} AS MATERIALIZED (SELECT greatest(max(rate), coalesce(({keep_share} * sum(tokens) - sum(CASE WHEN factor * rate >= 1 THEN tokens ELSE 0 END))
  / nullif(sum(CASE WHEN factor * rate < 1 THEN tokens * factor ELSE 0 END), 0), max(rate))) AS rate FROM final, r{i})""")
    parts.append("p AS (SELECT source, lang, topic, round(least(1.0, factor * rate), 6) AS probability FROM final, r12)")
    return "WITH " + ",\n".join(parts) + """
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.tokens AS BIGINT) AS tokens, p.probability,
  CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 < p.probability AS kept
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""


#: Values of one byte's eight steps of CRC-32 with the reversed polynomial 0xEDB88320.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"


def _crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, where crc (as of _CRC_TABLE) is in scope."""
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({hexed}), 2), lambda i: CAST('0x' || substr({hexed}, i, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


_OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
convs AS (
  SELECT s.conv_id, s.n, s.conv_id - s.conv_id % 5 AS base, {_crc("CAST(s.conv_id AS VARCHAR)")} % 9 AS h, coalesce(b.n, 0) AS n_base
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 5, {_CRC_TABLE}),
steps AS (
  SELECT c.conv_id, o.pos AS depth, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base WHERE o.pos <= c.h
  UNION ALL SELECT c.conv_id, least(c.h, c.n_base) + o.pos - c.h, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id WHERE o.pos > c.h),
paths AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS prefix FROM steps
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ends AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p.depth, p.prefix, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.bytes) AS bytes,
    coalesce(string_agg(CAST(e.conv_id AS VARCHAR), ',' ORDER BY e.conv_id), '') AS ended
  FROM paths p LEFT JOIN ends e ON e.conv_id = p.conv_id AND e.depth = p.depth GROUP BY p.depth, p.prefix),
up AS (
  SELECT n.depth, n.prefix, a.depth AS a_depth, a.prefix AS a_prefix FROM nodes n JOIN paths a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
children AS (SELECT a_depth AS depth, a_prefix AS prefix, count(*) AS n_children FROM up WHERE depth = a_depth + 1 GROUP BY ALL),
below AS (
  SELECT u.a_depth AS depth, u.a_prefix AS prefix, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (c.n_children IS NULL) AS leaves
  FROM up u JOIN nodes n ON n.depth = u.depth AND n.prefix = u.prefix LEFT JOIN children c ON c.depth = u.depth AND c.prefix = u.prefix GROUP BY u.a_depth, u.a_prefix)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM nodes n JOIN below b ON b.depth = n.depth AND b.prefix = n.prefix LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
LEFT JOIN up u ON u.depth = n.depth AND u.prefix = n.prefix AND u.a_depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = u.a_depth AND p.prefix = u.a_prefix"""

_OP12_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{importance._UPPER}', '{importance._LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{importance._UPPER}', '{importance._LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
dw AS (SELECT row, unnest(words) AS word FROM d),
vocabulary AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM b)), {_CRC_TABLE}),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN vocabulary USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM b) AS all_t),
gains AS (
  SELECT range AS bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(totals.all_s + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(totals.all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM range(10000) r LEFT JOIN s ON s.bucket = r.range LEFT JOIN t ON t.bucket = r.range, totals),
weights AS (SELECT row, sum(gain) AS weight FROM dw JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_features, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(w.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights w USING (row)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= eligible * 10 // 100 THEN place END AS rank FROM ranked"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": _OP11_SQL, "op12_importance_resampling": _OP12_SQL, "op2_mixing": _op2_sql(), "op6_chat_format": _op6_sql(), "op7_url_lists": _OP7_SQL, "op10_warc": _OP10_SQL}
