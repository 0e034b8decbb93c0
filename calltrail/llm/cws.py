"""Document fingerprints by improved consistent weighted sampling, in Spark SQL only.

A text is a bag of words (lower-cased, split at white space) weighted by how often each occurs. For sample k
and a word x of weight w: r and c are Gamma(2, 1) and b uniform, all drawn from hashes of (x, k);
t = floor(ln(w) / r + b); the sample is the (x, t) with the least ln(c) - r * (t - b + 1). Two texts agree in a
sample with a probability equal to their generalised Jaccard similarity, sum(min(w)) / sum(max(w)).

A fingerprint is ``samples`` numbers of 32 bits in hex; 0 stands for a text without words. Two such texts have a likeness of 1.

Rows are dealt out once, by blocks of consecutive ids. A block's rows are ordered by (id, text), so repeated ids are rows of
their own (a text's words, the edited text's and the digest are one row's arrays until they are exploded, so a very long text must fit a task's memory a few times). The text that follows a block's last row comes from a table with one row per block; the order of blocks is
found in groups of ``FAN`` numbers, that of the groups in groups again, ``LEVELS`` times, so that no window holds more, with dense ids or hashed ones. Word counts and
sample minima are then aggregated inside the same partitions. Rows that share an id are one window's work (ids name documents).

Null text counts as empty. A single row is its own successor. Extra columns are ignored. Null ids form a block before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.llm.shared import written

BLOCK = 256
FAN, LEVELS = 4096, 4


def _sample(k: int) -> Column:
    """The least of it over a bag is sample k: 32 bits of rank, 32 bits that name (word, t)."""
    h1, h2 = f"xxhash64(term_hash, {2 * k})", f"xxhash64(term_hash, {2 * k + 1})"
    r = f"(-ln((({h1} & 2097151) + 0.5D) / 2097152D * ((shiftrightunsigned({h1}, 21) & 2097151) + 0.5D) / 2097152D))"
    b = f"((shiftrightunsigned({h1}, 42) + 0.5D) / 4194304D)"
    t = f"floor(log_weight / {r} + {b})"
    log_c = f"ln(-ln((({h2} & 2147483647) + 0.5D) / 2147483648D * (shiftrightunsigned({h2}, 31) + 0.5D) / 8589934592D))"
    rank = f"cast(({log_c} - {r} * ({t} - {b} + 1) + 256D) * 4194304D as bigint)"
    return F.expr(f"shiftleft({rank}, 32) | (xxhash64({h2}, {t}) & 4294967295)")


def next_block(blocks: DataFrame) -> DataFrame:
    """block, next_block for distinct blocks; the last one's next is the first. No window holds more than FAN rows, however ids are spread."""

    def following(numbers: DataFrame, level: int) -> DataFrame:
        """n, next for distinct n."""
        if level == LEVELS:
            w = Window.partitionBy(F.lit(0))  # FAN ** LEVELS blocks of BLOCK ids are more than there are long integers
            return numbers.select("n", F.coalesce(F.lead("n").over(w.orderBy("n")), F.min("n").over(w)).alias("next"))
        grouped = numbers.select("n", F.floor(F.col("n") / FAN).alias("g"))
        firsts = grouped.groupBy("g").agg(F.min("n").alias("first"))
        after = following(firsts.select(F.col("g").alias("n")), level + 1)
        heads = after.join(firsts, after["next"] == firsts["g"]).select(after["n"].alias("g"), F.col("first").alias("head"))
        within = grouped.withColumn("lead", F.lead("n").over(Window.partitionBy("g").orderBy("n")))
        return within.join(heads, "g").select("n", F.coalesce("lead", "head").alias("next"))

    return following(blocks.select(F.col("block").alias("n")).distinct(), 0).select(F.col("n").alias("block"), F.col("next").alias("next_block"))


def _links(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """block, following: value of the first row of the next block."""
    first = rows.groupBy("block").agg(F.min_by(value, F.struct(*order)).alias("first"))
    return next_block(first).join(first.withColumnRenamed("block", "next_block"), "next_block").select("block", F.col("first").alias("following"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two arrays of samples agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def bags(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variant, term, n from keys and an array column ``variants`` of texts; a text without words has no row."""
    each = texts.select(*keys, F.posexplode("variants").alias("variant", "body"))
    words = each.select(*keys, "variant", F.explode(F.split(F.lower("body"), r"[ \t\n\x0B\f\r]+")).alias("term"))
    return words.where("term <> ''").groupBy(*keys, "variant", "term").agg(F.count("*").alias("n"))


def with_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """block, rn, doc_id, text and the edited text: the last half is replaced by the beginning of the next row's text."""
    rows = docs.select(F.coalesce(F.floor(F.col(key) / BLOCK), F.lit(-(1 << 60))).alias("block"), F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    w = Window.partitionBy("block").orderBy("doc_id", "text")
    ordered = rows.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("lead"))
    linked = ordered.join(_links(rows, "text", ["doc_id", "text"]), "block", "left")
    half = "floor(char_length(text) / 2)"
    return linked.select("block", "rn", "doc_id", "text", F.expr(f"concat(substring(text, 1, int(char_length(text) - {half})), substring(coalesce(lead, following), 1, int({half})))").alias("edited"))


def fingerprints(docs: DataFrame, samples: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_edited(docs, key, text)
    keys = ["block", "rn", "doc_id", "n_chars"]
    # the edited text's digest travels as a third bag of one marked word
    texts = rows.select("block", "rn", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.array("text", "edited", F.sha2("edited", 256)).alias("variants"))
    each = bags(texts, keys).select(*keys, "variant", "term", F.xxhash64("term").alias("term_hash"), F.log(F.col("n").cast("double")).alias("log_weight"))
    # the digest as numbers: an aggregation of nothing but numbers needs no sort
    quarter = lambda k: F.conv(F.substring("term", 1 + 16 * k, 16), 16, -10).cast("long")
    sha = [F.max(F.when(F.col("variant") == 2, quarter(k))).alias(f"q{k}") for k in range(4)]
    least = each.groupBy(*keys, "variant").agg(*sha, *[F.min(_sample(k)).alias(f"s{k}") for k in range(samples)])
    ids = F.array(*[F.col(f"s{k}").bitwiseAND(0xFFFFFFFF) for k in range(samples)])
    none = F.array_repeat(F.lit(0).cast("long"), samples)
    of = lambda v: F.coalesce(F.max(F.when(F.col("variant") == v, ids)), none)
    digest = F.concat(*[F.lpad(F.lower(F.hex(F.max(f"q{k}"))), 16, "0") for k in range(4)]).alias("edited_sha256")
    table = written(least.groupBy(*keys).agg(digest, of(0).alias("own"), of(1).alias("edited")), "fingerprints")
    w = Window.partitionBy("block").orderBy("rn")
    linked = table.withColumn("lead", F.lead("own").over(w)).join(_links(table, "own", ["rn"]), "block", "left")
    hexed = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return linked.select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("own")).alias("fingerprint"), hexed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.coalesce("lead", "following")).alias("near_next"),
    )
