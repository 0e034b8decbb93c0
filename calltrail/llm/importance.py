"""Importance resampling towards a target distribution, by hashed word n-grams in a position table.

Texts are laid out as a table (row, position, word). For orders above one, ``lead`` over a row's positions adds the words that follow, which gives the runs of 2 to
``orders`` words that begin at a position. Every run is hashed into one of ``buckets``. Grouped by bucket, runs of documents and of target texts are two histograms, and a
bucket's gain is the logarithm of their smoothed ratio, in thousandths; joined back to the runs, gains sum to a document's weight. Documents are then drawn without
replacement by the largest weight plus a Gumbel value, which is made from a hash of the id: the same draw every time.

With order one no row leaves its task before it is counted: per task, buckets are counted and weights summed before the exchange. With higher orders, texts are dealt
by row once, ahead of the position table. The table of gains has ``buckets`` rows, which is the bound of what is broadcast. Ranks of the draw come from parts of the
score's range (``operators.scans``), not from one sorted task. Functions of Spark SQL only.

Null text has no words, so weight 0. Repeated rows are documents each; equal scores go by the smaller id, null ids last (their hash is of no digits). A text's
words are one array until they are exploded, so a very long text must fit a task's memory a few times. Extra columns are ignored. No documents, no rows; no target: every t is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.llm.shared import written
from calltrail.operators import scans

#: Everything in ASCII that is no digit and no letter; other characters belong to words.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """A-Z only; lower() is that, and cheaper, for words of ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def position_table(texts: DataFrame, orders: int) -> DataFrame:
    """Columns of texts (but text), gram and first: the runs of 1 to orders words that begin at each position; a row with a null gram where a text has none.

    texts: row, text and what is to be carried. first marks runs of one word.
    """
    keep = [c for c in texts.columns if c != "text"]
    rows = texts if orders == 1 else texts.repartition("row")
    words = rows.select(*keep, F.posexplode_outer(F.split("text", _BETWEEN)).alias("pos", "raw"))
    # an empty string stands before a leading or after a trailing separator
    words = words.select(*keep, "pos", F.when(F.col("raw") != "", _lowered(F.col("raw"))).alias("gram"))
    if orders == 1:
        return words.select(*keep, "gram", F.lit(True).alias("first"))
    w = Window.partitionBy("row").orderBy("pos")
    runs = [F.col("gram")]
    for k in range(1, orders):
        runs.append(F.when(runs[-1].isNotNull() & F.lead("gram", k).over(w).isNotNull(), F.concat(runs[-1], F.lit(" "), F.lead("gram", k).over(w))))
    wide = words.select(*keep, *[r.alias(f"_{k}") for k, r in enumerate(runs)])
    each = F.array(*[F.struct(F.col(f"_{k}").alias("gram"), F.lit(k == 0).alias("first")) for k in range(orders)])
    return wide.select(*keep, F.explode(F.filter(each, lambda x: x["gram"].isNotNull() | x["first"])).alias("g")).select(*keep, "g.gram", "g.first")


def _bucket(buckets: int) -> Column:
    return (F.crc32(F.col("gram")) % buckets).cast("int").alias("bucket")


def histogram(texts: DataFrame, orders: int, buckets: int, name: str) -> DataFrame:
    """bucket and the number of its runs in texts."""
    return position_table(texts, orders).where("gram IS NOT NULL").groupBy(_bucket(buckets)).agg(F.count("*").alias(name))


def gains(documents: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000) -> DataFrame:
    """A row per bucket: gain, floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), as a table."""
    s, t = histogram(documents, orders, buckets, "s"), histogram(target, orders, buckets, "t")
    both = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"])
    both = written(both, "histograms")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float((all_s or 0) + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float((all_t or 0) + buckets)))
    return written(both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain")), "gains")


def weigh(documents: DataFrame, gained: DataFrame, orders: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of documents (row, doc_id, text)."""
    runs = position_table(documents, orders).withColumn("bucket", _bucket(buckets))
    summed = runs.join(F.broadcast(gained), "bucket", "left").groupBy("row", "doc_id")
    return summed.agg(F.count_if(F.col("first") & F.col("gram").isNotNull()).alias("n_words"), F.count("gram").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight")).drop("row")


def resample(documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", orders: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document; percent of those with min_words or more words are drawn."""
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if orders > 1:  # rows are dealt by their number, which must then stay
        docs = written(docs, "documents")
    aim = target.select(F.monotonically_increasing_id().alias("row"), F.col(target_text).cast("string").alias("text"))
    weighed = weigh(docs, gains(docs.drop("doc_id"), aim, orders, buckets), orders, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = written(weighed.withColumns({"score": F.col("weight") + gumbel, "_eligible": F.col("n_words") >= min_words}), "scored")
    n = (scored.where("_eligible").count() * percent) // 100
    order = F.when(F.col("_eligible"), -F.col("score")).otherwise(F.lit((1 << 63) - 1))
    placed = scans.running(scored, [], order, [F.col("doc_id").asc_nulls_last()], {"_place": ("count", F.lit(1))}, hot_rows=0)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_eligible") & (F.col("_place") <= n), F.col("_place")).alias("rank"))


def drawn(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that were drawn, whole rows."""
    ids = found.where("rank IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    return documents.join(ids, key, "left_semi").select(*documents.columns)
