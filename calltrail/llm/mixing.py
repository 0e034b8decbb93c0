"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents are counted into cells (source, language, topic). A cell's weight is its tokens times one factor for each of its three values; a step sets
the factors of one dimension so that its values have their target shares, and rounds over the dimensions go on until no
share is off by more than ``tolerance`` (or ``rounds`` are over, where the targets contradict each other; the residual is
returned). A document is kept with probability min(1, rate * the product of its factors), where rate makes the expected tokens ``keep_share`` of all (cells that
reach 1 hand their surplus to the others), decided by a hash of its id, so equal ids are decided alike on every run.

Only the cells are iterated, not the documents: each carries its values' targets and factors, so that a round is one window a dimension and no join; each round's cells are a table
in the shared folder, so plans stay small, no step is computed twice, and the driver keeps one small plan a round.

Targets of values that do not occur are left out and the others scaled up. A null source, language or topic is a value of its own,
``unknown``. Null or empty text has no tokens and is kept with its cell's probability (rate where the cell has no tokens). Extra columns are
passed on; those called like a column of the result get the ending ``_in``. Repeated rows are counted and decided each; a row without an id is drawn by its text. No rows, no output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.llm.shared import apart, written

DIMENSIONS = ("source", "lang", "topic")
SYMBOLS = "!#$%&*+-/<=>@^_|~{}[]()"


def tokens(text: Column) -> Column:
    """Words as runs between single spaces; 0 for null or empty text."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


def form(text: Column) -> Column:
    """A topic for corpora without topic labels: what kinds of characters a text is made of, and its length."""
    n = F.length(text)
    share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / n
    return F.when(n == 0, "empty").when(share("0123456789") > 0.08, "numeric").when(share(SYMBOLS) > 0.08, "symbols").when(n < 1000, "short").when(n >= 5000, "long").otherwise("prose")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """value, share: shares of tokens raised to a power, as targets that flatten a distribution."""
    return cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0").select("value", F.pow("t", F.lit(power)).alias("share"))


def described(docs: DataFrame, topic: Column, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return docs.select("*", F.struct(F.col(key).alias("doc_id"), known(F.col(source)).alias("source"), known(F.col(lang)).alias("lang"), known(topic).alias("topic"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).alias("_mix"))


def calibrated(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 30, tolerance: float = 1e-6, keep_share: float = 0.3) -> tuple[DataFrame, float, float]:
    """source, lang, topic, factor for each cell, the rate and the residual; targets have value and share (any scale) for each dimension."""
    cells = written(cells, "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells
    for d in DIMENSIONS:
        present = cells.where("tokens > 0").select(F.col(d).alias("value")).distinct()
        share = written(targets[d].join(present, "value", "left_semi"), f"share_{d}")
        mass = share.agg(F.sum("share")).first()[0] or 1.0
        aims = share.select(F.col("value").alias(d), (F.col("share") / mass * total).alias(f"aim_{d}"))
        # 0 where a value has no target
        state = state.join(aims, d, "left").withColumns({f"f_{d}": F.when(F.col(f"aim_{d}").isNotNull(), 1.0).otherwise(0.0), f"off_{d}": F.lit(0.0)})
    state = written(state, "state")

    def product(without: str | None = None) -> Column:
        """The factors of a cell so far."""
        out = F.lit(1.0)
        for d in DIMENSIONS:
            out = out if d == without else out * F.col(f"f_{d}")
        return out

    residual = 0.0
    for _ in range(rounds if total else 0):
        for d in DIMENSIONS:
            aim, now = F.col(f"aim_{d}"), F.sum(F.col("tokens") * product(d)).over(Window.partitionBy(d))
            state = state.withColumn("now", now)
            off = F.when((aim > 0) & (F.col("now") > 0), F.abs(F.col(f"f_{d}") * F.col("now") / aim - 1)).otherwise(0.0)
            state = state.withColumn(f"off_{d}", off).withColumn(f"f_{d}", F.when(F.col("now") > 0, F.coalesce(aim / F.col("now"), F.lit(0.0))).otherwise(0.0)).drop("now")
        state = written(state, "state")
        residual = float(state.agg(F.max(F.greatest(*[f"off_{d}" for d in DIMENSIONS]))).first()[0] or 0.0)
        if residual <= tolerance:
            break
    final = written(state.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, product()).otherwise(1.0).alias("factor")), "calibrated")
    rate = keep_share
    while True:  # each time more cells are full, or the rate is found
        full, rest = final.agg(F.sum(F.when(F.col("factor") * rate >= 1, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(F.col("factor") * rate < 1, F.col("tokens") * F.col("factor")).otherwise(0.0)).cast("double")).first()
        now = (keep_share * total - full) / rest if rest else rate
        if now <= rate:
            return final, float(rate), residual
        rate = now


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] | None = None, topic: Column | None = None, keep_share: float = 0.3) -> DataFrame:
    """docs' columns, _mix (doc_id, source, lang, topic, tokens), probability and kept for every row.

    targets: value and share by dimension; a dimension without them aims at its shares of tokens to the power in powers (0.5).
    """
    docs = apart(docs, ("_mix", "_p", "probability", "kept"))
    rows = described(docs, form(F.coalesce(F.col("text"), F.lit(""))) if topic is None else topic)
    cells = written(rows.groupBy(*[F.col(f"_mix.{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_mix.tokens").alias("tokens")), "counts")
    aims = {d: (targets or {}).get(d, tempered(cells, d, (powers or {}).get(d, 0.5))) for d in DIMENSIONS}
    factors, rate, _ = calibrated(cells, aims, keep_share=keep_share)
    p = factors.select(*DIMENSIONS, F.round(F.least(F.lit(1.0), F.col("factor") * rate), 6).alias("probability"))
    keys = [F.col(f"_mix.{d}") == F.col(f"_p.{d}") for d in DIMENSIONS]
    joined = rows.join(p.select(F.struct(*DIMENSIONS).alias("_p"), "probability"), keys[0] & keys[1] & keys[2], "left").drop("_p")
    # a row without an id is drawn by its text
    named = F.coalesce(F.col("_mix.doc_id").cast("string"), F.col("text"), F.lit(""))
    u = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return joined.withColumn("kept", F.coalesce(u < F.col("probability"), F.lit(False)))
