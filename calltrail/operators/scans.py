"""Running counts and sums in the order of a group's rows, with one group spread over many tasks.

A window over a key gives one task all rows of the key. Here a key with more rows than ``hot_rows`` (and than the table's share of one shuffle
partition) is cut along its order first: quantiles of the leading order column, as many as the key has such shares, deal its rows into
consecutive parts. Windows run over (key, part), and what came before a part, the sums of the key's earlier parts, is added from a table with one row a
part. There are fewer hot keys than shuffle partitions and at most twice as many parts, whatever the size of the input, so both small tables
are broadcast. Without a hot key nothing but one count per key is added to the plain window.

Rows with the same leading order value stay in one part (null is the least). Results don't hang on how keys were cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.tables import stored

PART = "_part"
_COMBINE = {"sum": F.sum, "count": F.count, "xor": F.bit_xor}


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(and_, [left[n].eqNullSafe(right[f"_r_{n}"]) for n in names], F.lit(True))


def _beside(left: DataFrame, right: DataFrame, names: Sequence[str], take: str) -> DataFrame:
    """left with the column take of the few rows of right that have the same (also null) values of names."""
    few = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], take)
    return left.join(F.broadcast(few), _same(left, few, names), "left").select(*left.columns, take)


def cut(df: DataFrame, key: Sequence[str], by: Column, hot_rows: int = 1_000_000) -> DataFrame | None:
    """df with the column _part: null but for hot keys, where it rises with by from 0; None if no key is hot."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*key).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    share = max(1, hot_rows, (total or 0) // n)
    if (most or 0) <= share:
        return None
    value = by.cast("long")
    some = _beside(df.withColumn("_by", value), counts.where(F.col("_n") > share), key, "_n").where("_n IS NOT NULL")
    fractions = [i / n for i in range(1, n)] or [0.5]
    parts = F.least(F.ceil(F.col("_n") / share), F.lit(max(2, n))).cast("int")
    at = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_q", F.floor(i * len(fractions) / parts).cast("int")))
    cuts = stored(some.groupBy(*key, "_n").agg(F.percentile_approx("_by", fractions, 10 * n).alias("_q")).select(*key, at.alias("_cuts")))
    part = F.when(F.col("_cuts").isNotNull(), F.when(value.isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < value))))
    return _beside(df, cuts, key, "_cuts").withColumn(PART, part).drop("_cuts")


def running(df: DataFrame, key: Sequence[str], by: Column, then: Sequence[Column], sums: dict[str, tuple[str, Column]], hot_rows: int = 1_000_000, deal: Sequence[str] = ()) -> DataFrame:
    """df with, for each name of sums, what (kind, column) comes to over the key's rows up to and with this one.

    Order: by (cast to long, null first), then the columns of then. Kinds: sum, count (of values that are not null), xor. df is read a few times and must give the
    same rows each time. deal: a part of key by which rows are dealt beforehand where no key is hot, for later steps that want them so. No key: the whole table
    is one group.
    """
    made = lambda: [_COMBINE[kind](c).alias(name) for name, (kind, c) in sums.items()]
    over = lambda w: [_COMBINE[kind](c).over(w).alias(name) for name, (kind, c) in sums.items()]
    order = [by.asc_nulls_first(), *then]
    parted = cut(df, key, by, hot_rows)
    if parted is None:
        rest = [k for k in key if k not in deal]
        if deal:  # always true; the window asks that rows be dealt by deal, which costs nothing where they are, and has the next one's order
            df = df.withColumn("_at", F.row_number().over(Window.partitionBy(*deal).orderBy(*rest, *order))).where("_at > 0").drop("_at")
        return df.select("*", *over(Window.partitionBy(*deal, *rest).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    # also rows that are dealt by a part of the key already are spread by parts
    parted = parted.repartition(*key, PART) if deal else parted
    local = parted.select("*", *over(Window.partitionBy(*key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = parted.where(F.col(PART).isNotNull()).groupBy(*key, PART).agg(*made())
    w = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*key, PART, F.struct(*[(F.bit_xor if kind == "xor" else F.sum)(name).over(w).alias(name) for name, (kind, _) in sums.items()]).alias("_before"))
    joined = _beside(local, earlier, [*key, PART], "_before")
    plus = lambda kind, a, b: a.bitwiseXOR(b) if kind == "xor" else a + b
    whole = {name: plus(kind, F.col(name), F.coalesce(F.col(f"_before.{name}"), F.lit(0))) for name, (kind, _) in sums.items()}
    return joined.withColumns(whole).drop("_before", PART)
