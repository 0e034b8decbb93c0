"""Running sums inside groups, with groups that are cut over tasks."""

from itertools import accumulate
from operator import xor

import pytest
from pyspark.sql import functions as F

from calltrail.operators import scans


def _expected(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        out += [(*r, n, s, x) for r, n, s, x in zip(g, range(1, len(g) + 1), accumulate(r[2] for r in g), accumulate((r[3] for r in g), xor), strict=True)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_running_sums_whatever_the_parts(spark, hot_rows):
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}", None if i % 41 == 0 else (i * 7919) % 500, i, (i * 2654435761) % 2**40) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, at long, v long, h long")
    got = scans.running(df, ["k"], F.col("at"), [F.col("v")], {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "x": ("xor", F.col("h"))}, hot_rows)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == _expected(rows)


def test_a_hot_key_is_dealt_over_all_tasks(spark):
    df = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = scans.running(df, ["k"], F.col("at"), [], {"n": ("count", F.lit(1))}, hot_rows=100)
        sizes = sorted(r[1] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert got.where("k = 0").agg(F.max("n"), F.count_distinct("n")).first() == (4000, 4000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # in one task the hot key alone would make 4,000 + 500
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_the_whole_table_and_no_rows(spark):
    df = spark.range(1000).select(((F.col("id") * 7) % 1000).alias("v"))
    assert scans.running(df, [], F.col("v"), [], {"n": ("count", F.lit(1))}, hot_rows=0).where("n = v + 1").count() == 1000
    assert scans.running(df.where("v < 0"), [], F.col("v"), [], {"n": ("count", F.lit(1))}).count() == 0
