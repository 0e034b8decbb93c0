"""A round of fitting is one small plan."""

import pytest
from pyspark.sql import functions as F

from calltrail.llm import mixing


def test_a_round_writes_once_and_joins_nothing(spark, monkeypatch):
    plans, write = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name="table": plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    rows = [("a", "x", "t", 10), ("a", "y", "t", 30), ("b", "x", "t", 20), ("b", "y", "u", 40), ("c", "x", "u", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    aims = {d: spark.createDataFrame(v, "value string, share double") for d, v in (("source", [("a", 1.0), ("b", 1.0), ("z", 5.0)]), ("lang", [("x", 3.0), ("y", 1.0)]), ("topic", [("t", 1.0), ("u", 1.0)]))}
    found, _, residual = mixing.calibrated(cells, aims, rounds=4)
    rounds = [plan for name, plan in plans if name == "state"][1:]
    assert 0 < len(rounds) <= 4 and not [p for p in rounds if "Join" in p] and len(plans) == len(rounds) + 6
    total = lambda d: {r[0]: r[1] for r in found.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor"))).collect()}
    if residual <= 1e-6:
        assert total("source")["a"] == pytest.approx(50, rel=1e-4) and total("lang")["x"] == pytest.approx(75, rel=1e-4)
    assert {r["factor"] for r in found.where("source = 'c'").collect()} == {1.0}
