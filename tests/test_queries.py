import pytest
from oracle import SF, assert_same

from calltrail.plans import registry


@pytest.fixture(scope="module", autouse=True)
def walked_once():
    """The queries of the frontier share one walk of the runs, whose results are tables; each alone would walk them again."""
    kept, walk = {}, registry._walked

    def once(spark, sf_dir):
        if sf_dir not in kept:
            kept[sf_dir] = walk(spark, sf_dir)
        return kept[sf_dir]

    registry._walked = once
    yield
    registry._walked = walk


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def test_queries_without_sql_run(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert "detail" in __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
