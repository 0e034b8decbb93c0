"""What is dealt by test once is not moved again, and questions store what they ask for only."""

from oracle import SF, rows

from calltrail import tables
from calltrail.operators import claims, findings, keys, tree
from calltrail.plans import adapter, inputs, registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    assert rows(a.columns, [tuple(map(str, r)) for r in a.collect()]) == rows(b.columns, [tuple(map(str, r)) for r in b.select(*a.columns).collect()])


def test_runs_are_moved_once_and_before_they_become_rows_a_run(spark):
    text = plan(adapter.runs(spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.index("Generate explode") < text.index("Window")  # from the top


def test_keys_of_runs_dealt_by_test_are_not_moved(spark):
    with tables.scratch(spark):
        events = tables.bucketed(adapter.runs(spark, SF), "test_id")
        of = lambda name: events.where(f"run = '{name}'")
        for found in (keys.matched_keys_in(events, "base1", "pr"), keys.noise_keys(events.where("run <> 'pr'"))):
            assert "Exchange hashpartitioning" not in plan(found)
        same(keys.matched_keys_in(events, "base1", "pr"), keys.matched_keys(of("base1"), of("pr")))
        same(keys.compare_in(events, "base1", "pr"), keys.compare(of("base1"), of("pr")))
        # a key with more rows than one task is to have is spread, whatever it was dealt by
        same(keys.compare_in(events, "base1", "pr", hot_rows=3), keys.compare(of("base1"), of("pr")))
        name = events.inputFiles()[0].rsplit("/", 2)[-2]
        assert spark.catalog.tableExists(name)
    assert not spark.catalog.tableExists(name)


def test_a_call_path_is_asked_without_a_walk(spark):
    def walked(*_):
        raise AssertionError("the frontier says nothing about the base run's calls")

    assert inputs.queries(walked)["listed_call_path"](spark, SF).count() > 0


def test_a_plain_search_comes_before_a_pattern_for_each_pair(spark):
    docs = spark.createDataFrame([(1, 1, "a red fox"), (2, 1, "a red ox and a Red\tfox"), (3, 1, "red foxes")], "claim_id int, member int, text string")
    found = claims.restated(docs, spark.createDataFrame([(1, "Red fox"), (1, "red"), (1, "\\Efox")], "member int, value string"))
    assert sorted(map(tuple, found.collect())) == [(1, "red"), (1, "red fox"), (2, "red"), (3, "red")]
    text = plan(found)
    assert text.lower().index("contains(text") < text.lower().index("rlike")


def test_a_row_an_event_is_stored_and_becomes_a_row_a_run_where_it_is_read(spark):
    with tables.scratch(spark):
        calls = tables.bucketed(adapter.calls(spark, SF), "test_id")
        assert calls.count() == spark.read.parquet(f"{SF}/events.parquet").count() and not [c for c in calls.columns if "digest" in c]
        both = adapter.as_runs(calls, ("base1", "pr"))
        for found in (keys.matched_keys_in(both, "base1", "pr"), keys.noise_keys(adapter.as_runs(calls, tuple(adapter.BASES)))):
            assert "Exchange hashpartitioning" not in plan(found)
        assert "sha2" not in plan(keys.matched_keys_in(both, "base1", "pr"))
        same(adapter.as_runs(calls), adapter.runs(spark, SF))


def test_consequences_go_on_with_the_steps_of_the_evidence(spark, monkeypatch):
    made, twice = [], tree._twice
    monkeypatch.setattr(tree, "_twice", lambda *a: made.append(a) or twice(*a))
    with tables.scratch(spark):
        nodes, left, base, pr = registry._walked(spark, SF)
        above = tree.Steps(base), tree.Steps(pr)
        made.clear()
        ev = tables.stored(findings.evidence(left, nodes, base, pr, adapter.changed(spark), above))
        first = len(made)
        shared = findings.consequences(ev, left, nodes, base, pr, adapter.changed(spark), above)
        assert first > 0 and len(made) <= first + 2  # at most one more doubling a run
        same(shared, findings.consequences(ev, left, nodes, base, pr, adapter.changed(spark)))


def test_steps_of_calls_with_two_parents_stay_distinct(spark):
    rows = [("r", "p", 1, None), ("r", "p", 2, 1), ("r", "p", 3, 1), ("r", "p", 4, 2), ("r", "p", 4, 3), ("r", "p", 5, 4)]
    e = spark.createDataFrame(rows, "run string, process string, call_id long, parent_call_id long")
    steps = tree.Steps(e)
    assert sorted((r.lo, r.hi) for r in steps.of(1).collect()) == [(4, 1), (5, 2), (5, 3)] and not steps.single
    up = tree.closure(e, e.where("call_id = 5"), down=False, steps=steps)
    assert sorted((r.call_id, r.distance) for r in up.collect()) == [(1, 3), (2, 2), (3, 2), (4, 1)]
