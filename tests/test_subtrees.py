"""The frontier numbers the nodes' subtrees only, with what numbering the whole run gives; questions about evidence walk what they read."""

from oracle import SF
from test_moved import same
from test_traces import event, frame

from calltrail import tables
from calltrail.operators import findings, frontier, tree
from calltrail.plans import adapter, audits, registry


def _diverged(spark, rows):
    return spark.createDataFrame(rows, "test_id string, method string, unalignable boolean")


def _by_whole_run(keys, base):
    """Collateral keys and descendants of the others by the numbers of every call."""
    order = tree.labels(base)
    calls = base.join(keys, frontier.KEY, "left_semi").select(*tree.CALL, *frontier.KEY)
    above = calls.join(tree.with_any_below(order, calls), tree.CALL, "left_semi").select(*frontier.KEY).distinct()
    collateral = keys.where("NOT unalignable").select(*frontier.KEY).join(above, frontier.KEY, "left_semi")
    return collateral, frontier.descendants(keys.join(collateral, frontier.KEY, "left_anti"), base, order)


def _agree(spark, keys, base):
    steps = tree.Steps(base)
    collateral = frontier.collateral_keys(keys, base, steps)
    nodes = keys.join(collateral, frontier.KEY, "left_anti")
    under = frontier.subtrees(nodes, base, steps)
    found = frontier.descendants(nodes, under, tree.labels(under))
    want, below = _by_whole_run(keys, base)
    same(collateral, want)
    plain = lambda df: df.select(*frontier.KEY, "d_test_id", "d_method", "found_at.process", "found_at.line_number")
    same(plain(found), plain(below))
    assert collateral.count() and found.count()
    return under


def test_subtrees_give_what_the_whole_run_gives(spark):
    # a deep chain, a bush, an orphan, a cycle (300, 301), and calls below the cycle
    parent = {i: (None if i % 37 == 0 else i - 1 if i < 30 else i // 3 if i % 2 else 40) for i in range(150)} | {200: 999, 201: 200, 300: 301, 301: 300, 302: 300, 303: 302}
    base = frame(spark, [event(call=c, parent=p, ordinal=c, line_number=1000 - c, method=f"App.m{c % 75 if c < 300 else c}()") for c, p in parent.items()])
    keys = _diverged(spark, [("T", f"App.m{c}()", c == 11) for c in (3, 11, 13, 20, 27, 40, 50, 300, 301, 302)] + [("T", "App.absent()", True)])
    under = _agree(spark, keys, base)
    assert under.count() < base.count() and under.where("call_id >= 300").isEmpty()


def test_only_subtrees_of_nodes_are_numbered(spark, monkeypatch):
    numbered, labels = [], tree.labels
    monkeypatch.setattr(tree, "labels", lambda e, *a: numbered.append(e.count()) or labels(e, *a))
    with tables.scratch(spark):
        calls = registry._walked(spark, SF)[2].count()
        assert len(numbered) == 1 and numbered[0] < calls / 10

def test_questions_walk_the_runs_that_they_read(spark, monkeypatch):
    with tables.scratch(spark):
        walked = registry._walked(spark, SF)
        nodes, left, base, pr = walked
        ev = tables.stored(findings.evidence(left, nodes, base, pr, adapter.changed(spark)))
        asked, paths = [], findings._paths
        monkeypatch.setattr(findings, "_paths", lambda rows, events, name, above: asked.append(name) or paths(rows, events, name, above))
        known = audits.queries(lambda *_: walked, None)
        for name, whose in (("argument_values", []), ("observations", []), ("distinct_paths", ["base_path"])):
            asked.clear()
            same(known[name](spark, SF), getattr(findings, name)(ev))
            assert asked == whose
