import pytest
from oracle import SF, assert_same

import corpus_pipeline
from calltrail.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def test_pipeline_keeps_whole_documents_and_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, at = {r["doc_id"]: r for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        kept = out.collect()
        before = {r["doc_id"] for r in at.collect()}
        ids = [r["doc_id"] for r in kept]
        assert len(set(ids)) == len(ids) and set(ids) <= before
        assert all(rows[r["doc_id"]]["text"] == r["text"] for r in kept)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert len(ids) > 0.5 * len(before)
        at = docs.where(docs.doc_id.isin(ids))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(ids)


ODD = [(1, "un deux trois quatre cinq six", "fr", "s"), (1, "un deux trois quatre cinq six", "fr", "s"), (1, "eins zwei drei vier", "de", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "one two three four", "en", "s"), (5, "word " * 60_000, "en", "s"), (6, "un deux trois quatre cinq six", "fr", None)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(("score", "predicted", "lang_pred", "probability", "topic", "kept", "_mix", "_p", "row", "n"))})


def test_stages_on_odd_rows_and_clashing_columns(spark, odd):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        out[name] = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in got.collect())
        if name != "mixture":
            assert got.columns == odd.columns
        assert stage(spark, odd.where("false"), SF).count() == 0
    assert len(out["toxicity"]) == len(out["leaks"]) == len(ODD)
    assert (2, 0) not in out["language"] and (3, 0) not in out["language"]
    assert [i for i, _ in out["near_duplicates"]] == [0, 1, 2, 3, 5]  # 6 is a copy of 1, which stays once
    assert set(out["mixture"]) <= {(i or 0, len(t or "")) for i, t, _, _ in ODD}
