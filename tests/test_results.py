"""Documents, snapshots, file differences, claims and scopes, on rows written by hand."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_traces import event, frame

from calltrail import tables
from calltrail.operators import claims, scopes
from calltrail.sources import documents, snapshots, traces


def test_documents_are_read_with_tolerance(spark, tmp_path):
    rows = [{"id": 7, "name": "x", "flag": True, "tags": ["a", "b"], "n": 3}, {"id": "8", "name": 5, "flag": "true", "tags": "a", "n": "3"}, {"id": 1.5, "n": 2.5, "tags": [1]}, {"id": None}, {"id": "x"}]
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"schema": "things/1", "things": rows, "other": {"a": 1}}))
    found = documents.section(documents.read_document(spark, str(path), "things/1"), "things")
    got = found.orderBy("place").select(documents.id_of("row", "id"), documents.string_of("row", "name", "?"), documents.bool_of("row", "flag"), documents.strings_of("row", "tags"), documents.long_of("row", "n", 0)).collect()
    assert [tuple(r) for r in got] == [(7, "x", True, ["a", "b"], 3), (8, "?", False, [], 0), (None, "?", False, [], 0), (None, "?", False, [], 0), (None, "?", False, [], 0)]
    for name in ("other", "nothing"):
        assert documents.section(documents.read_document(spark, str(path), "things/1"), name).count() == 0
    for other, schema in ((str(path), "things/2"), (str(tmp_path / "none.json"), "things/1")):
        with pytest.raises(traces.InputError):
            documents.read_document(spark, other, schema)
    path.write_text("[1, 2")
    with pytest.raises(traces.InputError):
        documents.read_document(spark, str(path), "things/1")


def test_a_document_is_one_file_of_many_parts(spark, tmp_path):
    many = spark.range(500).select(F.col("id"), F.concat(F.lit('t"\n'), "id").alias("text"), F.when(F.col("id") % 2 == 0, 1.5).alias("half"))
    path = str(tmp_path / "many.json")
    documents.write_document({"many": many, "none": many.where("false"), "one": spark.createDataFrame([(1,)], "a int")}, "many/1", path)
    doc = json.loads((tmp_path / "many.json").read_text())
    assert list(doc) == ["schema", "many", "none", "one"] and doc["none"] == [] and doc["one"] == [{"a": 1}]
    assert sorted(r["id"] for r in doc["many"]) == list(range(500)) and all(("half" in r) == (r["id"] % 2 == 0) for r in doc["many"])
    back = documents.section(documents.read_document(spark, path, "many/1"), "many").select(documents.long_of("row", "id").alias("id"), documents.string_of("row", "text").alias("text"))
    assert back.exceptAll(many.select("id", "text")).isEmpty() and back.count() == 500


def test_snapshots_are_committed_whole(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "kept"), retention_seconds=3600)
    key = store.key_of(target="abc", language="java")
    e = frame(spark, [event("base1"), event("base2")])
    assert store.find(key) is None
    folder = store.store(key, e, ["base1", "base2"])
    assert store.find(key, ["base1"]).count() == 2 and store.find(store.key_of(target="abd", language="java")) is None and store.find(key, ["base3"]) is None
    with pytest.raises(traces.InputError):  # an incomplete one changes nothing
        store.store(key, e, ["base1", "base9"])
    assert store.find(key).count() == 2
    # a torn write: only a staging folder is there
    e.write.partitionBy("run").parquet(f"{folder}.tmp-torn")
    assert store.find(key).count() == 2 and store.prune() == 0
    assert snapshots.Snapshots(spark, str(tmp_path / "kept"), lock_seconds=0).prune() == 1
    store.store(key, frame(spark, [event("base1")]), ["base1"])  # replaces
    assert store.find(key).count() == 1
    assert snapshots.Snapshots(spark, str(tmp_path / "kept"), retention_seconds=0).find(key) is None
    assert snapshots.Snapshots(spark, str(tmp_path / "kept"), retention_seconds=0).prune() == 1 and store.find(key) is None


def test_of_two_writers_one_wins(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "kept"))
    e, ends = frame(spark, [event("base1")]), []

    def write():
        try:
            ends.append(store.store("k", e, ["base1"]))
        except snapshots.Busy:
            ends.append(None)

    threads = [threading.Thread(target=write) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(x is not None for x in ends) >= 1 and store.find("k").count() == 1
    assert not [p for p in tables.children(spark, str(tmp_path / "kept")) if ".tmp-" in p or p.endswith(".lock")]
    lock = f"{store._folder('k')}.lock"
    assert tables.create_new(spark, lock) and not tables.create_new(spark, lock)
    with pytest.raises(snapshots.Busy):
        store.store("k", e, ["base1"])
    time.sleep(0.01)
    assert snapshots.Snapshots(spark, str(tmp_path / "kept"), lock_seconds=0).store("k", e, ["base1"])


def test_files_that_differ(spark, tmp_path):
    def put(side, name, text):
        f = tmp_path / side / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    for name, a, b in (("same.cs", "1", "1"), ("changed.cs", "1", "2"), ("sub/gone.cs", "1", None), ("sub/new.cs", None, "1"), ("bin/skip.cs", "1", "2"), ("x/obj/skip.cs", "1", None), ("other.txt", "1", "2"), ("empty.cs", "", "")):
        for side, text in (("a", a), ("b", b)):
            if text is not None:
                put(side, name, text)
    for a, b in ((str(tmp_path / "a"), str(tmp_path / "b")), ((tmp_path / "a").as_uri(), f"{tmp_path}/b/")):
        assert sorted(r[0] for r in traces.changed_between(spark, a, b, "*.cs").collect()) == ["changed.cs", "sub/gone.cs"]


def test_scopes_collapse_to_those_that_cover(spark):
    names = ["a.b", "a.b.c", "a.bc", "x", "x.y.z", "q.r.s", "q.r.s", "", None, "q.r.s.t.u"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert sorted(r[0] for r in scopes.collapsed(df).collect()) == ["a.b", "a.bc", "q.r.s", "x"]
    assert {r["name"]: r["covers"] for r in scopes.covering(df).collect()} == {"a.b": "a.b", "a.b.c": "a.b", "a.bc": "a.bc", "x": "x", "x.y.z": "x", "q.r.s": "q.r.s", "q.r.s.t.u": "q.r.s"}


def test_text_rules(spark):
    df = spark.createDataFrame([("One. Two! Three? v1.2 end",), ("<a href='x'>@me & \"é\"\r\n\U0001f600",)], "t string")
    got = df.select(claims.sentence_count(F.col("t")), claims.sanitized(F.col("t"))).collect()
    assert got[0][0] == 3 and got[1][1] == "&lt;a href=&#39;x&#39;&gt;(at)me &amp; &quot;&#233;&quot;  &#128512;"


def test_corpus_and_claims(spark):
    members = spark.createDataFrame([("A.b()", "src/a.cs", 3, "1 test executed this; none asserted on the changed value."), ("A.c()", None, None, "x")], "method string, file_path string, line int, assertion_reaction string")
    shown = "test_id string, method string, ordinal int, kind string, detail string, base_args string, pr_args string, base_return string, pr_return string, base_exception string, pr_exception string, pr_path array<struct<member:string>>"
    ev = spark.createDataFrame([(f"T{i}", "A.b()", i, "DigestDiff", "returnDigest", "n=1", "n=1", "Primitive:41", 'Primitive:"forty two"' if i else "Primitive:42.5", None, None, [("R.t()",), ("A.b()",)]) for i in range(5)] + [("T9", "A.c()", 0, "DigestDiff", "x", None, None, "Primitive:-", "List(1)[]", None, None, None)], shown)
    effects = spark.createDataFrame([("A.b()", "T0", "A.top()", "Primitive:7", "Primitive:8", None, None)], "member string, test_id string, consequence string, base_return string, pr_return string, base_exception string, pr_exception string")
    related = spark.createDataFrame([("A.b()", "A.c()")], "method string, related string")
    patches = spark.createDataFrame([("src/a.cs", t) for t in ("+++ b/src/a.cs", "+new\r", "-old", " same", "@@ -1 +1 @@")], "file_path string, text string")
    known = claims.corpus(members, ev, effects, related, patches)
    by = {}
    for r in known.collect():
        by.setdefault((r["member"], r["kind"]), []).append(r["citation"])
    assert sorted(by["A.b()", "DIFF"]) == ["DIFF: src/a.cs: +new", "DIFF: src/a.cs: -old"]
    assert len(by["A.b()", "OBSERVATION"]) == 3 and by["A.b()", "CALL_PATH"] == ["CALL_PATH: R.t() -> A.b()"]
    assert by["A.c()", "SOURCE"] == ["SOURCE: unresolved:unresolved"] and by["A.b()", "RELATED"][0].startswith("RELATED: member=A.c(); test=T9")
    obs, diff, after, rel = (by["A.b()", k][0] for k in ("OBSERVATION", "DIFF", "CONSEQUENCE", "RELATED"))
    values = claims.outcome_values(ev, effects)
    assert {(r["member"], r["value"]) for r in values.collect()} == {("A.b()", "41"), ("A.b()", "42.5"), ("A.b()", "7"), ("A.b()", "8"), ("A.c()", "-")}
    rows = [
        (1, "A.b()", "The rate is read anew. It is added once.", [obs, diff, after, rel], "t", [obs]), (2, "A.b()", "It is 41a and 142 and 42.51.", [obs, diff, after, rel], "t", [obs]),
        (3, "A.b()", "Now 42.5 it RETURNS.", [obs, diff, after, rel], "t", [obs]), (4, "A.b()", "One. Two. Three.", [diff, "DIFF: invented"], "t", None),
        (5, "A.c()", "a - b", by["A.c()", "OBSERVATION"] + ["DIFF: none"], "t", by["A.c()", "OBSERVATION"]),
    ]
    got = {r["claim_id"]: r["problems"] for r in claims.judged(spark.createDataFrame(rows, "claim_id int, member string, why string, why_citations array<string>, test string, test_citations array<string>"), known, values).collect()}
    assert got == {
        1: [], 2: [], 3: ["why restates 42.5", "why tells an outcome"],
        4: ["cites what is not in the corpus: DIFF: invented", "test cites no OBSERVATION", "why cites no CONSEQUENCE", "why cites no OBSERVATION", "why cites no RELATED", "why has more than two sentences"],
        5: ["cites what is not in the corpus: DIFF: none", "why restates -"],
    }
