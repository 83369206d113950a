"""Versions, upserts, replies, claims and drained streams: golden cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.functions import claims
from quern.operators import postings
from quern.sources import files
from quern.streaming import queue

FILES = "key string, label string, content binary, seq int"


def decisions(df):
    return sorted((r["key"], r["label"], r["decision"]) for r in df.collect())


def test_a_batch_clashes_with_itself(spark):
    f = spark.createDataFrame([("a", "1", b"x", 1), ("a", "1", b"y", 2), ("a", "1", b"x", 3), ("b", "1", b"x", 4), (None, "1", b"z", 5), (None, "1", b"w", 6)], FILES)
    known = spark.createDataFrame([("b", "1", "other")], "key string, label string, hash string")
    got = sorted((r["key"] or "", r["decision"]) for r in files.intake(f, known, [F.asc("seq")]).collect())
    assert got == [("", "conflict"), ("", "created"), ("a", "conflict"), ("a", "created"), ("a", "duplicate"), ("b", "conflict")]


def test_versions_are_visible_once_committed(spark, tmp_path, monkeypatch):
    store = files.Versions(spark, f"file://{tmp_path}/store")
    assert store.table().count() == 0
    first = spark.createDataFrame([("a", "1", b"x", 1), ("a", "1", b"y", 2), ("b", "1", b"z", 3)], FILES)
    assert [d for *_, d in decisions(store.admit(first, [F.asc("seq")]))] == ["conflict", "created", "created"]
    monkeypatch.setattr(files.Versions, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.admit(spark.createDataFrame([("c", "1", b"x", 1)], FILES))
    monkeypatch.undo()
    assert {r["key"] for r in store.table().collect()} == {"a", "b"}
    assert not store._commit(0, "late")  # the number is taken
    again = store.admit(spark.createDataFrame([("a", "1", b"x", 1), ("c", "1", b"q", 2), ("b", "1", b"x", 3)], FILES))
    assert decisions(again) == [("a", "1", "duplicate"), ("b", "1", "conflict"), ("c", "1", "created")]
    assert sorted((r["key"], bytes(r["content"])) for r in store.table().collect()) == [("a", b"x"), ("b", b"z"), ("c", b"q")]


def test_upsert_keeps_the_last_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "x", 2), (1, "z", 1), (3, "c", 1), (None, "m", 1)], "k int, v string, at int")
    got = sorted(((r["k"] or 0), r["v"]) for r in files.upsert(old, new, "k", ["at"]).collect())
    assert got == [(0, "m"), (0, "n"), (1, "x"), (2, "b"), (3, "c")]


def test_last_json_of_a_reply(spark):
    cases = {
        '{"a": {"b": 1}}': '{"a": {"b": 1}}', ' [1, {"a": 2}] ': '[1, {"a": 2}]', "I will comply. {\"ok\": true}": '{"ok": true}',
        'so {"s": "a } b {"} done': '{"s": "a } b {"}', 'x [1, 2] y [3] z': "[3]", '{"a": 1} {broken': '{"a": 1}', "nothing [": None, "": None, None: None,
        'say {"q": "\\"{\\""}!': '{"q": "\\"{\\""}', "[" * 3000: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r["j"] for r in df.select("i", files.last_json("t").alias("j")).orderBy("i").collect()] == list(cases.values())


def test_a_drained_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long"
    rows = lambda n, start=0: spark.createDataFrame([(start + i, dt.datetime(2024, 1, 1), i % 2) for i in range(n)], schema).coalesce(1)
    rows(4).write.parquet(f"{tmp_path}/events.parquet")

    def drained(mode, name):
        stream = queue.event_stream(spark, str(tmp_path))
        stream = stream.groupBy("user_id").count() if mode == "complete" else stream.select("event_id")
        return sorted(tuple(r) for r in queue.drained(stream, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-check", mode).collect())

    assert drained("append", "a") == [(0,), (1,), (2,), (3,)] and drained("complete", "c") == [(0, 2), (1, 2)]
    assert drained("append", "a") == [(0,), (1,), (2,), (3,)] and drained("complete", "c") == [(0, 2), (1, 2)]  # nothing new
    rows(2, 4).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert drained("append", "a") == [(i,) for i in range(6)] and drained("complete", "c") == [(0, 3), (1, 3)]


def test_least_claims(spark):
    cases = [("", 0), (None, 0), ("  \n ", 0), ("one fact", 1), ("a: 1; b: 2; c: 3", 3), ("x；y；z", 3), ("行吗？好。是！", 3), ("l1\nl2\n\nl3", 3), ("no labels here; and one", 2), ("Why? Because!", 2)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r["n"] for r in df.select("i", claims.least_claims(F.col("t")).alias("n")).orderBy("i").collect()] == [n for _, n in cases]
    marks = spark.createDataFrame([("Ports, fans ETC.", False), ("кроме X1", False), ("plain", True), ("plain", None)], "t string, d boolean")
    assert [tuple(r) for r in marks.select(claims.open_list(F.col("t")), claims.needs_individual(F.col("t"), F.col("d"))).collect()] == [(True, False), (False, True), (False, True), (False, False)]


def test_extraction_coverage(spark):
    src, facts = "a: 1; b: 2", ["a: 1", "b: 2"]
    good = [("a: 1", [0], None), ("b: 2", [1], "knowledge")]
    cases = [
        (src, facts, True, [], good, None), (src, facts, False, [], good, "incomplete"), (src, facts, None, [], good, "incomplete"),
        (src, facts, True, ["b"], good, "uncovered"), (src, facts, True, None, good, "uncovered"), (src, facts, True, [], good[:1], "too_few_claims"),
        (src, ["a: 1", "c"], True, [], good, "excerpt_not_in_source"), (src, ["a: 1", " "], True, [], good, "excerpt_not_in_source"),
        (src, facts, True, [], [good[0], ("zz", [1], None)], "claim_not_in_source"), (src, facts, True, [], [good[0], ("b: 2", [], None)], "no_units"),
        (src, facts, True, [], [good[0], ("b: 2", [2], None)], "unknown_unit"), (src, facts, True, [], [good[0], ("b: 2", [0], None)], "claim_outside_units"),
        (src, facts, True, [], [good[0], ("a", [0], None)], "unnamed_unit"), (src, facts[:1], True, [], [good[0], ("b: 2", [], " Marketing ")], None),
        ("hello", [], True, [], [("hello", [], "context")], None),
    ]
    schema = "i int, s string, e array<string>, c boolean, u array<string>, m array<struct<text:string,units:array<int>,disposition:string>>, want string"
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], schema)
    got = df.select("i", "want", claims.coverage_error(F.col("s"), F.col("e"), F.col("c"), F.col("u"), F.col("m")).alias("got")).orderBy("i").collect()
    assert [(r["i"], r["got"]) for r in got] == [(r["i"], r["want"]) for r in got]


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path):
    """Rows about forty subjects: the best rows of a question are found in few segments, and no other row is better."""
    rows = spark.range(8000).selectExpr("id", "concat('t', id % 40) as subject", "id % 40 as s").selectExpr(
        "id", "subject", "transform(sequence(1, 6 + cast(pmod(xxhash64(id), 30) as int)), i -> concat('w', s * 50 + pmod(xxhash64(id, i), 60))) as t")
    index = postings.build(postings.lexical_rows(rows, F.col("t"), F.col("subject")), f"file://{tmp_path}/index", segment_rows=64, buckets=4)
    asked = spark.createDataFrame([(q, f"w{q * 90 + k * 5}", 1.0, 5) for q in range(10) for k in range(5)], "qid int, token string, boost double, n int")
    every = {}
    for r in index.scores(asked, index.bounds(asked)).collect():
        every.setdefault(r["qid"], []).append(round(r["score"], 9))
    best = {}
    for r in index.best(asked, 3).collect():
        best.setdefault(r["qid"], []).append(round(r["score"], 9))
    assert len(every) == 10 and {q: sorted(x)[-3:] for q, x in every.items()} == {q: sorted(x)[-3:] for q, x in best.items()}
    assert index.plan(asked, 3).count() < 0.8 * index.bounds(asked).count()
    plan = index.bounds(asked.where("qid = 0 and token = 'w5'"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "postings" not in plan
