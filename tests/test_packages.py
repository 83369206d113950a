"""Packages of cases: golden cases of selection, payloads, forced keys, failures, evidence."""

from pyspark.sql import functions as F

from quern.operators import packages as p

RULES = {"A": p.Package("Reset", "access.reset", prefix="access.reset", kind="support_process"), "B": p.Package("Firmware", "fw.find", keys=("fw.find", "fw.get")),
         "E": p.Package("Tracking", "feature.track", words=("tracking", "слежение"))}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_selection(spark):
    items = spark.createDataFrame([(3, "access.reset.nvr", "x"), (1, "access.reset", "Tracking?"), (2, "fw.get", "Слежение"), (4, "fw.latest", None), (5, None, None), (3, "access.reset.nvr", "x")],
                                  "case_id int, knowledge_key string, question string")
    assert rows(p.selected(items, RULES)) == [(1, "A", 0), (1, "E", 0), (2, "B", 0), (2, "E", 1), (3, "A", 1)]
    assert rows(p.selected(items.limit(0), RULES)) == []


def test_thread_payloads(spark):
    cases = spark.createDataFrame([(1, "ann", "q1"), (2, None, "q2"), (3, "bob", "q3"), (4, None, None)], "case_id int, root_author string, root_question string")
    messages = spark.createDataFrame([(1, 1, "bob", None, None, "p.jpg"), (1, 0, "ann", "hi", "f.txt", "p.jpg"), (2, 0, None, "a", None, None), (2, 1, None, "b", "", None)],
                                     "case_id int, message_index int, author string, text string, file string, photo string")
    got = {r.case_id: [tuple(m) for m in r.messages] for r in p.thread_payloads(cases, messages).collect()}
    assert got == {1: [(0, "user", "hi", ["file", "photo"]), (1, "engineer", "", ["photo"])], 2: [(0, "user", "a", []), (1, "engineer", "b", [])], 3: [(0, "user", "q3", [])], 4: []}


def test_forced_keys(spark):
    df = spark.createDataFrame([("A", "x"), ("B", "fw.get"), ("B", "x"), ("E", None), ("Z", "kept"), ("B", None)], "package string, k string")
    assert [r[0] for r in df.select(p.forced_key(F.col("package"), F.col("k"), RULES)).collect()] == ["access.reset", "fw.get", "fw.find", "feature.track", "kept", "fw.find"]


def test_failed_packages_have_a_row(spark):
    drafts = spark.createDataFrame([("A", "k", "t", "other", [1], "high", "n"), ("B", "k", "t", "other", [2], "high", "n")],
                                   "package string, knowledge_key string, title string, kind string, case_ids array<int>, confidence string, note string")
    cases = spark.createDataFrame([("A", 3), ("A", 1), ("B", 2)], "package string, case_id int")
    failures = spark.createDataFrame([("A", "timeout"), ("E", "bad json")], "package string, failure string")
    assert rows(p.with_failed(drafts, cases, failures, RULES)) == [
        ("A", "access.reset", "Reset — engineer review required", "support_process", [1, 3], "low", "needs_engineer: timeout"), ("B", "k", "t", "other", [2], "high", "n"),
        ("E", "feature.track", "Tracking — engineer review required", "other", [], "low", "needs_engineer: bad json")]


def test_cited_evidence_once_each(spark):
    cited = spark.createDataFrame([("A", 0, None, 7, ["1", "x"], None), ("A", 1, "d1", None, None, None), ("A", 2, "d1", 7, ["5"], "r"), ("A", 3, "nope", 9, None, None), ("A", 4, "nope", 7, ["1"], None)],
                                  "package string, position int, evidence_id string, case_id int, message_indexes array<string>, role string")
    got = p.cited_evidence(cited, spark.createDataFrame([("d1", "official_document")], "evidence_id string, source_type string"), spark.createDataFrame([("A", 7)], "package string, case_id int")).collect()
    assert [tuple(e) for e in got[0].evidence] == [("telegram", None, 7, [1], "unconfirmed_claim"), ("official_document", "d1", None, None, None)]
