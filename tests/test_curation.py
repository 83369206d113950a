"""Curation: golden cases of keys, similarity, limits, new units, splits, merges, bundles."""

import hashlib
import json

from pyspark.sql import functions as F

from quern.operators import curation as c


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_prompt_hash_is_of_canonical_json(spark):
    said = [[("Что это? \"q\" / \\ \n ü", "user"), ("", "assistant"), (None, "system")], []]
    got = [r[0] for r in spark.createDataFrame([(i, m) for i, m in enumerate(said)], "id int, m array<struct<content:string,role:string>>").orderBy("id").select(c.prompt_hash(F.col("m"))).collect()]
    for m, h in zip(said, got):
        text = json.dumps([{"role": role, "content": content} for content, role in m], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert h == hashlib.sha256(text.encode()).hexdigest()


def test_content_keys(spark):
    got = spark.createDataFrame([("ä",), (None,)], "t string").select(c.content_key(F.col("t")), c.content_key(F.col("t"), F.lit("m"))).collect()
    assert [tuple(r) for r in got] == [tuple(hashlib.sha256(x.encode()).hexdigest() for x in pair) for pair in (("ä", "mä"), ("", "m"))]


def test_similarity_falls_back_to_tokens(spark):
    held = [(0, [1.0, 0.0], [0.6, 0.8], ["a"], ["b"]), (1, None, [0.6, 0.8], ["a", "b"], ["b", "c"]), (2, [], [], [], ["b"]), (3, None, None, ["x"], [])]
    df = spark.createDataFrame(held, "id int, x array<double>, y array<double>, t array<string>, u array<string>").orderBy("id")
    got = [r[0] for r in df.select(c.similarity(F.col("x"), F.col("y"), F.col("t"), F.col("u"))).collect()]
    assert [round(x, 9) for x in got] == [0.6, round(1 / 3, 9), 0.0, 0.0]


def test_fields_over_their_limit(spark):
    df = spark.createDataFrame([("abcd", "ab"), ("abc", None), ("abcd", "abcd")], "a string, b string")
    assert [r[0] for r in df.select(c.over_limit({"b": 3, "a": 3})).collect()] == [["a"], [], ["b", "a"]]


def test_new_units_against_live_proposals(spark):
    units = spark.createDataFrame([(1, 0, "T", "One  fact"), (1, 1, "t", "one fact"), (1, 2, "T", "Two"), (1, 3, "T", "Three"), (2, 0, "T", "Two"), (2, 1, None, None)],
                                  "version_id int, position int, title string, content string")
    stored = spark.createDataFrame([(1, "confirmed", "T", "TWO"), (1, "rejected", "T", "Three"), (1, "confirmed", "T", "One")], "version_id int, status string, title string, content string")
    assert rows(c.new_units(units, stored).select("version_id", "position")) == [(1, 0), (1, 3), (2, 0), (2, 1)]
    assert rows(c.new_units(units.limit(0), stored)) == []


def test_split_moves_cases_and_numbers_both_sides(spark):
    cases = spark.createDataFrame([("A", 10, 0), ("A", 7, 1), ("A", 9, 2), ("A", 8, 3), ("A-S1", 1, 0), ("A-S3", 2, 0), ("B", 5, 4), ("C", 3, 0)], "candidate_id string, case_id long, case_position int")
    asked = spark.createDataFrame([("A", [9, 10, 9]), ("B", [5]), ("C", [4]), ("D", [1]), ("A-S1", None)], "candidate_id string, case_ids array<long>")
    checked, after = c.split(cases, asked)
    assert rows(checked) == [("A", "ok", "A-S2", 2), ("A-S1", "nothing_selected", None, 0), ("B", "nothing_left", None, 0), ("C", "not_attached", None, 0), ("D", "unknown_candidate", None, 0)]
    assert sorted(tuple(r) for r in after.collect()) == [("A", 7, 0), ("A", 8, 1), ("A-S1", 1, 0), ("A-S2", 9, 0), ("A-S2", 10, 1), ("A-S3", 2, 0), ("B", 5, 4), ("C", 3, 0)]
    assert rows(c.split(cases, asked.limit(0))[1]) == rows(cases)


def test_merge_checks_the_target_and_archives(spark):
    candidates = spark.createDataFrame([(x, "approved", None) for x in "ABCDEF"], "candidate_id string, status string, duplicate_of string")
    knowledge = spark.createDataFrame([("A", 1, "published", False), ("A", 2, "published", True), ("B", 1, "published", True), ("B", 2, "draft", False), ("C", 1, "draft", False), ("D", 1, "published", False)],
                                      "candidate_id string, version_no int, status string, allowed boolean")
    asked = spark.createDataFrame([("B", "A"), ("A", "A"), ("C", "D"), ("D", "C"), ("E", None), ("Z", "A"), ("F", "A")], "candidate_id string, target_id string")
    checked, after, published = c.merge(candidates, knowledge, asked)
    assert rows(checked) == [("A", "A", 2, "into_itself"), ("B", "A", 2, "ok"), ("C", "D", 1, "not_allowed"), ("D", "C", None, "not_published"), ("E", None, None, "no_target"), ("F", "A", 2, "ok"), ("Z", "A", 2, "unknown_candidate")]
    assert rows(after.where("status = 'merged'")) == [("B", "merged", "A"), ("F", "merged", "A")]
    assert rows(published.where("candidate_id = 'B'")) == [("B", 1, "archived", False), ("B", 2, "draft", False)]
    assert rows(published.where("candidate_id <> 'B'")) == rows(knowledge.where("candidate_id <> 'B'"))


def test_bundles_hold_all_of_a_candidate(spark):
    make = spark.createDataFrame
    bundle = c.bundles(
        make([(1,), (2,), (None,)], "candidate_id int"), make([(1, 20, 0), (1, 10, 1)], "candidate_id int, case_id int, case_position int"),
        make([(10, 0, "u", "q"), (10, 1, "e", None), (30, 0, "u", "x")], "case_id int, message_index int, author string, text string"),
        make([(1, 10, 0, "question")], "candidate_id int, case_id int, message_index int, role string"), make([(10, 1, 0, "answers")], "case_id int, source int, target int, relation string"),
        make([(1, 5, 7, 1), (1, 6, 7, 9)], "candidate_id int, evidence_id int, doc_id int, block_no int"), make([(7, 0, "a"), (7, 1, "b"), (7, 4, "c")], "doc_id int, block_no int, text string"),
        make([(1, i, i, "edit") for i in range(5)], "candidate_id int, event_id int, created_at int, event_type string"), most_events=2)
    first, second = bundle.orderBy("candidate_id").collect()
    assert [(x.case_id, [tuple(m) for m in x.messages], [tuple(r) for r in x.relations]) for x in first.cases] == [
        (20, [], []), (10, [(0, "u", "q", "question"), (1, "e", None, "unconfirmed_claim")], [(1, 0, "answers")])]
    assert [tuple(e) for e in first.evidence] == [(5, 7, 1, "b", "a", "c"), (6, 7, 9, None, None, None)]
    assert [e.event_id for e in first.events] == [4, 3]
    assert tuple(second) == (2, [], [], [])
