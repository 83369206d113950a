"""Whole ranked lists, made in the tasks that score them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import lists
from quern.plans import registry, retrieval
from tests.parity import connection, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("held", [1 << 27, 1 << 12])
def test_lists_of_many_pairs_equal_sql_without_a_shuffle_of_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(retrieval, "PAIRS", 0)
    monkeypatch.setattr(lists, "HELD", held)
    monkeypatch.setattr(lists, "CHUNK", 64)
    monkeypatch.setattr(lists, "TILE", 1)
    monkeypatch.setattr(lists, "OUT", 7)
    found = registry.QUERIES["r10_whole_running_rank"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert spark_rows(found) == duck_rows(connection(SF), registry.SQL["r10_whole_running_rank"])
    assert "Window [" not in plan and "qid" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_word_lists_with_repeated_rows_and_long_questions(spark):
    words = [chr(0x4E00 + i) for i in range(300)]
    rows = [(i % 50, "".join(words[: (i * 7) % 290]) + " red" * (i % 3)) for i in range(120)] + [(60, ""), (61, None)]
    questions = [(1, "".join(words)), (2, "RED green"), (3, ""), (4, None)]
    d, q = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(questions, "qid long, question string")
    before = spark.createDataFrame([(2, 5)], "qid long, n long")
    got = sorted(tuple(r) for r in lists.by_words(q, d, F.col("text"), before).collect())
    tokens = lambda df, c: [(r[0], set(r[1] or ())) for r in df.select(df.columns[0], t.tokens(F.col(c))).collect()]
    held, want = tokens(d, "text"), []
    for qid, a in tokens(q, "question"):
        one = sorted((-np.floor(min(2, len(a & b) / np.sqrt(len(a) * len(b))) * 1e9 + 0.5), i) for i, b in held if a & b)
        want += [(qid, i, k + 1 + 5 * (qid == 2)) for k, (_, i) in enumerate(one)]
    assert got == sorted(want) and len(want) > 150


def test_vector_lists_put_nan_first_and_skip_what_has_no_cosine(spark):
    nan = float("nan")
    rows = [(5, "a", [1.0, 0.0]), (3, "a", [2.0, 0.0]), (4, "a", [nan, 1.0]), (1, "a", [0.0, 0.0]), (2, "a", [1.0, None]), (6, "a", [1.0]), (7, "b", [1.0, 1.0]), (8, None, [1.0, 1.0]), (9, "a", None), (0, "a", [0.0, 1.0])]
    e = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    found, n = lists.by_vector(e.where("id in (1, 5, 8)").selectExpr("id qid", "label", "vector q_vector"), e)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[2]) == [(5, 4, 1), (5, 3, 2), (5, 5, 3), (5, 0, 4)]
    assert [tuple(r) for r in n.collect()] == [(5, 4)]


def test_null_and_repeated_ids_are_ranked_as_before(spark, monkeypatch, tmp_path):
    docs = [(0, "red ring"), (50, "red bolt"), (3, "ring"), (3, "red"), (4, "blue")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for more in ([(None, [1.0, 1.0], 1)], [(50, [0.0, 1.0], 1)], [(3, [1.0, 2.0], 1)]):
        rows = [(0, [1.0, 0.0], 1), (50, [1.0, 2.0], 1), (3, [2.0, 1.0], 1), (4, [2.0, 1.0], 2), *more]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        found = []
        for pairs in (0, 10**9):
            monkeypatch.setattr(retrieval, "PAIRS", pairs)
            found.append(sorted((tuple(r) for r in registry.QUERIES["r10_whole_running_rank"](spark, str(tmp_path)).collect()), key=repr))
        assert found[0] == found[1] and len(found[0]) > 12
