import random

import pytest

from quern.operators import counted, retrieval as r
from quern.plans import registry
from pyspark.sql import functions as F


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_equal_to_joined_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(counted, "CELLS", cells)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(9)] + ["Acme", "bolt"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))) if i % 13 else None, rng.choice(["acme", "w3", "", None])) for i in range(90)]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=i % 5))) for i in range(12)]
    df, q = spark.createDataFrame(rows, "id long, text string, entity_name string").repartition(3), spark.createDataFrame(asked, "qid string, question string")
    for entity in (None, "entity_name"):
        many = r.lexical_scores(q, df, F.col("text"), entity)
        monkeypatch.setattr(r, "ASKED", 0)
        want = {tuple(x) for x in r.lexical_scores(q, df, F.col("text"), entity).select("qid", "id", F.round("lexical", 9), "same_model").collect()}
        monkeypatch.undo()
        monkeypatch.setattr(counted, "CELLS", cells)
        got = [tuple(x) for x in many.select("qid", "id", F.round("lexical", 9), "same_model").collect()]
        assert want and len(got) == len(want) and set(got) == want
        order = lambda x: (x[0], not x[3], -x[2], x[1])
        some = {tuple(x) for x in r.lexical_scores(q, df, F.col("text"), entity, 4).select("qid", "id", F.round("lexical", 9), "same_model").collect()}
        for name, _ in asked:
            best = lambda s: sorted((x for x in s if x[0] == name), key=order)[:4]
            assert some <= want and best(some) == best(want)
    every = {tuple(x) for x in r.every_term(q, df, "text").collect()}
    monkeypatch.setattr(r, "ASKED", 0)
    assert every and every == {tuple(x) for x in r.every_term(q, df, "text").collect()}


def test_no_pair_is_grouped_or_shuffled(spark):
    for name in ("r05_document_evidence", "r01_lexical_same_model_first", "fts_every_term", "r07_rrf_fusion"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "n_row" not in "".join(x for x in plan.splitlines() if "HashAggregate" in x)


def test_merge_of_lists_counts_pairs_in_tasks(spark):
    """Word scores of r16_whole_vector_merge: no pair of a question and a document is grouped, and a task passes on 40 of a question."""
    plan = registry.QUERIES["r16_whole_vector_merge"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "n_row" not in "".join(x for x in plan.splitlines() if "HashAggregate" in x)
    rows = spark.range(400).selectExpr("id", "'bolt nut' AS text").repartition(3)
    asked = spark.createDataFrame([(0, "bolt"), (1, "nut bolt")], "qid long, question string")
    assert r.lexical_scores(asked, rows, F.col("text"), None, 40).count() == 3 * 2 * 40


def test_rank_value_is_rounded_as_in_sql(spark, tmp_path):
    """41 of 640 words are 0.0640625, whose double times a million lies below the half."""
    import duckdb

    from tests.parity import duck_rows, spark_rows

    texts = [(i, " ".join(["bolt"] * hits + ["nut"] * (640 - hits)), "s") for i, hits in enumerate(range(1, 641, 2))]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "one bolt bolt")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = spark_rows(registry.QUERIES["fts_every_term"](spark, str(tmp_path)))
    assert len(got[1]) == 320 and got == duck_rows(con, registry.SQL["fts_every_term"])
