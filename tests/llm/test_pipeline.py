from collections import Counter

import corpus_pipeline
from quern.llm import queries
from tests.llm.fixtures import documents, rows

SF = "/root/testdata/sf0.001"


def test_stages_on_hard_rows(spark, tmp_path):
    docs = documents(spark)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name == "language_id":
            kept = docs.select("doc_id", "text").collect()
            want = [r for r in rows() if any(c.isalpha() for c in r[1] or "")]
            assert Counter(tuple(r) for r in kept) == Counter((r[0], r[1]) for r in want)
    assert counts[0] > counts[1] == counts[2]


def test_empty_pipeline(spark, tmp_path):
    from tests.llm.fixtures import empty

    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0


def test_every_query_returns_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    for name, query in queries.QUERIES.items():
        n = query(spark, SF).count()
        assert n == (vectors if name.startswith("op1_") else docs) or (name.startswith("op5_") and n >= docs), name


def test_entry_lists_eleven_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
