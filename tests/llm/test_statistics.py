"""Source divergence, collocations, quality: against SQL, brute force and held-out labels."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quern.llm import collocations, divergence, quality, queries, sql
from quern.llm.mphf import PerfectHash
from quern.session import table
from tests.llm import fixtures
from tests.parity import connection, duck_rows, spark_rows

SMALL = "/root/testdata/sf0.001"


def on_rows(spark, rows, query, text):
    """(operator's rows, SQL's rows) on (text, lang, source) rows."""
    schema = "text string, lang string, source string, term string, n long, v int, a long, slot string"
    held = [r + ("x", 1, 2, 3, "y") for r in rows]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return spark_rows(query(spark.createDataFrame(held, schema).repartition(3))), duck_rows(con, text)


def hard_rows():
    rows = [(t, lang, source) for _, t, lang, source, *_ in fixtures.rows()]
    rows += [("Of THE äÖ. of the: one, two; of the\tthree! of  the of the\x0b" * 6, lang, source)
             for lang, source in (("en", "s1"), ("en", "hot"), ("de", "only"), (None, None), ("", ""), ("und", "s1"))]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("123 ...", "it", "a")]
    return rows + rows[3:9]


def test_divergence_equals_sql(spark):
    for rows in (hard_rows() * 5, []):
        got, want = on_rows(spark, rows, divergence.audit, sql.DIVERGENCE)
        assert got == want


def test_divergence_without_broadcast(spark, monkeypatch):
    docs = table(spark, SMALL, "documents")
    monkeypatch.setattr(divergence, "MOST_BROADCAST", 0)
    assert spark_rows(divergence.audit(docs)) == duck_rows(connection(SMALL), sql.DIVERGENCE)


def test_term_tables_in_parts(monkeypatch):
    rows = pa.RecordBatch.from_pylist([{"text": t or "", "gid": hash((lang, source)) % 5} for t, lang, source in hard_rows()])

    def counted():
        return pd.concat([b.to_pandas() for b in divergence._counted([rows])]).groupby(["gid", "term"])[["n", "docs"]].sum()

    want = counted()
    monkeypatch.setattr(divergence, "SLICE", 7)
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 11)
    assert counted().equals(want)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        look = PerfectHash(keys)
        assert sorted(look.find(keys)) == list(range(len(keys))) and (look.keys[look.find(keys)] == keys).all()
        other = keys + np.uint64(1 << 63)
        assert (look.find(other) == -1).all()


def test_collocations_equal_sql(spark):
    for rows in (hard_rows() * 4 + [("a a a a a", "en", "x")] * 10, []):
        got, want = on_rows(spark, rows, collocations.mined, sql.COLLOCATIONS)
        assert got == want
        assert not rows or len(got[1]) > 20 and {r[got[0].index("lang")] for r in got[1]} >= {"en", "und", ""}


def test_collocations_when_rows_reach_other_tasks(spark, monkeypatch):
    """A phrase whose task is not the one that saw it first is named by a pass of its own."""
    keys = collocations._frequent_keys
    monkeypatch.setattr(collocations, "_frequent_keys", lambda *given: keys(*given).withColumn("part", F.expr("part + 1000 * pmod(g, 2)")))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert spark_rows(collocations.mined(docs)) == duck_rows(connection(SMALL), sql.COLLOCATIONS)


def test_collocations_in_several_passes(spark):
    """Three passes, each with a third of the keys, against SQL."""
    docs = table(spark, SMALL, "documents")
    assert spark_rows(collocations.mined(docs, most_keys=100)) == duck_rows(connection(SMALL), sql.COLLOCATIONS)


def test_blocks_of_slices(monkeypatch):
    """Long texts in slices have the phrases of whole ones."""
    rows = pa.RecordBatch.from_pylist([{"text": t or "", "lang": lang or "und"} for t, lang, _ in hard_rows()])

    def phrases():
        out = {}
        for block in collocations._blocks([rows]):
            for n, _, g in block.phrases(4):
                for key in g.tolist():
                    out[n, key] = out.get((n, key), 0) + 1
        return out

    want = phrases()
    monkeypatch.setattr(collocations, "SLICE", 5)
    monkeypatch.setattr(collocations, "BLOCK", 30)
    monkeypatch.setattr(collocations, "MOST_WORDS", 9)
    assert phrases() == want


def test_quality_on_held_out_rows(spark):
    found = queries.op13_quality(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").toPandas()
    out = found[found["held_out"]]
    assert len(out) > 500 and ((out["score"] >= 0.7) == (out["predicted"] == 1)).all()
    assert (out["predicted"] == out["quality"]).mean() > 0.98
    assert out[out["quality"] == 1]["predicted"].mean() > 0.99 and out[out["quality"] == 0]["predicted"].mean() < 0.08


def test_rules_as_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (3000, len(quality.STATISTICS)))
    x[:300] = x[300:600]  # ties
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.4)).astype(float)
    y[rng.uniform(size=3000) < 0.05] = 1
    model = quality.train(x, y)
    assert 0 < len(model.rules) < 60 and max(len(r) for r in model.rules) <= 3
    assert ((model.score(x) >= 0.5) == ((x[:, 3] > 0.5) & (x[:, 7] <= 0.4))).mean() > 0.98
    rows = spark.createDataFrame(pd.DataFrame(x[:200], columns=list(quality.STATISTICS)).assign(i=range(200)))
    got = rows.select("i", model.column().alias("s")).toPandas().sort_values("i")["s"].to_numpy()
    assert np.abs(got - model.score(x[:200])).max() < 1e-12


def test_lasso_is_optimal():
    """No weight could move without the penalised loss growing."""
    rng = np.random.default_rng(5)
    z = rng.uniform(size=(500, 6)) < 0.4
    y = (rng.uniform(size=500) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1)))).astype(float)
    share = np.full(6, 0.02)
    w, b = quality._lasso(z, y, share, rounds=3000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert (np.abs(slope[w == 0]) <= 0.02 + 1e-6).all() and np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-6)
    assert w[0] > 1 and (w == 0).sum() >= 2


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (3, 0)], [(1, 1), (3, 0), (None, 1), (5, None), (1, 1)]])
def test_quality_of_hard_rows(spark, labels):
    docs = fixtures.documents(spark)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.scored(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"]
    rows = got.toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    same = rows[rows["doc_id"].isin([71, 73])]  # equal texts
    assert same["score"].nunique() <= 1
    assert quality.scored(fixtures.empty(spark), model).count() == 0


def test_statistics_of_texts():
    assert not quality.statistics(None).any() and not quality.statistics(" \n").any()
    found = dict(zip(quality.STATISTICS, quality.statistics("ab ab\nAB 12.")))
    assert found["distinct_words"] == 0.75 and found["upper"] == 2 / 12 and found["digits"] == 2 / 12 and found["bare_words"] == 0.75
    assert found["ends"] == 1 and found["distinct_pairs"] == 1 and found["top_word"] == 0.5
