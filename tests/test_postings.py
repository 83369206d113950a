"""A stored index against plain sums."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import postings


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_hits_are_added_up_in_the_tasks(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(postings, "CELLS", cells)
    rng = random.Random(3)
    rows = [(i, rng.sample([f"w{j}" for j in range(30)], rng.randint(0, 12))) for i in range(400)]
    asked = [(q, w, 1.0 + (q == 2), 4) for q in range(6) for w in rng.sample([f"w{j}" for j in range(33)], 4)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    index = postings.build(postings.lexical_rows(df, F.col("t"), F.lit(None).cast("string")), f"file://{tmp_path}/index", segment_rows=16, buckets=4)
    q = spark.createDataFrame(asked, "qid int, token string, boost double, n int")
    got = index.best(q, 5, key=postings.lexical_key)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "explode(postings" not in plan
    best, found = {}, {}
    for r in got.collect():
        found.setdefault(r["qid"], []).append((-round(r["score"] / 2, 9), r["id"], r["held"]))
    for i in range(6):
        boost = {w: b for x, w, b, _ in asked if x == i}
        sums = [(-round(sum(boost[w] for w in t if w in boost) / len(t) ** 0.5 / 2, 9), x, sum(w in boost for w in t)) for x, t in rows if set(t) & set(boost)]
        best[i] = sorted(sums)[:5]
    assert {i: sorted(x)[:5] for i, x in found.items()} == best
