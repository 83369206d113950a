"""Rounds of joins against the sequential rules."""

import random

import numpy as np
from pyspark.sql import functions as F

from quern.operators import linkage, numbering


def sequential(items, links, most):
    order = sorted(items, key=lambda x: (-x[1], x[0]))
    near, seed = {}, {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for i, _, key in order:
        if i not in seed:
            seed[i] = i
            left = most - 1
            for o, _, k in order:
                if left and o not in seed and (o in near.get(i, ()) or key and k == key):
                    seed[o] = i
                    left -= 1
    return seed


def test_greedy_groups_equal_the_sequential_rule(spark):
    for turn, (n, degree, keys, most) in enumerate([(40, 1.5, 9, 4), (90, 0.2, 3, 5)]):
        rng = random.Random(turn)
        items = [(i, rng.randint(0, 5), rng.choice([None, "", *[f"k{j}" for j in range(keys)]])) for i in range(n)]
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * degree))] + [(1, 1), (0, n + 5)]
        got = linkage.greedy(spark.createDataFrame(items, "id long, frequency long, key string"), spark.createDataFrame(links, "a long, b long"), most, "key").collect()
        assert {r["id"]: r["seed"] for r in got} == sequential(items, links, most) and len(got) == n


def test_greedy_groups_hold_at_most_so_many(spark):
    """Keys without links are cut at once; the first 120 items of the other key wait for nothing either."""
    items = [(i, 1, "same") for i in range(120)] + [(i, 1, "other") for i in range(200, 330)]
    none = spark.createDataFrame([(325, 326)], "a long, b long")
    seeds = [r["seed"] for r in linkage.greedy(spark.createDataFrame(items, "id long, frequency int, key string"), none, 50, "key").collect()]
    assert sorted({s: seeds.count(s) for s in seeds}.items()) == [(0, 50), (50, 50), (100, 20), (200, 50), (250, 50), (300, 30)]


def test_greedy_groups_of_nothing(spark):
    none = spark.createDataFrame([], "id long, frequency long, key string")
    assert linkage.greedy(none, spark.createDataFrame([], "a long, b long"), key="key").count() == 0


def by_matrix(near, threshold):
    near = np.round(near, 9).copy()
    np.fill_diagonal(near, -2)
    name = list(range(len(near)))
    while True:
        i, j = divmod(int(np.argmax(near)), len(near))
        if near[i, j] < threshold:
            return name
        i, j = min(i, j), max(i, j)
        name = [i if x == j else x for x in name]
        low = np.minimum(near[i], near[j])
        near[i], near[:, i], near[i, i] = low, low, -2
        near[j], near[:, j] = -2, -2


def test_complete_linkage_equals_the_matrix_form(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 8))[rng.integers(0, 6, 60)] + 0.55 * rng.normal(size=(60, 8))
    x[50:] = x[:10]  # ties
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(x @ x.T, 2)  # more ties
    pairs = [(i, j, float(near[i, j])) for i in range(60) for j in range(i + 1, 60) if near[i, j] >= 0.6]
    ids = spark.range(60)
    got = {r["id"]: r["cluster"] for r in linkage.complete(ids, spark.createDataFrame(pairs, "a long, b long, similarity double")).collect()}
    assert got == dict(enumerate(by_matrix(near, 0.6))) and 5 < len(set(got.values())) < 60


def test_numbers_without_one_task(spark):
    rows = spark.range(5000).select("id", F.expr("if(id % 3 = 0, 'hot', concat('g', id % 40))").alias("g"), F.expr("if(id % 7 = 0, null, id * 7919 % 1000)").alias("v"))
    got = numbering.numbered(rows, [F.asc("v"), F.asc("id")], ["g"]).toPandas()
    want = rows.selectExpr("*", "row_number() over (partition by g order by v, id) as number").toPandas()
    assert got.sort_values("id").reset_index(drop=True).equals(want.sort_values("id").reset_index(drop=True).astype(got.dtypes))
    every = numbering.numbered(rows, [F.desc("v"), F.asc("id")])
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert every.agg(F.min("number"), F.max("number"), F.count_distinct("number")).first() == (1, 5000, 5000)
    assert numbering.page(every, 3, 100).count() == 100 and "Window [row_number" not in plan
    assert [r["id"] for r in numbering.following(rows, "id", 41, 3).collect()] == [42, 43, 44]


def test_groups_that_wait_for_one_another_are_settled_in_turn(spark, monkeypatch):
    """Whole tables, leading items with enough behind them, and batches that settle too little give the same groups."""
    for turn, (batch, few) in enumerate([(10**6, 0), (40, 1), (40, 20)]):
        monkeypatch.setattr(linkage, "BATCH", batch)
        monkeypatch.setattr(linkage, "FEW", few)
        rng = random.Random(turn + 20)
        items = [(i, rng.randint(0, 5), rng.choice([None, "", "a", "a", "b", "b", "c"])) for i in range(100)]
        links = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
        got = linkage.greedy(spark.createDataFrame(items, "id long, frequency long, key string"), spark.createDataFrame(links, "a long, b long"), 6, "key").collect()
        assert {r["id"]: r["seed"] for r in got} == sequential(items, links, 6)


def test_greedy_groups_of_near_titles_need_no_pair_of_items(spark, monkeypatch):
    """Classes of like titles give the groups of their pairs, in one task and dealt by component, and no pair is stored."""
    from quern.operators import grouping

    words = ["red ring", "ring RED", "red ring big", "bolt", "blue bolt big", "blue bolt", "", None]
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), rng.choice([None, "", *"abcdefgh"]) if i % 3 else None, rng.choice("xyz") if i % 11 else None, rng.choice(words)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, frequency long, key string, brand string, title string")
    pairs = [(r["a"], r["b"]) for r in grouping.pairs(df, "brand", 0.5).collect()]
    want = sequential([r[:3] for r in rows], pairs, 5)
    stored = []
    monkeypatch.setattr(linkage, "kept", lambda df, name, kept=linkage.kept: (found := kept(df, name), stored.append(found.count()))[0])
    for batch, few in ((10**6, 0), (10, 10**6), (10, 3)):
        monkeypatch.setattr(linkage, "BATCH", batch)
        monkeypatch.setattr(linkage, "FEW", few)
        items, linked = grouping.alike(df, "brand", 0.5)
        got = linkage.greedy(items, linked, 5, "key", by="class").collect()
        assert {r["id"]: r["seed"] for r in got} == want and len(got) == 240
    assert len(pairs) > 1500 and max(stored) <= 240
