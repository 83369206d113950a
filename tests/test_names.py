"""Names in long texts against plain search."""

import random

import pytest

from quern.operators import names


def places(text, name):
    text, name = text.lower(), name.lower()
    return sum(text.startswith(name, i) for i in range(len(text)))


def test_names_against_plain_search(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAбВ界 ") for _ in range(n)) for n in (1, 2, 5, 40, 300, 999, 1000, 1001, 2600)] + ["", "a" * 1500]
    wanted = {t[i: i + n] for t in texts for n in (1, 2, 3, 4, 7, 8, 9, 15, 16, 31, 40) for i in (0, 3, len(t) - n, 990) if 0 <= i <= len(t) - n} | {"zz", "aaaa", "abab\n"}
    got = names.found(spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "k int, t string"), "k", "t",
                      spark.createDataFrame([(n,) for n in sorted(wanted)] + [("",), (None,)], "name string"), "name")
    want = {(i, n, c) for i, t in enumerate(texts) for n in wanted if n and (c := places(t, n))}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 200
    nothing = names.found(spark.createDataFrame([(1, "abc")], "k int, t string"), "k", "t", spark.createDataFrame([], "name string"), "name")
    assert nothing.count() == 0


def test_a_hundred_thousand_names_with_one_beginning(spark):
    """Names differ in their last characters only; anchors must be there, or each place would meet all names."""
    wanted = spark.range(100_000).selectExpr("concat('Model Number ', lpad(id, 5, '0')) AS name")
    n = names.anchored(wanted, "name").groupBy("run").count().agg({"count": "max"}).first()[0]
    assert n <= 1000
    text = " ".join(f"word{i} model number {i * 7 % 100_000:05d}" for i in range(5000))
    got = names.found(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", wanted, "name")
    assert {(r["name"], r["places"]) for r in got.collect()} == {(f"Model Number {i * 7 % 100_000:05d}", 1) for i in range(5000)}
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("characters", [7, 64, 1 << 18])
def test_few_names_are_found_where_texts_are_read(spark, monkeypatch, characters):
    """Texts lie one behind the other in a task; no name goes over their borders or is lost at a piece's."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abé界 ") for _ in range(rng.choice([0, 1, 3, 9, 90]))) for _ in range(60)]
    wanted = sorted({t[i: i + n] for t in texts for n in (1, 2, 3, 5, 8, 20) for i in (0, 4) if len(t) >= i + n})
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "k long, t string").repartition(2)
    n = spark.createDataFrame([(x.upper(),) for x in wanted], "name string")
    monkeypatch.setattr(names, "CHARACTERS", characters)
    got = names.found(df, "k", "t", n, "name")
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in enumerate(texts):
        for x in wanted:
            if c := places(t, x):
                want[i % 50, x.upper()] = want.get((i % 50, x.upper()), 0) + c
    assert {(r["k"], r["name"]): r["places"] for r in got.collect()} == want
    monkeypatch.setattr(names, "FEW", 0)
    assert {(r["k"], r["name"]): r["places"] for r in names.found(df, "k", "t", n, "name").collect()} == want
