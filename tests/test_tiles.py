import numpy as np

from quern.operators import pivots, tiles
from quern.plans import registry

SHAPE = "id long, label string, vector array<double>"


def rows_of(spark, n=70):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (n, 4)).astype(float)
    rows = [(i, "ab"[i % 2], x[i].tolist()) for i in range(n)] + [(n, None, [1.0] * 4), (n + 1, "a", None), (n + 2, "a", [1.0, None, 0.0, 0.0]), (n + 3, "a", [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, SHAPE)


def cosine(x, y):
    if x is None or y is None or len(x) != len(y) or None in (*x, *y) or not any(x) or not any(y):
        return None
    return float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))


def test_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 7)
    monkeypatch.setattr(tiles, "ROWS", 3)
    rows, df = rows_of(spark)
    queries = df.where("id % 5 = 0").selectExpr("id qid", "label", "vector q_vector")
    want = {(a, b): c for a, l, x in rows if a % 5 == 0 for b, m, y in rows if l is not None and l == m and (c := cosine(x, y)) is not None}
    got = {(r[0], r[1]): r[2] for r in tiles.cosines(queries, df).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    near = {(r[0], r[1]) for r in tiles.cosines(queries, df, threshold=0.6).collect()}
    assert near == {(a, b) for (a, b), c in want.items() if b > a and c >= 0.6}
    for q in {a for a, _ in want}:
        ranked = sorted((-round(c, 9), b) for (a, b), c in want.items() if a == q)[:3]
        found = [(-round(r[2], 9), r[1]) for r in tiles.cosines(queries.where(f"qid = {q}"), df, 3).collect()] if q < 15 else ranked
        assert sorted(found)[:3] == ranked


def test_no_pair_of_vectors_leaves_its_task(spark):
    for name in ("o06_vector_topk", "f50_all_cosine_pairs", "f50_f53_cosine_pairs"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan


def test_tile_of_pivots_keeps_no_gathered_vectors(monkeypatch):
    import tracemalloc

    import pandas as pd

    n, rng = 600, np.random.default_rng(1)
    u = rng.normal(size=(n, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    side = pd.DataFrame({"id": np.arange(n), "u": list(u), "angles": list(np.zeros((n, 2))), "own": 1})
    tracemalloc.start()
    got = pivots._compared(0.2, 1.4)(side, side)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = u @ u.T
    assert len(got) == int(((s >= 0.2) & (np.arange(n)[:, None] < np.arange(n))).sum())
    assert most < 20e6  # all pairs' vectors side by side were 180 MB


def test_copies_of_a_title_are_paired_by_class(spark, monkeypatch):
    from quern.operators import grouping

    monkeypatch.setattr(grouping, "TILE", 3)
    words = ["red ring", "ring, RED", "red ring big", "bolt", "blue bolt big", "", None, "red ring big new"]
    rows = [(i, "xy"[i % 2] if i % 11 else None, words[i % len(words)], i % 3) for i in range(60)]
    t = {i: set(w.lower().replace(",", "").split()) for i, _, w, _ in rows if w}
    want = set()
    for a, x, _, ka in rows:
        for b, y, _, kb in rows:
            if a < b and x is not None and x == y and len(t.get(a, set()) & t.get(b, set())) >= 2 and len(t[a] & t[b]) / len(t[a] | t[b]) >= 0.3:
                want.add((a, b, len(t[a] & t[b]), round(len(t[a] & t[b]) / len(t[a] | t[b]), 9), ka, kb))
    found = grouping.pairs(spark.createDataFrame(rows, "id long, brand string, title string, k int"), "brand", carried=("k",))
    got = [(r["a"], r["b"], r["n_shared"], round(r["jaccard"], 9), r["a_k"], r["b_k"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
