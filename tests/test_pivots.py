"""The pruned vector join against brute force."""

import numpy as np

from quern.operators import pivots


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "TILE", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 24))
    x[5], x[6], x[7] = 0, x[8], -x[8]
    label = [["a", "b", None][i % 8 // 3 if i % 8 < 7 else 2] for i in range(900)]
    rows = [(i, label[i], [float(y) for y in x[i]]) for i in range(900)]
    rows += [(900 + i, "a", [1.0, 0.1 * i]) for i in range(4)] + [(904, "a", None), (905, "b", [float("nan")] * 24), (906, "b", [])]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for threshold in (0.8, 0.3, -0.5):
        found = pivots.NearVectors(spark.createDataFrame(rows, "id long, label string, vector array<double>"), threshold)
        got = {(r["a"], r["b"]): r["cosine"] for r in found.pairs().collect()}
        near = unit @ unit.T
        want = {(i, j) for i in range(900) for j in range(i + 1, 900) if label[i] and label[i] == label[j] and near[i, j] >= threshold and 5 not in (i, j)}
        want |= {(900 + i, 900 + j) for i in range(4) for j in range(i + 1, 4)}
        assert set(got) == want and all(abs(got[p] - near[p]) < 1e-9 for p in want if p[1] < 900)
        if threshold == 0.8:
            share = found.formed().selectExpr("sum(formed) / sum(all) as s").first()["s"]
            assert share < 0.2, share


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, label string, vector array<float>")
    assert pivots.NearVectors(none, 0.8).pairs().count() == 0
