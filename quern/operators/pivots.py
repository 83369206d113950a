"""Exact joins of vectors by cosine, pruned by angles to pivots.

Angles between vectors are a metric. Each vector lives in the cell of its nearest pivot, and a
pair within an angle t can only have its other end in a cell whose pivot is at most t further
away than the cell's own vectors, and at most 2 t further than the nearest pivot. So a vector
visits few cells when vectors are clustered, and all of them at worst; nothing is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as v
from quern.session import kept

#: Rows of a side that a task compares at a time.
TILE = 1024
#: Rows of a side that are multiplied at a time.
ROWS = 128
#: Rounding of angles, which must lose no pair at the threshold.
SLACK = 1e-6


def pivots_of(rows: DataFrame, n: int = 32, sample: int = 2000) -> np.ndarray:
    """``n`` vectors far from each other among the first ``sample`` by a hash; they steer the pruning, not the result."""
    drawn = rows.where(v.norm(F.col("vector")) > 0).orderBy(F.xxhash64("id"), "id").limit(sample).select(v.unit(F.col("vector")).alias("u")).toPandas()["u"]
    if not len(drawn):
        return np.zeros((0, 1))
    width = max(len(u) for u in drawn)
    x = np.stack([u for u in drawn if len(u) == width])
    chosen, best = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        far = int(best.argmin())
        if best[far] > 1 - 1e-9:
            break
        chosen.append(far)
        best = np.maximum(best, x @ x[far])
    return x[chosen]


def _placed(pivots: np.ndarray):
    def run(batches):
        for pdf in batches:
            u = [np.asarray(x, float) for x in pdf["u"]]
            angles, home = [], []
            for x in u:
                if len(x) != pivots.shape[1]:
                    # Vectors of another width have a cell of their own, without pivots.
                    angles.append(None)
                    home.append(-len(x))
                else:
                    a = np.arccos(np.clip(pivots @ x, -1, 1))
                    angles.append(a)
                    home.append(int(a.argmin()))
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "u": u, "angles": angles, "home": home})

    return run


def _visits(rows: DataFrame, angle: float) -> DataFrame:
    """rows, one for each cell that a row visits: its own, and those before it that may hold a partner."""
    cells = (rows.where("home >= 0").groupBy("label", "home").agg(F.max(F.expr("angles[home]")).alias("radius"))
             .groupBy("label").agg(F.collect_list(F.struct(F.col("home").alias("cell"), "radius")).alias("cells")))
    near = F.expr(f"""transform(filter(cells, c -> c.cell < home and angles[c.cell] <= c.radius + {angle + SLACK}
        and angles[c.cell] <= angles[home] + {2 * angle + SLACK}), c -> c.cell)""")
    return rows.join(cells, "label", "left").withColumn("cell", F.explode(F.concat(F.array("home"), F.coalesce(F.when(F.col("home") >= 0, near), F.array().cast("array<int>")))))


def _compared(threshold: float, angle: float):
    def run(homes: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(homes) and len(guests):
            x, y = np.stack(homes["u"].to_numpy()), np.stack(guests["u"].to_numpy())
            a, b = homes["id"].to_numpy(), guests["id"].to_numpy()
            placed = homes["angles"].iloc[0] is not None
            p, q = (np.stack(homes["angles"].to_numpy()), np.stack(guests["angles"].to_numpy())) if placed else (None, None)
            # A few rows at a time, so that no matrix of all pairs of the tile is held.
            for at in range(0, len(x), ROWS):
                some = slice(at, at + ROWS)
                wanted = (guests["own"].to_numpy() == 0) | (a[some, None] < b)
                for k in range(p.shape[1] if placed else 0):
                    wanted &= np.abs(p[some, k][:, None] - q[:, k]) <= angle + SLACK
                s = np.clip(x[some] @ y.T, -1, 1)
                i, j = np.nonzero(wanted & (s >= threshold))
                out.append((np.minimum(a[at + i], b[j]), np.maximum(a[at + i], b[j]), s[i, j]))
        low, high, s = map(np.concatenate, zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pd.DataFrame({"a": low, "b": high, "cosine": s})

    return run


class NearVectors:
    """Pairs of rows (id: long, label, vector) of one label, not null, with a cosine of ``threshold`` or more."""

    def __init__(self, rows: DataFrame, threshold: float, pivots: int = 32):
        self.threshold, self.angle = threshold, math.acos(max(-1.0, min(1.0, threshold)))
        fine = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & (v.norm(F.col("vector")) > 0) & (v.norm(F.col("vector")) < F.lit(float("inf"))))
        chosen = pivots_of(fine, pivots)
        units = fine.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), v.unit(F.col("vector")).alias("u"))
        self.rows = kept(units.mapInPandas(_placed(chosen), "id long, label string, u array<double>, angles array<double>, home int"), "placed")
        homes = self.rows.groupBy("label", F.col("home").alias("cell")).agg(F.count("*").alias("n"))
        visits = _visits(self.rows, self.angle)
        guests = visits.groupBy("label", "cell").agg(F.count("*").alias("m"))
        self.cells = kept(homes.join(guests, ["label", "cell"]), "cells")
        self.visits = visits.select("id", "label", "u", "angles", "cell", (F.col("cell") == F.col("home")).cast("int").alias("own"))

    def formed(self) -> DataFrame:
        """(label, formed, all): pairs that meet in a cell, and all pairs of the label."""
        return self.cells.groupBy("label").agg(F.sum(F.expr("n * (m - n) + n * (n - 1) div 2")).alias("formed"), F.expr("sum(n) * (sum(n) - 1) div 2").alias("all"))

    def pairs(self) -> DataFrame:
        """(a, b, cosine), a < b. Rows and visitors of a cell are cut into tiles, and each two tiles are
        compared in a task, so a cell of any size spreads."""
        tiles = self.cells.select("label", "cell", F.expr(f"cast(ceil(n / {TILE}) as int)").alias("rows"), F.expr(f"cast(ceil(m / {TILE}) as int)").alias("columns"))
        sides = self.rows.withColumnRenamed("home", "cell").join(tiles, ["label", "cell"])
        homes = sides.select("label", "cell", F.expr("cast(pmod(xxhash64(id), rows) as int)").alias("i"), F.explode(F.expr("sequence(0, columns - 1)")).alias("j"), "id", "u", "angles")
        visits = self.visits.join(tiles, ["label", "cell"])
        guests = visits.select("label", "cell", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), F.expr("cast(pmod(xxhash64(id), columns) as int)").alias("j"), "id", "u", "angles", "own")
        key = ["label", "cell", "i", "j"]
        guests = guests.select(*[F.col(c).alias(c) for c in guests.columns])
        return homes.groupBy(*key).cogroup(guests.groupBy(*key)).applyInPandas(_compared(self.threshold, self.angle), "a long, b long, cosine double")
