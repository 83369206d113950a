"""Near-duplicate vectors through an inverted multi-index.

Each half of a unit vector has a codebook of its own; the two form a product grid of cells,
within each label. A vector is filed under its own cell and visits the grid cells around it by
multi-sequence traversal: with both lists of centroids sorted by distance, a queue hands out
cells (i, j) in order of their distance, which is that to the planes that part centroid i and j
from the vector's own centroids, l1(i)^2 + l2(j)^2. The traversal stops at the distance where
the target recall is reached. That is measured when the codebooks are fitted: pairs exactly at
the threshold are made from sampled vectors, and the distance is the largest that ``recall`` of
them need from one side. Of a pair in two cells, the vector of the cell with the larger number
does the visit. Pairs met in a visited cell are verified by their exact cosine.

Labels of like size share codebooks, which the largest of them sizes; a label that fits a tile is
one cell. So neither one hot label nor very many small ones make cells too full or too fine.
Visits travel as ids until it is known which cells hold somebody to meet; vectors follow then.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, doc_columns, forest, staged, with_classes

#: Rows that a cell should hold.
TILE = 512
#: Cells of more than this many times TILE rows or visitors are cut into tiles, each compared in a task of its own.
CUT = 4
#: Largest codebook of a half.
MOST_CENTRES = 2048


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmin((centres**2).sum(1) - 2 * part @ centres.T, axis=1) for part in np.array_split(x, 1 + len(x) // 2000)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


class Grid:
    """Two codebooks and the radius of the traversal."""

    def __init__(self, first: np.ndarray, second: np.ndarray, radius: float = 0.0):
        self.books, self.radius = (first, second), radius
        self.gaps = [np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(-1), 1e-300)) for b in self.books]

    def planes(self, x: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Own centroid, and squared distance to the plane between it and each other one."""
        book, gap = self.books[half], self.gaps[half]
        d = (x**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * x @ book.T
        own = np.argmin(d, axis=1)
        far = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap[own])
        far[np.arange(len(x)), own] = 0
        return own, np.maximum(far, 0) ** 2

    def visit(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell, and the cells of smaller number that each row visits, nearest first."""
        w, n = self.books[0].shape[1], len(self.books[1])
        (a, near), (b, by) = self.planes(x[:, :w], 0), self.planes(x[:, w:], 1)
        own, cells = a * n + b, []
        for row in range(len(x)):
            found = traverse(near[row], by[row], self.radius**2)
            cells.append(np.array([c for i, j in found if (c := i * n + j) < own[row]], np.int64))
        return own, cells


def traverse(first: np.ndarray, second: np.ndarray, far: float) -> list[tuple[int, int]]:
    """Cells (i, j) in order of first[i] + second[j], while that is at most ``far``. A cell
    enters the queue once its neighbours nearer by one place in either list have left it."""
    a, b = np.nonzero(first <= far)[0], np.nonzero(second <= far)[0]
    a, b = a[np.argsort(first[a], kind="stable")], b[np.argsort(second[b], kind="stable")]
    if not len(a) or not len(b):
        return []
    x, y = first[a].tolist(), second[b].tolist()
    out, queue, left = [], [(x[0] + y[0], 0, 0)], [0] * len(x)  # left[p]: places of row p that have left
    while queue:
        d, p, q = heappop(queue)
        if d > far:
            break
        out.append((int(a[p]), int(b[q])))
        left[p] = q + 1
        if p + 1 < len(x) and left[p + 1] == q:
            heappush(queue, (x[p + 1] + y[q], p + 1, q))
        if q + 1 < len(y) and (p == 0 or left[p - 1] > q + 1):
            heappush(queue, (x[p] + y[q + 1], p, q + 1))
    return out


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float) -> Grid:
    """Codebooks for about TILE rows a cell in a label of ``rows``, and the radius for the recall."""
    w = sample.shape[1] // 2
    k = int(min(MOST_CENTRES, max(2, np.ceil(np.sqrt(rows / TILE)))))
    grid = Grid(_kmeans(sample[:, :w], k), _kmeans(sample[:, w:], k))
    rng = np.random.default_rng(11)
    needed = []
    for _ in range(20):
        x = sample[rng.integers(0, len(sample), 2000)]
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * noise
        (_, near), (_, by) = grid.planes(x[:, :w], 0), grid.planes(x[:, w:], 1)
        (a, _), (b, _) = grid.planes(y[:, :w], 0), grid.planes(y[:, w:], 1)
        each = np.arange(len(x))
        needed.append(np.sqrt(near[each, a] + by[each, b]))
    needed = np.sort(np.concatenate(needed))
    grid.radius = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1e-9
    return grid


def _units(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([x, np.zeros_like(x)], axis=1) if x.shape[1] < 2 else x


def near_vectors(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = 20_000, recall: float = 0.9999) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding array, label): vec_id, n_links,
    component_id, kept.

    Vectors are compared only with vectors of the same label and length. A null label, a
    vector that is null, empty, zero or holds a null or non-finite component links with
    nothing: no links, a component of its own, kept. So does a row with a null vec_id, which
    has no component and is not kept. Equal vectors (told by 128 bits) are one class and link
    with one another; classes are compared once, whatever their size. Rows that repeat a
    vec_id count as vectors of their own. Extra columns are ignored; an empty table gives an
    empty result.

    The codebooks are fitted on at most ``sample_rows`` classes; every class is filed and
    visits. ``recall`` is the share of pairs at the very threshold that a visit must reach."""
    rows = doc_columns(vectors, "vec_id", "embedding", "label")
    value = F.col("embedding").cast("array<double>")
    norm = F.aggregate(value, F.lit(0.0), lambda a, x: a + x * x)
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
            & ~F.exists(value, lambda x: x.isNull() | F.isnan(x)) & (norm > 0) & (norm < float("inf")))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    key = ["h1", "h2"]
    keyed = rows.where("fine").withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding", "label"))
    classes = staged(keyed.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"),
                                             F.first("embedding").alias("embedding")), "classes")
    widths = [r["w"] for r in classes.select(F.size("embedding").alias("w")).distinct().collect()]
    parts = [_links(classes.where(F.size("embedding") == w), threshold, sample_rows, recall) for w in widths]
    alone = (rows.where(~F.col("fine"))
             .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    if not parts:
        out = alone
    else:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = staged(found, "links")
        edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
        reach = components(edges) if edges.limit(1).count() else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        counts = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
        named = (classes.join(counts, "id", "left").join(reach, F.col("id") == F.col("node"), "left")
                 .select(*key, "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
                         F.coalesce("component", "id").alias("component_id")))
        out = with_classes(keyed.select("vec_id", *key), staged(named, "named"), key, "n").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _tiers(classes: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """classes with ``tier``, null for labels that fit a tile, else the same for labels whose sizes
    are within a factor of four; and the largest label of each tier."""
    sizes = staged(classes.groupBy("label").agg(F.count("*").alias("rows")).where(F.col("rows") > TILE)
                   .withColumn("tier", F.floor(F.log(4.0, F.col("rows") / TILE)).cast("int")), "sizes")
    largest = {r["tier"]: r["rows"] for r in sizes.groupBy("tier").agg(F.max("rows").alias("rows")).collect()}
    return with_classes(classes, sizes, ["label"], "rows").drop("rows"), largest


def _links(classes: DataFrame, threshold: float, sample_rows: int, recall: float) -> DataFrame:
    """(id, other, links): spanning edges id - other, and, with other null, links to add to id."""
    # Components travel as they are stored, four bytes each if they are floats.
    kind = "<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    label_type = classes.schema["label"].dataType.simpleString()
    classes, largest = _tiers(classes)
    grids = {}
    for tier, rows in largest.items():
        drawn = classes.where(F.col("tier") == tier).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("embedding").toPandas()
        grids[tier] = fit(_units(np.stack(drawn["embedding"].to_numpy())), rows, threshold, recall)
    spread = classes.sparkSession.sparkContext.broadcast(grids)

    def visits(batches):
        grids = spread.value
        for pdf in batches:
            for tier, part in pdf.groupby("tier"):
                own, cells = np.zeros(len(part), np.int64), [np.empty(0, np.int64)] * len(part)
                if tier >= 0:
                    own, cells = grids[tier].visit(_units(np.stack(part["embedding"].to_numpy()).astype(kind)))
                at = np.repeat(np.arange(len(part)), [1 + len(c) for c in cells])
                cell = np.concatenate([x for o, c in zip(own, cells) for x in ([o], c)])
                held = part[["label", "h1", "h2"]].iloc[at]
                yield held.assign(cell=cell.astype(np.int32), home=cell == own[at])

    visited = staged(classes.select("label", "h1", "h2", F.coalesce("tier", F.lit(-1)).alias("tier"), "embedding")
                     .mapInPandas(visits, f"label {label_type}, h1 long, h2 long, cell int, home boolean"), "visits")
    counts = visited.groupBy("label", "cell").agg(
        F.count_if("home").alias("filed"), F.count("*").alias("visitors")).where("filed > 0 and visitors > 1")
    tiled = visited.join(counts, ["label", "cell"]).select(
        "label", "cell", "home", "h1", "h2",
        F.ceil(F.col("filed") / (CUT * TILE)).cast("int").alias("cuts"), F.ceil(F.col("visitors") / (CUT * TILE)).cast("int").alias("turns"))
    # In a cell of one tile, a row at home is there once for both sides.
    single = (F.col("cuts") == 1) & (F.col("turns") == 1)
    filed = (tiled.where("home")
             .withColumn("cut", F.pmod("h1", F.col("cuts")).cast("int"))
             .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("side", F.when(single, 2).otherwise(0)))
    asking = (tiled.where(~(F.col("home") & single)).withColumn("turn", F.pmod("h2", F.col("turns")).cast("int"))
              .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("side", F.lit(1)))
    fields = ["label", "cell", "cut", "turn", "side", "home", "h1", "h2"]
    placed = filed.select(fields).unionByName(asking.select(fields))
    held = classes.select("h1", "h2", "id", "n", F.col("embedding").alias("vector"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        held, ask = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
        if not len(held) or not len(ask):
            return pd.DataFrame({"id": [], "other": [], "links": []}).astype("int64")
        x, y = (_units(np.stack(part["vector"].to_numpy()).astype(kind)) for part in (ask, held))
        a, b = np.nonzero(x @ y.T >= threshold)
        ia, ib = ask["id"].to_numpy(), held["id"].to_numpy()
        # In the cell of both, a pair is met from both sides; elsewhere only one of them visits.
        keep = ~ask["home"].to_numpy()[a] | (ia[a] < ib[b])
        a, b = a[keep], b[keep]
        ids = np.concatenate([ia[a], ib[b]])
        add = np.concatenate([held["n"].to_numpy()[b], ask["n"].to_numpy()[a]])
        node, inverse = np.unique(ids, return_inverse=True)
        total = np.bincount(inverse, weights=add, minlength=len(node)).astype(np.int64)
        p, q = forest(ia[a], ib[b])
        return pd.DataFrame({"id": np.concatenate([node, p]), "other": pd.array([None] * len(node) + q.tolist(), dtype="Int64"),
                             "links": np.concatenate([total, np.zeros(len(p), np.int64)])})

    return (placed.join(held, ["h1", "h2"]).groupBy("label", "cell", "cut", "turn")
            .applyInPandas(verify, "id long, other long, links long"))
