"""Best-fit packing by patterns whose repeat counts are fitted with non-negative least squares.

Documents become pieces of at most ``length`` ids. Only the histogram of piece lengths, at
most ``length`` numbers, reaches the driver. There, all patterns of one to three lengths that
fill a sequence exactly are enumerated from the lengths that occur; repeat counts are fitted
to the histogram by non-negative least squares and rounded down to what the histogram still
has. The same is done on the residue with patterns of bounded waste, and what is left then
is packed best-fit decreasing. The plan is again a table of
a size bounded by ``length``. Each piece finds its place in it by its rank among the pieces
of its length, counted over salted buckets so that no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import doc_columns, staged
from quern.llm.tokens import encoder

#: Pieces of one length that are ranked together, on average.
BUCKET = 128
MOST_BUCKETS = 4096


def pieces(docs: DataFrame, path: str, length: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids array<int>]): each document's ids, then
    ``end``, cut after every ``length`` ids."""
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        encode = encoder(path)
        tail = int(end).to_bytes(4, "little")
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                data = encode(text) + tail
                for n, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at: at + 4 * length]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return doc_columns(docs, "doc_id", "text").mapInPandas(run, shape)


def patterns(present: np.ndarray, length: int, waste: int = 0) -> np.ndarray:
    """Rows of up to three lengths that occur (0: none), the largest first, that leave at most
    ``waste`` of a sequence free; for each two of them the largest third that fits."""
    have = np.zeros(length + 1, bool)
    have[present] = True
    have[0] = False
    below = np.maximum.accumulate(np.where(have, np.arange(length + 1), 0))
    present = np.nonzero(have)[0]
    out = [np.empty((0, 3), np.int64)]
    for a in present:
        b = np.append(present[present <= min(a, length - a)], 0)
        c = below[np.minimum(b, length - a - b)]
        ok = length - a - b - c <= waste
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out).astype(np.int64)


def repeats(rows: np.ndarray, counts: np.ndarray, most_rounds: int = 600) -> np.ndarray:
    """min |A x - counts|^2 over x >= 0 by accelerated projected gradient; column p of A counts
    the lengths of pattern p.

    Ends when the optimality conditions hold to a thousandth of the largest count, or half a
    document: no gradient on a positive entry, none that would raise a zero entry. What
    ``most_rounds`` may leave over is only a less good start for the residual."""
    if not len(rows):
        return np.empty(0)
    size = len(counts)
    aim = counts.astype(float)
    aim[0] = 0
    used = rows > 0
    # The squared norm of A is at most the largest column sum times the largest row sum.
    step = 1.0 / (3.0 * max(1.0, float(np.bincount(rows[used], minlength=size).max())))
    scale = np.maximum(1.0, np.bincount(rows[used], minlength=size).astype(float))
    slack = max(0.5, 1e-3 * float(aim.max()))

    def descent(v: np.ndarray) -> np.ndarray:
        rest = aim - np.bincount(rows.ravel(), weights=np.repeat(v, 3), minlength=size)
        rest[0] = 0
        return rest[rows].sum(axis=1)

    x = np.where(used, (aim / scale)[rows], np.inf).min(axis=1)
    y, t = x.copy(), 1.0
    for turn in range(most_rounds):
        down = descent(y)
        new = np.maximum(0, y + step * down)
        if float(down @ (new - x)) < 0:
            t = 1.0  # the momentum points uphill
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0, new + (t - 1) / following * (new - x))
        x, t = new, following
        if turn % 20 == 19:
            down = descent(x)
            if np.where(x > 0, np.abs(down), np.maximum(down, 0)).max() <= slack:
                break
    return x


def _fitted(counts: np.ndarray, length: int, waste: int) -> tuple[list, np.ndarray]:
    """Patterns with their fitted repeat counts, rounded down to what counts has, and what is left."""
    out, left = [], counts.copy()
    rows = patterns(np.nonzero(left)[0], length, waste)
    fitted = repeats(rows, left)
    for p in np.argsort(-fitted, kind="stable"):
        n = int(fitted[p])
        if n < 1:
            break
        need: dict[int, int] = defaultdict(int)
        for k in rows[p]:
            need[int(k)] += int(k > 0)
        need.pop(0, None)
        n = min([n] + [int(left[k]) // m for k, m in need.items()])
        if n:
            for k, m in need.items():
                left[k] -= n * m
            out.append((tuple(sorted(need.items(), reverse=True)), n))
    return out, left


def plan(histogram: dict[int, int], length: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(pattern, sequences)]: a pattern is ((piece length, times), ...) from offset 0 on.

    Exact fills come first, then, on what they leave, patterns that waste at most an eighth
    of a sequence, if that needs fewer sequences than packing it all best-fit."""
    counts = np.zeros(length + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    out, left = _fitted(counts, length, 0)
    plain = _best_fit(left, length)
    loose, rest = _fitted(left, length, length // 8)
    return out + min((plain, loose + _best_fit(rest, length)), key=lambda found: sum(n for _, n in found))


def _best_fit(counts: np.ndarray, length: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram; sequences with the same content move together."""
    open_: dict[int, list[list]] = defaultdict(list)  # free space -> [pattern, sequences]
    free = np.zeros(length + 1, bool)
    for k in range(length, 0, -1):
        left = int(counts[k])
        while left:
            fit = np.nonzero(free[k:])[0]
            if len(fit):
                space = int(fit[0]) + k
                pattern, n = open_[space][-1]
                times = min(space // k, max(1, left // n))
                take = min(n, left // times)
                if take == n:
                    open_[space].pop()
                    free[space] = bool(open_[space])
                else:
                    open_[space][-1][1] -= take
            else:
                times = min(length // k, left)
                take, pattern, space = left // times, (), length
            rest = space - times * k
            open_[rest].append([pattern + ((k, times),), take])
            free[rest] = rest > 0
            left -= take * times
    return [(tuple(p), n) for lists in open_.values() for p, n in lists]


class _Places:
    """Rank among the pieces of a length -> sequence and offset."""

    def __init__(self, found):
        slots = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        sequence = 0
        for pattern, n in found:
            offset = 0
            for k, times in pattern:
                slots[k].append((ranks[k], n, sequence, offset))
                ranks[k] += n * times
                offset += k * times
            sequence += n
        self.slots = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}

    def of(self, k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, n, sequence, offset = self.slots[k]
        at = np.searchsorted(begin, rank, "right") - 1
        within = rank - begin[at]
        return sequence[at] + within % n[at], offset[at] + within // n[at] * k


def packed(docs: DataFrame, path: str, length: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset long.

    docs: doc_id, text. A null or empty text is the end id alone. Rows that repeat a doc_id
    are packed each; a null doc_id stays null. Pieces of one length are alike for the plan
    and are dealt out in a fixed order of hash, doc_id and piece. Extra columns are ignored;
    an empty table gives an empty result."""
    cut = staged(pieces(docs, path, length, end, with_ids).withColumn("salt", F.xxhash64("doc_id", "piece")), "pieces")
    sizes = cut.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in sizes.collect()}  # at most ``length`` rows
    spread = cut.sparkSession.sparkContext.broadcast(_Places(plan(histogram, length)))
    buckets = sizes.select(F.col("length").alias("k"), F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("n") / BUCKET)).cast("int").alias("buckets"))
    dealt = (cut.join(F.broadcast(buckets), F.col("length") == F.col("k")).drop("k")
             .withColumn("bucket", F.pmod("salt", "buckets").cast("int")))
    before = F.sum("m").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = (dealt.groupBy("length", "bucket").agg(F.count("*").alias("m"))
             .select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base")))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("salt", "doc_id", "piece")) - 1
    ranked = dealt.withColumn("rank", rank).join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        k, r = lengths.to_numpy(), ranks.to_numpy()
        out = np.empty((len(k), 2), np.int64)
        order = np.argsort(k, kind="stable")
        edges = np.nonzero(np.diff(k[order]))[0] + 1
        for group in np.split(order, edges) if len(k) else []:
            out[group, 0], out[group, 1] = spread.value.of(int(k[group[0]]), r[group])
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    kept = [c for c in cut.columns if c != "salt"]
    return ranked.withColumn("at", place("length", "rank")).select(*kept, "at.sequence_id", "at.offset")
