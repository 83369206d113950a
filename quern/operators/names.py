"""Many names in long texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that are cut into windows at a time.
PIECE = 1000
#: Names up to which they are broadcast and looked for where texts are read, and characters that a task looks at there at a time.
FEW, CHARACTERS = 200_000, 1 << 18


def _runs(text: Column, size: Column) -> Column:
    """Every run of ``size`` characters, with its place from 0."""
    return F.transform(F.sequence(F.lit(0), F.length(text) - size), lambda i: F.struct(i.alias("offset"), F.substr(text, i + 1, size).alias("run")))


def anchored(names: DataFrame, name: str) -> DataFrame:
    """(name, low, size, offset, run): of each name in lower case the run of ``size`` characters that the fewest
    names hold, the first of equals. ``size`` is the largest power of two that is not longer than the name."""
    low = names.where(F.length(name) > 0).select(F.col(name), F.lower(name).alias("low")).distinct()
    low = low.withColumn("size", F.expr("cast(pow(2, floor(log2(length(low)))) as int)"))
    held = low.select(name, "low", "size", F.inline(_runs(F.col("low"), F.col("size"))))
    usual = held.groupBy("run").agg(F.count_distinct("low").alias("n"))
    best = held.join(usual, "run").groupBy(name, "low", "size").agg(F.min(F.struct("n", "offset", "run")).alias("best"))
    return best.select(name, "low", "size", "best.offset", "best.run")


def found(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name, places): how often each name occurs in each whole text, ignoring case, overlaps included.

    Names are anchored at their rarest run, and a text gives one window for each place and each size of run, at
    most eight sizes for names of up to 255 characters, however many names and lengths there are. Up to FEW names
    are broadcast and windows are compared where texts are read; of more, runs are joined
    by equality and the rest of the name is compared in the window, so a text takes space in proportion to its length.
    Null keys are rows of their own value, null texts and
    empty names give nothing; rows that repeat a key count together."""
    wanted = anchored(names, name)
    few = wanted.limit(FEW + 1).toPandas()
    if len(few) <= FEW:
        held = texts.select(F.col(key), F.lower(text).alias("__t")).where("length(__t) > 0")
        shape = f"`{key}` {held.schema[key].dataType.simpleString()}, `{name}` string, places long"
        return held.mapInArrow(_searched(few, key, name), shape).groupBy(key, name).agg(F.sum("places").alias("places"))
    sizes = wanted.agg(F.sort_array(F.collect_set("size"))).scalar()
    longest = wanted.agg(F.max("size")).scalar()
    whole = (texts.select(F.col(key), F.lower(text).alias("__t"), F.coalesce(2 * longest, F.lit(0)).alias("__pad")).where("length(__t) > 0")
             .withColumn("__n", F.length("__t")).withColumn("__t", F.concat(F.repeat(F.lit("\0"), F.col("__pad")), "__t", F.repeat(F.lit("\0"), F.col("__pad")))))
    pieces = (whole.withColumn("__start", F.explode(F.expr(f"sequence(0, __n - 1, {PIECE})")))
              .select(key, "__n", "__pad", "__start", F.substr("__t", F.col("__start") + 1, F.lit(PIECE) + 2 * F.col("__pad")).alias("__piece"))
              .withColumn("__size", F.explode(sizes)))
    # The window of place i (from 0) begins size - 1 characters before it and ends 2 * size - 2 after it.
    at = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.col("__n") - F.col("__start")) - 1)
    window = F.transform(at, lambda i: F.struct(
        (F.col("__start") + i).alias("__at"), F.substr("__piece", i + F.col("__pad") - F.col("__size") + 2, 3 * F.col("__size") - 2).alias("__window")))
    windows = (pieces.select(key, "__n", "__size", F.inline(window))
               .withColumn("__run", F.substr("__window", F.col("__size"), F.col("__size"))))
    met = windows.join(wanted, (F.col("__run") == F.col("run")) & (F.col("__size") == F.col("size")))
    first = F.col("__at") - F.col("offset")
    same = F.substr("__window", F.col("__size") - F.col("offset"), F.length("low")) == F.col("low")
    return (met.where(same & (first >= 0) & (first + F.length("low") <= F.col("__n")))
            .groupBy(key, name).agg(F.count("*").alias("places")))


def _hashes(codes: np.ndarray, size: int):
    """(run length, hashes of the runs of that length at each place), for the powers of two up to ``size``."""
    h, n = codes * np.uint64(0x9E3779B97F4A7C15), 1
    while True:
        yield n, h
        if 2 * n > size or len(h) <= n:
            return
        h, n = h[:-n] * np.uint64(0xBF58476D1CE4E5B9 + 2 * n) + h[n:], 2 * n


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _tables(wanted: pd.DataFrame) -> dict:
    """For each size of run: its sorted hashes, a table of their first bits, and the rows of wanted from and to which a hash goes."""
    out = {}
    for size, rows in wanted.groupby("size"):
        found = np.array([[h[0] for n, h in _hashes(_codes(run), len(run)) if n == size][0] for run in rows["run"]], np.uint64)
        order = np.argsort(found, kind="stable")
        keys, first = np.unique(found[order], return_index=True)
        shift = np.uint64(64 - max(16, int(8 * len(keys)).bit_length()))
        table = np.zeros(1 << (64 - int(shift)), bool)
        table[keys >> shift] = True
        out[int(size)] = keys, table, shift, np.append(first, len(order)), rows.index.to_numpy()[order]
    return out


def _searched(wanted: pd.DataFrame, key: str, name: str):
    lows, whole = wanted["low"].tolist(), pa.array(wanted[name].tolist(), pa.string())
    lengths, offsets = np.array([len(x) for x in lows], np.int64), wanted["offset"].to_numpy(dtype=np.int64)
    longest = max(lengths, default=0)

    def places(text: str, starts: np.ndarray, stop: int):
        """(text number, name number) of each name that begins before ``stop`` in ``text``, which is texts that begin at ``starts``, one behind the other."""
        for size, h in _hashes(_codes(text), max(tables, default=0)):
            if size in tables:
                keys, table, shift, first, order = tables[size]
                at = np.nonzero(table[h >> shift])[0]
                slot = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                same = keys[slot] == h[at]
                at, slot = at[same], slot[same]
                n = first[slot + 1] - first[slot]
                who = order[np.repeat(first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                begin = np.repeat(at, n) - offsets[who]
                inside = (begin >= 0) & (begin < stop) & (begin + lengths[who] <= len(text))
                begin, who = begin[inside], who[inside]
                number = np.searchsorted(starts, begin, "right") - 1
                one = number == np.searchsorted(starts, begin + lengths[who] - 1, "right") - 1
                for t, b, w in zip(number[one].tolist(), begin[one].tolist(), who[one].tolist()):
                    if text.startswith(lows[w], b):
                        yield t, w

    tables: dict = {}

    def run(batches):
        tables.update(_tables(wanted))
        for batch in batches:
            texts, at, found = batch.column("__t"), 0, []
            while tables and at < len(texts):
                some, size, low = [], 0, at
                while at < len(texts) and size < CHARACTERS:
                    some.append(texts[at].as_py())
                    size, at = size + len(some[-1]), at + 1
                starts = np.cumsum([0] + [len(x) for x in some[:-1]])
                text = "".join(some)
                for begin in range(0, len(text), CHARACTERS):
                    piece = text[begin: begin + CHARACTERS + longest]
                    found += [(low + t, w) for t, w in places(piece, starts - begin, CHARACTERS)]
            if found:
                pairs, n = np.unique(np.array(found, np.int64), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(pairs[:, 0])), whole.take(pa.array(pairs[:, 1])), pa.array(n)], [key, name, "places"])

    return run
