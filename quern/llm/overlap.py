"""Near copies by exact Jaccard similarity of word shingles.

A set of n shingles can only reach the threshold with a set that shares at least
ceil(threshold * n) of them. So, with all shingles in one order, two linked sets share a
shingle among the first n - ceil(threshold * n) + 1 of each (the prefix), and an equality
join on prefix shingles loses no link. Any order will do; shingles that many documents hold
come last, so that common passages make few candidates.

Sets that are equal are one class. Each shingle's members are first compared with one of
them, the hub, whose shingles are the most widely held; then pairs that are not yet in one
component. Pairs never leave that join unless their parity sketches allow a link: bit i of a
sketch says whether an odd number of shingles hash to i, so two sketches differ in no more
bits than the sets differ in shingles, and linked sets differ in few.

With fingerprints, sets whose fingerprints are connected meet too, in the same two steps: they
share the component of their fingerprints as a key, and a lower similarity confirms them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BitTable, components, doc_columns, splitmix, staged

#: One of so many documents is looked at for common shingles, and how many of these must hold one. They only set the order.
EVERY = 32
COMMON = (3, 24)
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Members of one shingle that are compared in one task; others are tiles of their own.
TILE = 256


def shingles(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, words as in simhash.fingerprints;
    a text of fewer words is one shingle, a text without words none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
    size = min(size, len(words))
    found = np.zeros(len(words) - size + 1, np.uint64)
    for at in range(size):
        found = splitmix(found ^ hashes[at: at + len(found)])
    return np.unique(found).view(np.int64)


def signature(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def needed(n: int, percent: int) -> int:
    """The least number of shingles that a set of n shares with a set it is linked to."""
    return -(-n * percent // 100)


def prefix(found: np.ndarray, percent: int, level: np.ndarray) -> np.ndarray:
    """The first shingles in the order of (level, hash)."""
    return found[np.lexsort((found, level))][: len(found) - needed(len(found), percent) + 1] if len(found) else found


def sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH longs of parity bits."""
    odd = np.bincount(found.view(np.uint64) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _common(docs: DataFrame, size: int, most_bits: int = 26) -> list[BitTable]:
    """Tables of the shingles that some documents of a sample hold, and that many do."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": np.concatenate([np.empty(0, np.int64), *[shingles(t, size) for t in pdf["text"]]])})

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(EVERY)) == 0)
    held = staged(doc_columns(some, "text").mapInPandas(run, "key long").groupBy("key").agg(F.count("*").alias("n"))
                  .where(F.col("n") >= min(COMMON)), "common")
    return [BitTable(held.where(F.col("n") >= least), "key", most_bits) for least in COMMON]


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b, percent) of classes whose Jaccard similarity reaches percent / 100, exactly."""
    ids = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = staged(classes.join(ids, "sig").groupBy("sig").agg(F.min("doc_id").alias("doc_id")), "wanted")
    few = wanted.select("doc_id").distinct()
    few = F.broadcast(few) if wanted.count() <= 1_000_000 else few

    def run(batches):
        for pdf in batches:
            sets = [shingles(t, size) for t in pdf["text"]]
            yield pd.DataFrame({"sig": [signature(s) for s in sets], "shingles": sets})

    sets = doc_columns(docs.join(few, "doc_id", "left_semi"), "text").mapInPandas(run, "sig long, shingles array<long>")
    sets = staged(sets.join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("shingles").alias("shingles")), "sets")
    x = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))
    shared, both = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    enough = shared * 100 >= (both - shared) * F.col("percent")
    return staged(pairs.join(x, "a").join(y, "b").where(enough).select("a", "b"), "links")


def _allowed(percent: int, a: list[Column], b: list[Column]) -> Column:
    """Can sets of na and nb shingles with these sketches be linked? They then differ in at most
    (1 - t) / (1 + t) * (na + nb) shingles."""
    sized = F.expr(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}")
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
    return sized & (apart * (100 + percent) <= F.expr(f"(na + nb) * {100 - percent}"))


def _sketch(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(SKETCH)]


def _likely(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow a link and whose prefixes share enough for it. Of o shared
    shingles the t-th is at place t + n - o of a set of n at most, so o - needed(n) + 1 of them,
    with the larger n, lie in both prefixes. held: id, n, keys, sketch."""
    x = held.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("keys").alias("x"), *[F.col(f).alias(g) for f, g in zip(_sketch("f"), _sketch("fa"))])
    y = held.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("y"), *[F.col(f).alias(g) for f, g in zip(_sketch("f"), _sketch("fb"))])
    overlap = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    larger = F.expr(f"(greatest(na, nb) * {percent} + 99) div 100")
    near = _allowed(percent, [F.col(c) for c in _sketch("fa")], [F.col(c) for c in _sketch("fb")])
    return pairs.join(x, "a").join(y, (pairs["b"] == y["b"]) & near).drop(y["b"]) \
        .where(F.size(F.array_intersect("x", "y")) >= overlap - larger + 1).select("a", "b")


def _hubs(members: DataFrame, weights: DataFrame) -> DataFrame:
    """The pairs (a, b) of each key's members (key, id) and the one of the largest weight (id, weight), once each."""
    hubs = members.join(weights, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("hub"))
    pair = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]
    return staged(members.join(hubs, "key").where("id <> hub").select(*pair).distinct(), "pairs")


def _apart(members: DataFrame, sizes: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a key's members (key, id) in different components whose sketches allow a link, tile by tile. sizes: id, n, sketch."""
    member = members.join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    open_keys = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    member = staged(member.join(open_keys.select("key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "key")
                    .join(sizes, "id").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")), "open")

    def side(name: str, own: str, other: str) -> DataFrame:
        return member.select("key", F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("c").alias(f"c{name}"), F.col("tile").alias(own),
                             F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias(other),
                             *[F.col(f).alias(g) for f, g in zip(_sketch("f"), _sketch(f"f{name}"))])

    left, right = side("a", "i", "j"), side("b", "j", "i")
    where = ["key", "i", "j"]
    near = (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & _allowed(percent, [F.col(c) for c in _sketch("fa")], [F.col(c) for c in _sketch("fb")])
    return left.join(right, [left[c] == right[c] for c in where] + [near]).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, prints: Callable | None = None, near: Callable | None = None, confirmed: int = 50) -> DataFrame:
    """(doc_id, component_id) for each row of docs (doc_id, text) whose doc_id is not null:
    the least doc_id reachable over links of a Jaccard similarity of at least ``percent`` / 100
    between sets of ``size``-word shingles, itself included.

    With ``prints``, which gives the 64-bit fingerprints of texts, and ``near``, which gives the pairs (a, b) of rows
    (id, fp) with near fingerprints, documents whose fingerprints are connected over such pairs are linked as well,
    if their similarity is ``confirmed`` / 100 at least.

    Texts without words have equal (empty) sets. An empty table gives an empty result."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    common = _common(docs, size)

    def run(batches):
        for pdf in batches:
            sets = [shingles(t, size) for t in pdf["text"]]
            flat = np.concatenate([np.empty(0, np.int64), *sets]).view(np.uint64)
            level = sum((table.has(flat).astype(np.int8) for table in common), np.zeros(len(flat), np.int8))
            levels = np.split(level, np.cumsum([len(s) for s in sets])[:-1]) if sets else []
            bits = np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH)
            fp = {"fp": prints(pdf["text"].tolist()).view(np.int64)} if prints else {}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "sig": [signature(s) for s in sets], "n": [len(s) for s in sets],
                                "keys": [prefix(s, percent, v) for s, v in zip(sets, levels)]} | {f: bits[:, k] for k, f in enumerate(_sketch("f"))} | fp)

    shape = "doc_id long, sig long, n long, keys array<long>, " + ", ".join(f"{f} long" for f in _sketch("f")) + (", fp long" if prints else "")
    table = staged(doc_columns(docs, "doc_id", "text").mapInPandas(run, shape), "prefixes")
    classes = table.select("doc_id", "sig")
    # One row of each class gives the keys. Rows of a class have the same ones, so any will do.
    chosen = classes.groupBy("sig").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"))
    copies = staged(chosen.where("rows > 1").select(F.col("sig").alias("copied"), "first"), "copies")
    single = table.join(copies, F.col("sig") == F.col("copied"), "left").where("first is null or doc_id = first")
    keyed = single.select(F.col("sig").alias("id"), "n", F.explode("keys").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    members = staged(keyed.join(full, "key").distinct(), "members")
    # A copy that was changed least holds what most others hold.
    weight = F.sum("held") / F.expr(f"max(n) - (max(n) * {percent} + 99) div 100 + 1")
    lists = members.groupBy("id").agg(weight.alias("weight"), F.max("n").alias("n"), F.collect_list("key").alias("keys"))
    sketches = single.groupBy(F.col("sig").alias("id")).agg(*[F.first(f).alias(f) for f in _sketch("f")])
    held = staged(lists.join(sketches, "id"), "held")
    likely = staged(_likely(_hubs(members, held.select("id", "weight")), held, percent).withColumn("percent", F.lit(percent)), "likely")
    if prints:
        marked = _marked(table.select("sig", "fp"), near)
        sizes = single.select(F.col("sig").alias("id"), "n", *_sketch("f")).join(marked.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
        sizes = staged(sizes, "sizes")
        weights = sizes.select("id").join(held.select("id", "weight"), "id", "left").select("id", F.coalesce("weight", F.lit(0.0)).alias("weight"))
        likely = _with(likely, _hubs(marked, weights), confirmed)
    links = _verified(docs, classes, likely, size)
    found = components(links)
    rest = staged(_likely(_apart(members, held.drop("weight", "keys"), found, percent), held, percent).withColumn("percent", F.lit(percent)), "likely")
    if prints:
        rest = _with(rest, _apart(marked, sizes, found, confirmed), confirmed)
    found = components(links.unionByName(_verified(docs, classes, rest, size)))
    joined = classes.join(found, F.col("sig") == F.col("node"), "left").select("doc_id", F.coalesce("component", "sig").alias("c"))
    least = joined.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least, "c").select("doc_id", "component_id")


def _marked(prints: DataFrame, near: Callable) -> DataFrame:
    """(key, id) of the classes (sig, fp) whose fingerprints are connected, for keys of two classes or more."""
    prints = staged(prints.distinct(), "prints")
    found = components(near(prints.select("fp").distinct().select(F.col("fp").alias("id"), "fp")))
    keyed = prints.join(found, F.col("fp") == F.col("node"), "left").select(F.coalesce("component", "fp").alias("key"), F.col("sig").alias("id")).distinct()
    full = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return staged(keyed.join(full.select("key"), "key"), "marked")


def _with(pairs: DataFrame, more: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, percent) and more (a, b), each pair once with the lesser percent."""
    return staged(pairs.unionByName(more.withColumn("percent", F.lit(percent))).groupBy("a", "b").agg(F.min("percent").alias("percent")), "likely")
