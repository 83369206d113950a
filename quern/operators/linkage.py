"""Greedy groups in one reading of the items, and complete linkage in rounds of joins, so that no group of items has to fit in a task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.grouping import label_components
from quern.operators.numbering import numbered
from quern.session import checkpointed, dealt, dropped, kept

#: Items that one task reads without asking which belong together, and links of classes and keys whose components the driver finds.
BATCH, FEW = 50_000, 100_000


def _components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b), up to FEW of them without rounds of joins."""
    few = edges.limit(FEW + 1).collect()
    if len(few) > FEW:
        checkpointed(edges.sparkSession)
        return label_components(edges)
    up = {x: x for e in few for x in e}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in few:
        up[top(a)] = top(b)
    return edges.sparkSession.createDataFrame([(x, top(x)) for x in up], "node long, component long")


def _in_order(most: int):
    """Of rows (g, r, id, key, class, near) in the order of (g, r), the group of each. An item goes to the earliest seed that is linked to it
    and still open, and without one is a seed itself, which is what seeds that choose in turn come to: nothing before a
    seed is free, and it takes what is free in the order of ``r``. What a task holds is the open seeds of a g."""

    def run(batches):
        now = None
        for batch in batches:
            found = []
            for g, r, i, key, own, near in zip(*(batch.column(c).to_pylist() for c in ("g", "r", "id", "key", "class", "near"))):
                if g != now:
                    now, of_key, of_class, left = g, {}, {}, {}
                seed = of_key.get(key) if key is not None else None
                for c in near or ():
                    if (other := of_class.get(c)) and (seed is None or other[0] < seed):
                        seed = other[0]
                if seed is None:
                    found.append(i)
                    if most > 1 and (near or key is not None):
                        left[r] = [most - 1, i, key, own]
                        if key is not None:
                            of_key[key] = r
                        if near:
                            of_class.setdefault(own, []).append(r)
                    continue
                held = left[seed]
                found.append(held[1])
                held[0] -= 1
                if not held[0]:
                    del left[seed]
                    if of_key.get(held[2]) == seed:
                        del of_key[held[2]]
                    if seed in (mine := of_class.get(held[3], [])):
                        mine.remove(seed)
                        if not mine:
                            del of_class[held[3]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, batch.schema.field("id").type)], ["id", "seed"])

    return run


def greedy(items: DataFrame, linked: DataFrame, most: int = 50, key: str | None = None, by: str | None = None) -> DataFrame:
    """(id, seed): items in order of frequency, largest first, then id; the first free one is a seed and takes
    the free items linked to it, or of its ``key`` (null and empty keys match nothing), in that order,
    ``most`` members at most.

    items: id, frequency, key; linked: a, b (self links and unknown ids count for nothing). With ``by`` linked are pairs of
    classes, values of that column of items: all members of the two are linked, and those of a class with one another if it is in a pair with
    itself. No link of items is then formed or stored.

    Items that links and keys join, over any number of steps, are read by one task in their order; others by other tasks."""
    name = F.when(F.col(key).cast("string") != "", F.col(key).cast("string")) if key else F.lit(None).cast("string")
    own = [F.col(by).alias("class")] if by else []
    order = kept(numbered(items.select("id", "frequency", name.alias("key"), *own), [F.desc("frequency"), F.asc("id")], name="r").drop("frequency"), "order")
    one = linked.select("a", "b")
    if not by:
        order, ranks = order.withColumn("class", F.col("r")), order.select("id", "r")
        one = one.where("a <> b").join(ranks.select(F.col("id").alias("a"), F.col("r").alias("x")), "a") \
            .join(ranks.select(F.col("id").alias("b"), F.col("r").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = kept(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    near = links.groupBy(F.col("a").alias("class")).agg(F.collect_list("b").alias("near"))
    node = lambda kind, c: F.xxhash64(F.lit(kind), c)
    rows = order.join(near, "class", "left").withColumn("node", F.when(F.col("near").isNotNull(), node("class", "class")).when(F.col("key").isNotNull(), node("key", "key")).otherwise(node("r", "r")))
    n = order.count()
    if n <= BATCH:
        rows = rows.withColumn("g", F.lit(0))
    else:
        # Equal hashes only let two components take turns in one task.
        edges = (rows.where("near is not null and key is not null").select(F.col("node").alias("a"), node("key", "key").alias("b"))
                 .unionByName(links.where("a <> b").select(node("class", "a").alias("a"), node("class", "b").alias("b"))).distinct())
        rows = rows.join(_components(edges), "node", "left").withColumn("g", F.coalesce("component", "node"))
    rows = dealt(rows.select("g", "r", "id", "key", "class", "near"), n, "g").sortWithinPartitions("g", "r")
    kind = items.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_in_order(most), f"id {kind}, seed {kind}")


def complete(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, cluster): clusters merge while every pair across them is in ``pairs`` (a, b, similarity; each pair
    once), closest first by the least similarity across, ties by the least ids; a cluster is named by its least id.

    ids: id. Two clusters that are each other's best merge, all such pairs of a round at a time: complete
    linkage lets no merge bring anything closer, so the order of merges does not matter. What is kept is a
    row for each pair of clusters that may still merge, never more than there were pairs."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = kept(pairs.where("a <> b").select(low.alias("a"), high.alias("b"), F.round("similarity", 9).alias("s")).groupBy("a", "b").agg(F.max("s").alias("s")), "pairs")
    member = kept(ids.select("id", F.col("id").alias("cluster")).distinct(), "members")
    while not now.isEmpty():
        # Ties are settled by the least, then the other id, on both sides alike.
        both = now.select("a", "b", F.struct((-F.col("s")).alias("s"), "a", "b").alias("o"))
        best = both.select(F.col("a").alias("c"), "o").unionByName(both.select(F.col("b").alias("c"), "o")).groupBy("c").agg(F.min("o").alias("o"))
        merged = kept(best.groupBy("o").agg(F.count("*").alias("n")).where("n = 2").select(F.col("o.b").alias("old"), F.col("o.a").alias("new")), "merged")
        to = merged.select(F.col("old").alias("k"), F.col("new").alias("to"))
        parts = merged.select(F.col("new").alias("k"), F.lit(2).alias("n"))
        moved = (now.join(to.select(F.col("k").alias("a"), F.col("to").alias("ta")), "a", "left").join(to.select(F.col("k").alias("b"), F.col("to").alias("tb")), "b", "left")
                 .select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "s").where("x <> y")
                 .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("s").alias("s"), F.count("*").alias("held")))
        whole = (moved.join(parts.select(F.col("k").alias("a"), F.col("n").alias("na")), "a", "left").join(parts.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b", "left")
                 .where(F.col("held") == F.coalesce("na", F.lit(1)) * F.coalesce("nb", F.lit(1))))
        old, now = now, kept(whole.select("a", "b", "s"), "pairs")
        dropped(old)
        old, member = member, kept(member.join(to, F.col("cluster") == F.col("k"), "left").select("id", F.coalesce("to", "cluster").alias("cluster")), "members")
        dropped(old)
        dropped(merged)
    return member
