"""Similarity grouping: blocked pairs, contradictions, medoids, components; linkage.py has greedy groups and complete linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as v
from quern.session import kept

#: Members of a class that are paired in one task; others are tiles of their own.
TILE = 256
NEGATION = r"\b(?:not|no|never|cannot|без|не|нет)\b"


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""))


def _near(t: DataFrame, threshold: float, shared: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of items with ``block`` and ``t``, the sorted terms: the classes (h, class, tiles, members) of equal block and terms, how their members
    are dealt, and the near ones (ca, cb, ia, ib, n_shared, jaccard), each two once, with itself if it has two members."""
    dealt = t.groupBy("block", "t").agg(F.expr(f"cast(ceil(count(*) / {TILE}) as int)").alias("tiles"), F.count("*").alias("members"))
    classes = kept(dealt.withColumn("class", F.struct("block", "t")).select(F.xxhash64("block", "t").alias("h"), "class", "tiles", "members"), "classes")
    terms = classes.select("class", "h", "tiles", "members", F.col("class.block").alias("block"), F.size("class.t").alias("n"), F.explode("class.t").alias("term"))
    x = terms.select("block", "term", F.col("class").alias("ca"), F.col("h").alias("ha"), F.col("tiles").alias("ia"), F.col("members").alias("ma"), F.col("n").alias("na"))
    y = terms.select("block", "term", F.col("class").alias("cb"), F.col("h").alias("hb"), F.col("tiles").alias("ib"), F.col("n").alias("nb"))
    # Every two classes once; a class of one member has no pair of its own.
    both = x.join(y, ["block", "term"]).where("ha < hb or (ha = hb and (ca < cb or (ca = cb and ma > 1)))")
    both = both.groupBy("ca", "cb", "ia", "ib", "na", "nb").agg(F.count("*").alias("n_shared"))
    j = F.col("n_shared") / (F.col("na") + F.col("nb") - F.col("n_shared"))
    near = both.where(F.col("n_shared") >= shared).withColumn("jaccard", j).where(F.col("jaccard") >= threshold)
    return classes, dealt, kept(near.select("ca", "cb", "ia", "ib", "n_shared", "jaccard"), "near")


def _termed(items: DataFrame, block: str, *columns) -> DataFrame:
    return items.select(*columns, F.col(block).alias("block"), F.array_sort(tokens(F.col("title"))).alias("t"))


def alike(items: DataFrame, block: str, threshold: float = 0.3, shared: int = 2) -> tuple[DataFrame, DataFrame]:
    """What ``pairs`` says of items, by classes: items with ``class``, the number of their block and terms (null without either), and the
    near classes (a, b), once each; a class is in a pair with itself if its members are pairs. No pair of items is formed."""
    t = _termed(items, block, F.struct(*items.columns).alias("item"))
    classes, _, near = _near(t.where("block is not null and size(t) > 0"), threshold, shared)
    number = kept(classes.select("class", F.monotonically_increasing_id().alias("number")), "numbers")
    side = lambda c, as_: number.select(F.col("class").alias(c), F.col("number").alias(as_))
    linked = near.join(side("ca", "a"), "ca").join(side("cb", "b"), "cb").select("a", "b")
    held = number.select(F.col("class.block").alias("block"), F.col("class.t").alias("t"), F.col("number").alias("class"))
    return t.join(held, ["block", "t"], "left").select("item.*", "class"), linked


def pairs(items: DataFrame, block: str, threshold: float = 0.3, shared: int = 2, carried: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, n_shared, jaccard) for a < b in one block with enough shared terms, and of both sides the columns
    ``carried``, as a_name and b_name. items: id (unique), block, title.

    Titles of equal terms in a block are one class. Pairs of classes come from an equality join on block and term,
    counted; their members are dealt into tiles and paired as the result is read, never shuffled as pairs."""
    t = _termed(items, block, F.struct("id", *carried).alias("item")).where("block is not null and size(t) > 0")
    _, dealt, near = _near(t, threshold, shared)
    tile = (t.join(dealt.select("block", "t", "tiles"), ["block", "t"]).groupBy(F.struct("block", "t").alias("class"), F.expr("pmod(xxhash64(item.id), tiles)").alias("tile"))
            .agg(F.collect_list("item").alias("items")))
    tile = kept(tile, "tiles")
    side = lambda c, i, as_: tile.select(F.col("class").alias(c), F.col("tile").alias(i), F.col("items").alias(as_))
    met = near.select("ca", "cb", "n_shared", "jaccard", F.explode(F.expr("sequence(0L, ia - 1L)")).alias("i"), "ib").withColumn("j", F.explode(F.expr("sequence(0L, ib - 1L)"))).where("ca <> cb or i <= j")
    n = met.count()
    met = met.join(side("ca", "i", "xs"), ["ca", "i"]).join(side("cb", "j", "ys"), ["cb", "j"]).withColumn("own", F.expr("ca = cb and i = j"))
    met = met.select("n_shared", "jaccard", "own", "xs", "ys").repartition(max(8, min(4096, n // 8)))
    one = met.select("n_shared", "jaccard", "own", "ys", F.explode("xs").alias("x")).select("n_shared", "jaccard", "own", "x", F.explode("ys").alias("y"))
    one = one.where("x.id <> y.id and (not own or x.id < y.id)").withColumn("swap", F.expr("x.id > y.id"))
    low, high = (lambda c: F.when(F.col("swap"), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}"))), (lambda c: F.when(F.col("swap"), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")))
    extra = [f(c).alias(f"{name}_{c}") for c in carried for name, f in (("a", low), ("b", high))]
    return one.select(low("id").alias("a"), high("id").alias("b"), "n_shared", "jaccard", *extra)


def contradictions(claims: DataFrame) -> DataFrame:
    """(key, n_plain, n_negated): claims (id, text) that are equal without negation words, some negated and some not."""
    negated = F.lower("text").rlike(NEGATION)
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), NEGATION, " "), r"\s+", " "))
    g = claims.groupBy(key.alias("key")).agg(F.count_if(~negated).alias("n_plain"), F.count_if(negated).alias("n_negated"))
    return g.where("n_plain > 0 and n_negated > 0")


def medoids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster, medoid, size): the member with the largest sum of cosines to its cluster,
    which is its dot product with the sum of the cluster's unit vectors. vectors: id, vector."""
    u = members.join(vectors, "id").select("cluster", "id", v.unit(F.col("vector")).alias("u"))
    total = (u.select("cluster", F.posexplode("u").alias("k", "x")).groupBy("cluster", "k").agg(F.sum("x").alias("x"))
             .groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("s")))
    scored = u.join(total, "cluster").select("cluster", "id", F.round(v.dot(F.col("u"), F.col("s")), 9).alias("d"))
    return scored.groupBy("cluster").agg(F.max_by("id", F.struct("d", -F.col("id"))).alias("medoid"), F.count("*").alias("size"))


def match_score(same_key: Column, models: Column, families: Column, jaccard: Column) -> Column:
    """.50 for the same key, +.28 / -.18 for shared / disjoint models, .12 for shared families, .40 of the overlap."""
    return F.round(F.when(same_key, 0.5).otherwise(0.0) + F.when(models, 0.28).otherwise(-0.18) + F.when(families, 0.12).otherwise(0.0) + 0.4 * jaccard, 4)


def label_components(edges: DataFrame) -> DataFrame:
    """(node, component): least node reachable over edges (a, b). Large-star and small-star
    rounds, until no edge changes; long chains need a number of rounds that grows with their logarithm."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).where("node is not null").distinct()
    now = edges.select("a", "b").where("a <> b").distinct().checkpoint()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        down = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        now = down.join(least, "a").select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct().checkpoint()
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
        seen = sums


def vote_errors(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, error): each row must be in exactly one cluster, once: repeated, missing or unknown ids. members: cluster, id; rows: id."""
    n = members.groupBy("id").agg(F.count("*").alias("n"))
    j = n.join(rows.select("id").distinct().withColumn("known", F.lit(True)), "id", "full")
    error = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return j.select("id", error.alias("error")).where("error is not null")
