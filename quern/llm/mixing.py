"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate in [0, cap]. Among all rates that give a source its target number
of tokens, the ones of least relative entropy to "every document once" are exponentially
tilted: rate = min(cap, exp(t * c)), c being the document's size in units of its source's
mean size. The one unknown per source, the tilt t, is the zero of the gradient of the convex dual,
sum n c min(cap, exp(t c)) - target / mean, and is found by Newton steps that all sources
take at once, each step one aggregation over the histogram of (source, size); a bracket
turns a step that leaves it into a bisection.

Rates become copies in two steps without a random draw. Within a source, from the largest
size down, the number of extra copies of each histogram cell is the integer that keeps the
running error least; then the documents of a cell that get one more copy are spread over
hash-ordered buckets in proportion. Both depend on the input only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, free, staged

WEIGHTS = (5, 2, 1)
#: Documents of one (source, size) cell that share a bucket when copies are dealt out.
BUCKET = 128
MOST_BUCKETS = 4096
#: Cells of a source that are folded together; the lists that a fold copies stay this short.
CHUNK = 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """source, source_size -> also weight and target. Sources by code point, null last, get
    the weights in turn. Targets share the whole by weight and stop at cap * source_size;
    what is over goes to the others by weight (the water level of the sorted ratios)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    most = F.col("source_size") * cap
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum(most).over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") > most)
    final = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(every)["level"]
    return levels.withColumn("water", final).select(
        "source", "source_size", "weight", F.coalesce(F.least(most, F.col("water") * F.col("weight")), most).alias("target"))


def tilts(cells: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-9) -> DataFrame:
    """source -> tilt, null where every document has the rate cap or the source is empty.

    cells: source, c (size over mean), n. goals: source, goal (target over mean). After a dozen
    steps every third one halves the bracket, so all sources end: at the tolerance, or where no number is
    left between the ends of the bracket."""
    span = cells.where("c > 0").groupBy("source").agg(F.min("c").alias("least"), F.sum(F.col("n") * F.col("c")).alias("whole"))
    state = (goals.join(span, F.equal_null(goals["source"], span["source"])).drop(span["source"])
             .where((F.col("goal") > 0) & (F.col("goal") < F.col("whole") * cap * (1 - 1e-12)))
             .select("source", "goal", (F.least(F.log(F.col("goal") / F.col("whole")), F.lit(0.0)) / F.col("least")).alias("lo"),
                     (F.log(F.lit(cap)) / F.col("least")).alias("hi"))
             .withColumn("tilt", F.lit(0.0)).withColumn("done", F.lit(False)))
    # One small row a source: a file or two, not one for each shuffle partition and step.
    files = max(1, -(-goals.count() // 200_000))
    state = staged(state.coalesce(files), "tilts")
    turn = 0
    while True:
        turn += 1
        rate = F.least(F.lit(cap), F.exp(F.least(F.col("tilt") * F.col("c"), F.lit(50.0))))
        keyed = state.select(F.col("source").alias("s"), "tilt")
        sums = (cells.join(keyed, F.equal_null(cells["source"], keyed["s"]))
                .groupBy("source").agg(F.sum(F.col("n") * F.col("c") * rate).alias("g"),
                                       F.sum(F.when(rate < cap, F.col("n") * F.col("c") * F.col("c") * rate).otherwise(0.0)).alias("h"))
                .withColumnRenamed("source", "k"))
        over = F.col("g") > F.col("goal")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("hi"))
        narrow = F.col("hi2") - F.col("lo2") <= 4e-16 * F.greatest(F.abs("lo2"), F.abs("hi2"))
        done = (F.abs(F.col("g") / F.col("goal") - 1) < tolerance) | narrow
        newton = (F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2")) & F.lit(turn < 12 or turn % 3 != 0)
        moved = (state.join(sums, F.equal_null(state["source"], sums["k"]))
                 .withColumn("lo2", lo).withColumn("hi2", hi)
                 .withColumn("step", F.col("tilt") + (F.col("goal") - F.col("g")) / F.nullif(F.col("h"), F.lit(0.0)))
                 .select("source", "goal", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                         F.when(done, F.col("tilt")).when(newton, F.col("step")).otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("tilt"), done.alias("done")))
        before, state = state, staged(moved.coalesce(files), "tilts")
        discard(before)
        if state.where("not done").limit(1).count() == 0:
            break
    return state.select("source", "tilt")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """For each row of docs (doc_id, text, source): doc_id, source, size, source_size, target,
    rate double, copies long.

    Size is the number of words between ASCII white space; a null or empty text has size 0,
    rate 1 and one copy. No document gets more than ``cap`` copies. A null source is a source
    like any other, the last in order. Rows that repeat a doc_id are documents of their own;
    ties between them are broken by nothing that shows, for they are alike. A null doc_id is
    allowed. Extra columns are ignored; an empty table gives an empty result."""
    sized = staged(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("salt")), "sizes")
    cells = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goals = staged(targets(sources.select("source", "source_size"), weights, float(cap)), "targets")
    scale = staged(sources.join(goals.select(F.col("source").alias("k"), "target"), F.equal_null("source", "k"))
                   .select("source", "source_size", "target", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-300)).alias("mean")), "scale")
    scaled = cells.join(scale.withColumnRenamed("source", "k"), F.equal_null("source", "k")).drop("k")
    relative = scaled.select("source", (F.col("size") / F.col("mean")).alias("c"), "n")
    tilt = tilts(relative, scale.select("source", (F.col("target") / F.col("mean")).alias("goal")), float(cap))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)) \
        .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = (scaled.join(tilt.withColumnRenamed("source", "k"), F.equal_null("source", "k"), "left").drop("k")
             .withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("long")))
    # One row of a source here stands for all its documents of one size. A cell at a whole
    # rate takes no extra copy, so it does not carry the error either.
    fold = F.sort_array(F.collect_list(F.struct("size", "n", "rate", "whole")), asc=False)
    none = "cast(array() as array<struct<size:bigint,extra:bigint>>)"
    skip = "x.size = 0 or x.rate = x.whole"
    more = "least(x.n, greatest(0L, cast(round(a.e / x.size + x.n * (x.rate - x.whole)) as bigint)))"
    step = f"""aggregate(
        transform(sequence(0, (size(cells) - 1) div {CHUNK}), k -> slice(cells, k * {CHUNK} + 1, {CHUNK})),
        named_struct('e', 0.0D, 'out', cast(array() as array<array<struct<size:bigint,extra:bigint>>>)),
        (b, part) -> aggregate(part, named_struct('e', b.e, 'out', {none}),
          (a, x) -> named_struct(
            'e', a.e + if({skip}, 0.0D, x.n * (x.rate - x.whole) * x.size - x.size * {more}),
            'out', concat(a.out, array(named_struct('size', x.size, 'extra', if({skip}, 0L, {more}))))),
          r -> named_struct('e', r.e, 'out', concat(b.out, array(r.out)))))"""
    extra = (rated.groupBy("source").agg(fold.alias("cells")).select("source", F.explode(F.flatten(F.expr(step)["out"])).alias("x"))
             .select(F.col("source").alias("k"), F.col("x.size").alias("z"), "x.extra"))
    plan = staged(rated.join(extra, F.equal_null("source", "k") & (F.col("size") == F.col("z"))).drop("k", "z")
                  .withColumn("buckets", F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("n") / BUCKET)).cast("int"))
                  .select(F.col("source").alias("k"), F.col("size").alias("z"), "n", "source_size", "target", "rate", "whole", "extra", "buckets"), "plan")
    dealt = (sized.join(plan, F.equal_null("source", "k") & (F.col("size") == F.col("z"))).drop("k", "z")
             .withColumn("bucket", F.pmod("salt", "buckets").cast("int")))
    cell = ["source", "size", "bucket"]
    held = dealt.where("extra > 0 and extra < n").groupBy(*cell).agg(F.count("*").alias("m"), F.first("n").alias("all_n"), F.first("extra").alias("x"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket"))
    share = (held.withColumn("upto", upto)
             .withColumn("take", F.floor(F.col("upto") * F.col("x") / F.col("all_n")) - F.floor((F.col("upto") - F.col("m")) * F.col("x") / F.col("all_n")))
             .select(F.col("source").alias("k"), F.col("size").alias("z"), F.col("bucket").alias("y"), "take"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("salt", "doc_id"))
    partly = (dealt.where("extra > 0 and extra < n").withColumn("rank", rank)
              .join(share, F.equal_null("source", "k") & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("y"))).drop("k", "z", "y")
              .withColumn("copies", F.col("whole") + (F.col("rank") <= F.col("take")).cast("long")))
    wholly = dealt.where("extra = 0 or extra = n").withColumn("copies", F.col("whole") + (F.col("extra") > 0).cast("long"))
    wanted = ["doc_id", "source", "size", "source_size", "target", "rate", "copies", "salt"]
    return partly.select(wanted).unionByName(wholly.select(wanted))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies, rate."""
    return copies(docs, weights, cap).select("doc_id", "size", "source_size", "target",
                                             (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the columns stay as they are.
    Rows that repeat both doc_id and text are taken equally often, as the most taken of them."""
    salt, key, doc, times, copy = free(docs, "__salt", "__key", "__id", "__copies", "__copy")
    dealt = copies(docs, weights, cap).groupBy("doc_id", "salt").agg(F.max("copies").alias(times))
    joined = docs.withColumn(salt, F.xxhash64("doc_id", "text")).join(
        dealt.select(F.col("doc_id").alias(doc), F.col("salt").alias(key), times), F.equal_null("doc_id", doc) & (F.col(salt) == F.col(key)))
    return (joined.where(F.col(times) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns))
