"""What the training-data operators share: staged tables, text helpers, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one
    machine (master local) that lacks the setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-"))
    return context.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back. This cuts lineage in
    a way that survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes the table behind a result of ``staged`` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_staged"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_classes(rows: DataFrame, classes: DataFrame, key: list[str], size: str) -> DataFrame:
    """rows left-joined by key with classes, which has one row a key; ``size`` is its number of rows.

    Classes of a hundred-thousandth of all rows or more, at most 100,000 of them, are
    broadcast, so that no task gets all rows of one; the others are joined by their key."""
    total, largest = classes.agg(F.sum(size), F.max(size)).first()
    hot = max(10_000, (total or 0) // 100_000)
    if (largest or 0) < hot:
        return rows.join(classes, key, "left")
    large = F.broadcast(classes.where(F.col(size) >= hot))
    rest = rows.join(large, key, "left_anti").join(classes.where(F.col(size) < hot), key, "left")
    return rows.join(large, key).unionByName(rest)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's 10,000, unless the session says otherwise: a
    row here is a whole text, and batches bound the memory of JVM and Python workers alike (so do the
    64 MB of a batch that Spark sets by default)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def ascii_lower(text: str) -> str:
    """text with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with derived ones."""
    text_batches(df.sparkSession)
    return df.select(*[F.col(n) for n in names])


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants) over uint64."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) reduced to one edge from each node to the least node that it reaches
    over them; self edges vanish."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(batches):
    import pandas as pd

    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for pdf in batches:
        a, b = np.concatenate([a, pdf["a"].to_numpy()]), np.concatenate([b, pdf["b"].to_numpy()])
        if len(a) > 2_000_000:
            keep = len(a)
            a, b = forest(a, b)
            if len(a) > keep // 2:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = forest(a, b)
    if len(a):
        yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long). Returns (node, component) for every node
    of an edge, component being the least node reachable.

    Alternating large-star and small-star rounds, each a pre-aggregated minimum joined
    back to the edges; every partition first contracts its own edges to a forest. Each
    round's edges are a table in the shared folder; the driver sees two sums."""
    two = "a long, b long"
    now = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                 .where("a is not null and b is not null and a <> b").mapInPandas(_contracted, two), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b"))
        before, now = now, staged(small.where("a <> b").distinct(), "edges")
        discard(before)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class BitTable:
    """A bit table of a column of 64-bit hashes, two bits each, of at most 2^most bits, for all executors."""

    def __init__(self, df: DataFrame, column: str, most: int):
        self.bits = int(min(most, max(20, (16 * df.count()).bit_length())))
        place = [F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1)),
                 F.shiftrightunsigned(column, 64 - self.bits).bitwiseAND(F.lit((1 << self.bits) - 1))]
        # At most 2^bits / 64 rows reach the driver, whatever the input.
        cells = (df.select(F.explode(F.array(*place)).alias("p")).groupBy(F.shiftright("p", 6).alias("cell"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("set")).toPandas())
        table = np.zeros(1 << (self.bits - 6), np.uint64)
        table[cells["cell"].to_numpy()] = cells["set"].to_numpy().astype(np.int64).view(np.uint64)
        self.spread = df.sparkSession.sparkContext.broadcast(table)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        table, mask = self.spread.value, np.uint64((1 << self.bits) - 1)
        out = np.ones(len(hashes), bool)
        for p in (hashes & mask, (hashes >> np.uint64(64 - self.bits)) & mask):
            out &= ((table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out
