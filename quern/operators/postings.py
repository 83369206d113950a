"""A stored posting index with block maxima, and top-k retrieval that reads only blocks that can matter.

Rows are dealt into segments of similar length (and cluster); a posting block is what one
segment holds of one token, with the largest weight in it. Blocks are Parquet rows under a
bucket of their token, so questions read the buckets of their tokens only, and bounds are
computed from the small columns before any posting is read. A segment is scored only if the
sum of its blocks' maxima can reach the k-th best score found so far; nothing is lost.
The blocks of a segment that questions ask for meet in one task, which adds them up as matrices; no hit is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import kept

#: What sums of weights may differ by for their order of addition; also more than ranks are rounded by.
SLACK = 1e-6
#: Asked (question, token) rows up to which they are broadcast.
MOST_ASKED = 200_000
#: Numbers of a matrix of questions and rows or tokens of a segment, and rows' tokens of a task that writes blocks.
CELLS, POSTINGS = 1 << 20, 2_000_000


def build(rows: DataFrame, path: str, segment_rows: int = 256, buckets: int = 32, files: int = 4) -> "Index":
    """Writes the index of rows (id, size, cluster, tokens: array of (token, weight)) under ``path``. Each token
    must be in a row's array once. ``size`` puts rows of like length together, ``cluster`` (a string, may be
    null) rows of like words; both only help the bounds. Segments are dealt over ``files`` tasks at least, and each
    writes its part of every bucket, so that a token of all segments is no single task's."""
    level = F.floor(2 * F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")
    # A level holds so many segments as its rows need; there are few levels and clusters.
    slot = F.struct(F.coalesce("cluster", F.lit("")).alias("cluster"), level.alias("level"))
    placed = rows.select("id", "tokens", slot.alias("slot"))
    sizes = placed.groupBy("slot").agg(F.ceil(F.count("*") / segment_rows).cast("int").alias("parts"), F.sum(F.size("tokens")).alias("held"))
    counts = kept(sizes, "sizes")
    n = counts.agg(F.sum("held")).first()[0] or 0
    segment = F.xxhash64("slot", F.expr("pmod(xxhash64(id), parts)"))
    # Rows are dealt whole and by segment, so a segment's blocks are made in one task and nothing else is shuffled.
    dealt = placed.join(F.broadcast(counts), "slot").select("id", segment.alias("segment"), "tokens").repartition(max(2 * files, -(-n // POSTINGS)), "segment")
    ids = rows.schema["id"].dataType.simpleString()
    blocks = dealt.groupBy("segment").applyInArrow(_blocks, f"token string, segment long, most double, postings array<struct<id:{ids},weight:double>>")
    bucket = F.expr(f"cast(pmod(xxhash64(token), {buckets}) as int)")
    blocks.withColumn("bucket", bucket).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)
    return Index(rows.sparkSession, path, buckets)


class Index:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.blocks, self.buckets = spark.read.parquet(path), buckets

    def _joined(self, asked: DataFrame, columns: list[str], on: list[str]) -> DataFrame:
        """Blocks of asked tokens, from the buckets of those tokens: their numbers, ``buckets`` at most, go into the scan."""
        wanted = asked.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(token), {self.buckets}) as int)"))
        n, found = wanted.agg(F.count("*"), F.collect_set("bucket")).first()
        if n <= MOST_ASKED:
            wanted = F.broadcast(wanted)
        read = self.blocks.where(F.col("bucket").isin(found) if found else F.lit(False))
        return read.select("bucket", "token", "segment", *columns).join(wanted, ["bucket", "token", *on]).drop("bucket")

    def bounds(self, asked: DataFrame, every: bool = False) -> DataFrame:
        """(qid, segment, bound, held): what a row of a segment can reach at most, and how many asked tokens the segment holds.
        asked: qid, token, boost (a token counts boost times its weight), n (tokens of the question). With ``every`` only
        segments that hold all tokens."""
        found = self._joined(asked, ["most"], []).groupBy("qid", "segment", "n").agg(F.sum(F.col("most") * F.col("boost")).alias("bound"), F.count("*").alias("held"))
        return found.where("held = n").drop("n") if every else found.drop("n")

    def scores(self, asked: DataFrame, segments: DataFrame, every: bool = False, k: int | None = None, key: Callable | None = None) -> DataFrame:
        """(qid, id, score, held) of the rows of segments (qid, segment, and floor, a score below which rows are left out). With ``k``
        only what can be among a question's k best, by ``key`` of the arrays (score, n), the score to 9 digits if not given, then by id."""
        if "floor" not in segments.columns:
            segments = segments.withColumn("floor", F.lit(None).cast("double"))
        few = asked.limit(MOST_ASKED + 1).toPandas()
        if len(few) <= MOST_ASKED:
            return self._added(few, segments, every, k, key or (lambda score, n: np.floor(score * 1e9 + 0.5)), asked.schema["qid"].dataType.simpleString())
        blocks = self._joined(asked.join(segments.select("qid", "segment"), "qid"), ["postings"], ["segment"])
        hits = blocks.select("qid", "n", "boost", F.explode("postings").alias("p")).groupBy("qid", "n", F.col("p.id").alias("id")).agg(
            F.sum(F.col("p.weight") * F.col("boost")).alias("score"), F.count("*").alias("held"))
        return hits.where("held = n").drop("n") if every else hits.drop("n")

    def _added(self, few: pd.DataFrame, segments: DataFrame, every: bool, k: int | None, key: Callable, qid: str) -> DataFrame:
        spark = segments.sparkSession
        tokens = spark.createDataFrame([(t,) for t in few["token"].dropna().unique().tolist()], "token string").withColumn("bucket", F.expr(f"cast(pmod(xxhash64(token), {self.buckets}) as int)"))
        found = [r[0] for r in tokens.select("bucket").distinct().collect()]
        read = self.blocks.where(F.col("bucket").isin(found) if found else F.lit(False)).select("bucket", "token", "segment", "postings")
        # Renamed, as segments may come from the same blocks.
        asked = segments.select(F.col("segment").alias("segment"), F.col("qid").alias("qid"), F.col("floor").cast("double").alias("floor"))
        blocks = read.join(F.broadcast(tokens), ["bucket", "token"], "left_semi").join(asked.select("segment").distinct(), "segment", "left_semi").select(F.col("segment").alias("segment"), "token", "postings")
        ids = self.blocks.schema["postings"].dataType.elementType["id"].dataType.simpleString()
        return blocks.groupBy("segment").cogroup(asked.groupBy("segment")).applyInArrow(_sums(few, every, k, key), f"qid {qid}, id {ids}, score double, held long")

    def plan(self, asked: DataFrame, k: int, every: bool = False, probe: int = 2, capped: Column | None = None, key: Callable | None = None) -> DataFrame:
        """(qid, segment, bound, floor): the segments that can hold one of a question's k best rows. The ``probe`` segments
        of the largest bounds are scored first; ``floor`` is the k-th best score in them. ``capped`` is the
        ranking score as a function of the sum ``score``, if that is another one."""
        bound = kept(self.bounds(asked, every), "bounds")
        first = bound.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment"))).where(F.col("place") <= probe)
        final = capped if capped is not None else F.col("score")
        scored = self.scores(asked, first, every, k if capped is None else None, key).withColumn("final", final)
        ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final")))).where(F.col("place") <= k)
        floor = ranked.groupBy("qid").agg(F.when(F.count("*") == k, F.min("final")).alias("floor"))
        limit = bound.withColumnRenamed("bound", "score").withColumn("final", final).withColumnRenamed("score", "bound")
        return limit.join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("final") >= F.col("floor") - SLACK)).select("qid", "segment", "bound", "floor")

    def best(self, asked: DataFrame, k: int, every: bool = False, probe: int = 2, capped: Column | None = None, key: Callable | None = None) -> DataFrame:
        """(qid, id, score, held): every row that can be among a question's k best, with its exact sum; the caller ranks them, by ``key`` as in scores, then by id."""
        asked = kept(asked, "asked")
        plan = self.plan(asked, k, every, probe, capped, key)
        return self.scores(asked, plan if capped is None else plan.drop("floor"), every, k if capped is None else None, key)


def _blocks(rows: pa.Table) -> pa.Table:
    """A row for each token of a segment: its largest weight and its postings."""
    tokens = rows.column("tokens").combine_chunks()
    flat = tokens.flatten()
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))
    words = flat.field("token").dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(words.dictionary)))
    weight = flat.field("weight").to_numpy(zero_copy_only=False)[order]
    ids = rows.column("id").combine_chunks().take(pa.array(row[order]))
    postings = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.StructArray.from_arrays([ids, pa.array(weight)], ["id", "weight"]))
    most = np.maximum.reduceat(weight, starts) if len(starts) else np.empty(0)
    segment = pa.array(np.full(len(starts), rows.column("segment")[0].as_py(), np.int64))
    return pa.table({"token": words.dictionary, "segment": segment, "most": most, "postings": postings})


def lexical_key(score: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The order of scores over the root of the question's tokens, to 9 digits."""
    return np.floor(score / np.sqrt(n) * 1e9 + 0.5)


def _sums(few: pd.DataFrame, every: bool, k: int | None, key: Callable):
    few = few.dropna(subset=["qid", "token"]).sort_values("qid", kind="stable")
    words = few["token"].drop_duplicates().to_numpy()
    code, boost = pd.Index(words).get_indexer(few["token"]), few["boost"].to_numpy(dtype=float)
    qids, first = np.unique(few["qid"].to_numpy(), return_index=True)
    n_q, first = few["n"].to_numpy(dtype=float)[first], np.append(first, len(few))

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(blocks) and len(asked):
            held = blocks.column("postings").combine_chunks()
            posting = held.flatten()
            ids, row = np.unique(posting.field("id").to_numpy(zero_copy_only=False), return_inverse=True)
            token = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
            weight, there = np.zeros((len(held), len(ids))), np.zeros((len(held), len(ids)))
            there[token, row], weight[token, row] = 1, posting.field("weight").to_numpy(zero_copy_only=False)
            place = np.full(len(words), -1)
            place[pc.index_in(blocks.column("token").combine_chunks(), pa.array(words, pa.string())).to_numpy(zero_copy_only=False)] = np.arange(len(held))
            who = np.searchsorted(qids, asked.column("qid").to_numpy())
            floor = asked.column("floor").fill_null(-np.inf).to_numpy() - SLACK
            step = max(1, CELLS // max(len(held), len(ids)))
            for at in range(0, len(who), step):
                some = who[at: at + step]
                n = first[some + 1] - first[some]
                pairs = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                q, to = np.repeat(np.arange(len(some)), n), place[code[pairs]]
                counts = np.zeros((len(some), len(held)))
                counts[q[to >= 0], to[to >= 0]] = boost[pairs][to >= 0]
                score, shared = counts @ weight, (counts != 0).astype(float) @ there
                fits = (shared > 0) & (score >= floor[at: at + step, None])
                i, j = np.nonzero(fits & (shared == n_q[some, None]) if every else fits)
                if k is not None:
                    order = np.lexsort((ids[j], -key(score[i, j], n_q[some[i]]), i))
                    i, j = i[order], j[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[best], j[best]
                out.append((qids[some[i]], ids[j], score[i, j], shared[i, j].astype(np.int64)))
        if not out:
            return pa.table({"qid": pa.array([], asked.schema.field("qid").type), "id": pa.array([], blocks.schema.field("postings").type.value_type.field("id").type),
                             "score": pa.array([], pa.float64()), "held": pa.array([], pa.int64())})
        qid, id_, score, shared = map(np.concatenate, zip(*out))
        return pa.table({"qid": pa.array(qid, asked.schema.field("qid").type), "id": pa.array(id_), "score": score, "held": shared})

    return run


def lexical_rows(rows: DataFrame, tokens: Column, cluster: Column, entity: Column | None = None) -> DataFrame:
    """Rows for ``build`` from (id, ...): each distinct token weighs 1 / sqrt(tokens of the row); an entity name is a
    token of its own kind, of weight 1."""
    held = rows.select("id", F.array_distinct(tokens).alias("t"), cluster.alias("cluster"), (entity if entity is not None else F.lit(None).cast("string")).alias("e"))
    # Written, so that the tokens of a text are made once and not for each of their uses.
    held = kept(held, "tokens").where("size(t) > 0")
    weight = F.lit(1.0) / F.sqrt(F.size("t").cast("double"))
    words = F.transform("t", lambda x: F.struct(x.alias("token"), weight.alias("weight")))
    name = F.array(F.struct(F.concat(F.lit("\0"), "e").alias("token"), F.lit(1.0).alias("weight")))
    return held.select("id", F.size("t").alias("size"), "cluster", F.when(F.col("e") != "", F.concat(words, name)).otherwise(words).alias("tokens"))


def term_rows(rows: DataFrame, words: Column, cluster: Column) -> DataFrame:
    """Rows for ``build``: each word weighs its share of the row's words."""
    held = kept(rows.select("id", F.array_sort(words).alias("s"), cluster.alias("cluster")), "words").where("size(s) > 0")
    # Equal words lie together once sorted, so a word's count is the distance between its first places.
    ordered = held.withColumn("at", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 or s[i] <> s[i - 1])"))
    shares = F.expr("transform(at, (i, k) -> struct(s[i] as token, (coalesce(get(at, k + 1), size(s)) - i) / size(s) as weight))")
    return ordered.select("id", F.size("s").alias("size"), "cluster", shares.alias("tokens"))
