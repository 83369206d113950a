"""Substring deduplication with prefix-partitioned suffix trees.

A suffix is a run of ``window`` words from one place of one document. The contract needs the
tree only down to that depth, so suffixes are cut there. Each suffix has a variable-length
prefix: its words up to the end of the least hash among its ``anchor``-word runs. That anchor
names the partition of the suffix. Equal suffixes have equal anchors, so a subtree never
spans two partitions, and neighbouring suffixes mostly share one, so a stretch of them
travels as one row.

1. Each document names its anchors; anchors of two or more documents are the live prefixes.
2. A bit table of fixed largest size holds the live prefixes. A second pass over the texts
   ships the places of the stretches of suffixes under live prefixes only. A wrong positive of
   the table ships a stretch in vain; nothing is lost.
3. Equal stretches collapse to their least document. A prefix with a single distinct stretch
   is a chain and needs no tree. For the others a third pass ships the words of one copy of
   each stretch, and prefixes are dealt into groups that fit in memory. In each group the
   suffixes are sorted by prefix doubling, which numbers the tree's nodes of depth 1, 2, 4,
   ... and ``window``; each node of full depth takes the least document below it.
4. A prefix with more stretches than a group may hold is lengthened to full depth: its suffixes
   are grouped by all their words, and the least document is a pre-aggregated minimum.
5. Neighbouring deep nodes of one document form its maximal repeats (``repeats``); documents join
   what must go, and words are cut.

Words are told apart by 64 bits, stretches and lengthened prefixes by 128.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BitTable, doc_columns, free, splitmix, staged, with_classes

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD1342543DE82EF95 | 1
_DEEP = 0xAF251AF3B0F025B5 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, _CHUNK + 4096)
        with np.errstate(over="ignore"):
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, np.uint64(b))
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
        _powers[base] = (made[0], made[1])
    return _powers[base]


def _rolling(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of values[i:i+n] for each i with enough values."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    up, down = _power(base, len(values))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
        return splitmix((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of values[i:i+n] for each i, by doubling."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    have, low = 1, values
    while have * 2 <= n:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (n - have)], low[n - have:]) if have < n else low


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of each word."""
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    up, down = _power(_BASE, len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        mixed = (sums[ends] - sums[starts]) * down[starts]
        return splitmix(mixed ^ splitmix((ends - starts).astype(np.uint64))), starts


def _chunks(texts: list[str | None]):
    """(first row, list of encoded texts) of at most about _CHUNK bytes, or one long text."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > _CHUNK:
            yield first, held
            first, held, size = row, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


class _Suffixes:
    """All full-depth suffixes of a chunk of texts: row, place, anchor hash, and the words' hashes."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        self.words, starts = _word_hashes(b"\n".join(texts))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        bounds = np.searchsorted(starts, begins)
        counts = np.diff(bounds)
        row = np.repeat(np.arange(len(texts)), counts)
        n = max(0, len(self.words) - window + 1)
        last = bounds[1:][row[:n]] if n else np.empty(0, np.int64)
        self.at = np.nonzero(np.arange(n) + window <= last)[0]
        self.row = row[self.at]
        self.place = self.at - bounds[self.row]
        grams = _rolling(self.words, anchor, _GRAM)
        self.anchor = _least(grams, window - anchor + 1)[self.at]

    def stretches(self, longest: int) -> np.ndarray:
        """Index of the first suffix of each run with one anchor in one document, in pieces of at most longest."""
        n = len(self.at)
        if not n:
            return np.empty(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])
        first = np.nonzero(new)[0]
        within = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        return np.nonzero(within % longest == 0)[0]


def _xxhash64(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs."""
    import xxhash

    data = values.astype("<i8").tobytes()
    return np.fromiter((xxhash.xxh64_intdigest(data[i: i + 8], 42) for i in range(0, len(data), 8)), np.uint64)


def _full_depth(spans: list[np.ndarray], counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, node) of each suffix of ``depth`` words, counts[k] of them from the start of span
    k. Prefix doubling: the nodes of depth 2h are the pairs of nodes of depth h at i and i + h."""
    words = np.concatenate(spans)
    lengths = np.array([len(s) for s in spans])
    begins = np.cumsum(lengths) - lengths
    rank = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    h = 1
    while h * 2 <= depth:
        # Pairs that reach over the end of a span belong to no suffix that is asked for.
        rank = np.unique((rank[:-h] << np.uint64(32)) | rank[h:], return_inverse=True)[1].astype(np.uint64)
        h *= 2
    owner = np.repeat(np.arange(len(spans)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    pair = (rank[at] << np.uint64(32)) | rank[at + depth - h]
    return owner, np.unique(pair, return_inverse=True)[1]


def removals(docs: DataFrame, window: int = 50, anchor: int = 16, most_bits: int = 28, group_rows: int = 2048) -> DataFrame:
    """(doc_id, text_hash, cuts array<struct<place, mask>>): bit i of mask says that the
    window that starts at word place + i also starts in a document with a smaller doc_id.
    Documents without cuts have no row. docs: doc_id, text."""
    longest = window - anchor + 1
    keyed = (doc_columns(docs, "doc_id", "text").where("doc_id is not null")
             .withColumn("text_hash", F.xxhash64("text")))

    def anchors(batches):
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            for first, texts in _chunks(pdf["text"].tolist()):
                s = _Suffixes(texts, window, anchor)
                at = s.stretches(1 << 62)
                if len(at):
                    yield pd.DataFrame({"anchor": s.anchor[at].view(np.int64), "doc_id": ids[first + s.row[at]]})

    live = staged(keyed.select("doc_id", "text").mapInPandas(anchors, "anchor long, doc_id long")
                  .groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                  .where("low < high").select("anchor"), "prefixes")
    prefixes = BitTable(live, "anchor", most_bits)

    def cut(batches, keep):
        """Chunks of texts with their suffixes, the stretches that keep(suffixes, begins, ids) marks, and their ends and hashes."""
        for pdf in batches:
            ids, hashes = pdf["doc_id"].to_numpy(), pdf["text_hash"].to_numpy()
            for first, texts in _chunks(pdf["text"].tolist()):
                s = _Suffixes(texts, window, anchor)
                at = s.stretches(longest)
                live_ = keep(s, at) if len(at) else np.empty(0, bool)
                if not live_.any():
                    continue
                ends = np.append(at[1:], len(s.at))
                deep = _rolling(s.words, window, _DEEP)[s.at]
                with np.errstate(over="ignore"):
                    step = (np.arange(len(deep)) - np.repeat(at, ends - at)).astype(np.uint64)
                    whole = splitmix(np.add.reduceat(splitmix(deep ^ splitmix(step)), at) ^ (ends - at).astype(np.uint64))
                at, ends, whole = at[live_], ends[live_], whole[live_]
                yield s, at, ends, whole, ids[first + s.row[at]], hashes[first + s.row[at]]

    def stretches(batches):
        for s, at, ends, whole, ids, hashes in cut(batches, lambda s, at: prefixes.has(s.anchor[at])):
            yield pd.DataFrame({"anchor": s.anchor[at].view(np.int64), "whole": whole.view(np.int64), "doc_id": ids, "text_hash": hashes,
                                "place": s.place[at].astype(np.int32), "n": (ends - at).astype(np.int32)})

    found = staged(keyed.mapInPandas(stretches, "anchor long, whole long, doc_id long, text_hash long, place int, n int"), "stretches")
    distinct = found.groupBy("anchor", "whole").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("n").alias("n"), F.count("*").alias("held"))
    group = distinct.groupBy("anchor").agg(F.min("low").alias("g_low"), F.max("high").alias("g_high"), F.count("*").alias("m")).where("g_low < g_high")
    nodes = staged(distinct.join(group, "anchor").select("anchor", "whole", "low", "n", "m", "held"), "subtrees")
    chains = nodes.where("m = 1").select("anchor", "whole", "held", F.array(F.col("low")).alias("least"))
    branching = nodes.where("m > 1")
    copies = BitTable(branching.select(F.col("whole").bitwiseXOR(F.xxhash64("low")).alias("key")), "key", most_bits)

    def spans(batches):
        def chosen(s, at):
            return prefixes.has(s.anchor[at])

        for s, at, ends, whole, ids, _ in cut(batches, chosen):
            one = copies.has(whole ^ _xxhash64(ids))
            for k in np.nonzero(one)[0].tolist():
                begin = s.at[at[k]]
                yield s.anchor[at[k]], whole[k], ids[k], s.words[begin: begin + ends[k] - at[k] + window - 1].tobytes()

    def spans_of(batches):
        rows = list(spans(batches))
        for at in range(0, len(rows), 2000):
            part = rows[at: at + 2000]
            yield pd.DataFrame({"anchor": np.array([r[0] for r in part], np.uint64).view(np.int64), "whole": np.array([r[1] for r in part], np.uint64).view(np.int64),
                                "low": np.array([r[2] for r in part], np.int64), "words": [r[3] for r in part]})

    shipped = keyed.mapInPandas(spans_of, "anchor long, whole long, low long, words binary").groupBy("anchor", "whole", "low").agg(F.first("words").alias("words"))
    trees = staged(branching.join(shipped, ["anchor", "whole", "low"]), "branches")
    fits = trees.where(F.col("m") <= group_rows)
    groups = max(1, -(-fits.count() // group_rows))

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        owner, node = _full_depth([np.frombuffer(w, np.uint64) for w in pdf["words"]], n, window)
        low = pdf["low"].to_numpy()[owner]
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, low)
        parts = np.split(least[node], np.cumsum(n)[:-1])
        return pd.DataFrame({"anchor": pdf["anchor"], "whole": pdf["whole"], "held": pdf["held"], "least": parts})

    branches = (fits.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(groups))).groupBy("bucket")
                .applyInPandas(subtree, "anchor long, whole long, held long, least array<long>"))

    def leaves(batches):
        for pdf in batches:
            for anchor_, whole, low, held, words in zip(pdf["anchor"], pdf["whole"], pdf["low"], pdf["held"], pdf["words"]):
                deep = _rolling(np.frombuffer(words, np.uint64), window, _DEEP)
                yield pd.DataFrame({"anchor": anchor_, "whole": whole, "low": low, "held": held, "deep": deep.view(np.int64), "i": np.arange(len(deep), dtype=np.int32)})

    leaf = staged(trees.where(F.col("m") > group_rows).mapInPandas(leaves, "anchor long, whole long, low long, held long, deep long, i int"), "leaves")
    least = staged(leaf.groupBy("anchor", "deep").agg(F.min("low").alias("least"), F.count("*").alias("rows")), "least")
    lengthened = (with_classes(leaf, least, ["anchor", "deep"], "rows").groupBy("anchor", "whole")
                  .agg(F.first("held").alias("held"), F.sort_array(F.collect_list(F.struct("i", "least"))).alias("l"))
                  .select("anchor", "whole", "held", F.col("l.least").alias("least")))
    verdict = staged(chains.unionByName(branches).unionByName(lengthened), "verdict")
    mask = F.when(F.size("least") == 1, F.when(F.col("least")[0] < F.col("doc_id"),
                                               F.expr("shiftleft(1L, n) - 1")).otherwise(F.lit(0).cast("long"))) \
        .otherwise(F.expr("aggregate(transform(least, (x, i) -> if(x < doc_id, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)"))
    # A stretch that very many documents hold is broadcast with its verdict, not dealt to one task.
    return (with_classes(found.select("anchor", "whole", "doc_id", "text_hash", "place", "n"), verdict, ["anchor", "whole"], "held")
            .where("least is not null").select("doc_id", "text_hash", "place", mask.alias("mask")).where("mask <> 0").distinct()
            .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "mask")).alias("cuts")))


def _starts(cuts) -> np.ndarray:
    """The places where a window that goes starts, sorted."""
    out = set()
    for cut in cuts:
        place, bits = cut["place"], cut["mask"]
        while bits:
            out.add(place + (bits & -bits).bit_length() - 1)
            bits &= bits - 1
    return np.array(sorted(out), np.int64)


def _runs(starts: np.ndarray) -> np.ndarray:
    """Rows (first, last) of the runs of neighbouring starts: with the window behind the last one, the maximal repeats."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    breaks = np.nonzero(np.diff(starts) > 1)[0]
    return np.stack([starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]], axis=1)


def _covered(n: int, cuts, window: int) -> np.ndarray:
    """Which of n words lie in a window that goes."""
    edge = np.zeros(n + 1, np.int64)
    for first, last in _runs(_starts(cuts)).tolist():
        edge[first] += 1
        edge[last + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, text_hash, begin, n_words): the maximal repeats of each document with earlier ones, the longest
    runs of words all of whose windows start in a document with a smaller doc_id. Two of them may overlap. Rows that
    repeat both doc_id and text are one; nulls are as in digests."""

    def run(batches):
        for pdf in batches:
            found = [_runs(_starts(c)) for c in pdf["cuts"]]
            sizes = [len(f) for f in found]
            flat = np.concatenate([np.empty((0, 2), np.int64), *found])
            yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), sizes), "text_hash": np.repeat(pdf["text_hash"].to_numpy(), sizes),
                                "begin": flat[:, 0], "n_words": flat[:, 1] - flat[:, 0] + window})

    return removals(docs, window).mapInPandas(run, "doc_id long, text_hash long, begin long, n_words long")


def _joined(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """docs with the cuts of each row, and the name of their column, which docs does not have."""
    doc, cut_hash, cuts, own = free(docs, "__id", "__cut_hash", "__cuts", "__hash")
    found = removals(docs, window).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(cut_hash), F.col("cuts").alias(cuts))
    # The hashed side of a partition is a small part of its texts, whose size the shuffle bounds.
    joined = docs.withColumn(own, F.xxhash64("text")).join(
        found.hint("shuffle_hash"), (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(cut_hash)), "left")
    return joined.drop(doc, cut_hash, own), cuts


def digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and n_repeats, the number of
    its maximal repeats.

    A word goes if a window of ``window`` words that covers it also starts in a document
    with a smaller doc_id. Null and empty texts have no words. A text with fewer words than
    a window loses none. Rows that repeat a doc_id are one document in the comparison and
    get one result each. A null doc_id loses nothing and takes nothing from others. Extra
    columns are ignored; an empty table gives an empty result."""

    joined, name = _joined(doc_columns(docs, "doc_id", "text"), window)

    def run(batches):
        for pdf in batches:
            out = []
            for text, cuts in zip(pdf["text"], pdf[name]):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                n, runs = len(words), 0
                if cuts is not None and len(cuts):
                    runs = len(_runs(_starts(cuts)))
                    gone = _covered(n, cuts, window)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), runs))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": [x[0] for x in out],
                                "n_removed": [x[1] for x in out], "kept_sha256": [x[2] for x in out], "n_repeats": [x[3] for x in out]})

    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long")


def cut_text(text: str, cuts, window: int) -> str:
    """text without the words that go; kept stretches keep their own white space."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(data)]
    gone = _covered(len(spans), cuts, window)
    kept, i = [], 0
    while i < len(spans):
        if gone[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(spans) and not gone[j + 1]:
            j += 1
        kept.append(data[spans[i][0]: spans[j][1]])
        i = j + 1
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


def deduplicated(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the repeated words cut from text, and n_chars, if there, brought up to date.
    Every row and column stays. Nulls, ties and repeated rows are as in digests."""
    joined, name = _joined(docs, window)

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([t if c is None or t is None else cut_text(t, c, window) for t, c in zip(text, cuts)], dtype=object)

    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(cut("text", name))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)
