"""SimHash near-duplicate detection with pivot distance tables.

Fingerprints are 64 bits. Links join fingerprints that differ in at most ``radius`` bits.

Candidates come from distances to reference fingerprints (pivots). The bits are cut into
blocks, and each block's Hamming distances to that block of all pivots form one row of the
pivot table. Since |d(x, p) - d(y, p)| <= d(x, y) holds within every block, and since at
most ``radius`` blocks can differ at all, a linked pair has exactly equal distance rows in
at least ``blocks - radius`` of the blocks. Each choice of that many blocks is one join key,
so no link is lost and the join is an equality join. Survivors must also differ by at most
``radius`` in every whole-fingerprint coordinate, and are then verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import overlap
from quern.llm.common import components, doc_columns, staged, with_classes

#: Rows of one bucket that are compared in one task; larger buckets are cut into tiles.
TILE = 256


def fingerprints(texts, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text (None: as empty) over XXH64 of space-joined word shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for row, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        if len(words) <= shingle:
            parts = [b" ".join(words)]
        else:
            parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        counts, n = np.zeros(64, np.int64), 0
        hashes = np.fromiter((digest(p, seed) for p in parts), "<u8")
        for at in range(0, len(hashes), 65536):
            bits = np.unpackbits(hashes[at: at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            n += len(bits)
        out[row] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]
    return out


def fingerprint_table(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for each row of docs."""

    def run(batches):
        for pdf in batches:
            yield pdf[["doc_id"]].assign(fp=fingerprints(pdf["text"].tolist(), shingle, seed).view(np.int64))

    return doc_columns(docs, "doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def _pivots(count: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(64).integers(-(2**63), 2**63 - 1, count)]


def _blocks(count: int) -> list[int]:
    """Masks, as signed longs, of nearly equal runs of bits that cover all 64."""
    edges = [round(i * 64 / count) for i in range(count + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def _distance(x: Column, y: Column | int) -> Column:
    return F.bit_count(x.bitwiseXOR(F.lit(y) if isinstance(y, int) else y))


def links(classes: DataFrame, radius: int = 3, pivots: int = 16, whole: int = 8) -> DataFrame:
    """All pairs (a, b) of ids, a <> b, whose distinct fingerprints differ in 1..radius bits.
    classes: (id long, fp long), one row for each distinct fingerprint."""
    rows = classes.count()
    blocks = radius + (2 if rows <= 1 << 24 else 3 if rows <= 1 << 30 else 4)
    references, masks = _pivots(pivots), _blocks(blocks)
    table = [F.xxhash64(*[_distance(F.col("fp").bitwiseAND(F.lit(m)), _signed(p, m)) for p in references]) for m in masks]
    wide = classes.select("id", "fp", *[c.alias(f"k{i}") for i, c in enumerate(table)])
    keys = [F.struct(F.lit(n).alias("part"), F.xxhash64(*[f"k{i}" for i in chosen]).alias("key"))
            for n, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    keyed = wide.select("id", "fp", F.explode(F.array(*keys)).alias("k")).select("id", "fp", "k.part", "k.key")
    full = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(keyed.join(full, ["part", "key"])
                     .withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
                     .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")), "buckets")
    left = members.select("part", "key", F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("tile").alias("i"),
                          F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"))
    right = members.select("part", "key", F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("tile").alias("j"),
                           F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("i"))
    near = F.col("a") < F.col("b")
    for p in references[:whole]:
        near = near & (F.abs(_distance(F.col("fa"), p) - _distance(F.col("fb"), p)) <= radius)
    near = near & (_distance(F.col("fa"), F.col("fb")) <= radius)
    return left.join(right, ["part", "key", "i", "j"]).where(near).select("a", "b").distinct()


def _signed(pivot: int, mask: int) -> int:
    return pivot & mask


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fp long, component_id long, the
    least doc_id reachable over links of at most ``radius`` differing bits, itself included.

    Null and empty texts (and texts without words) have fingerprint 0 and link like any
    other. Copies share a fingerprint and are one class; only classes are compared. Rows
    that repeat a doc_id get one result each. A null doc_id keeps its row; its component is
    the least doc_id that is not null, or null. Extra columns are ignored; an empty table
    gives an empty result."""
    table = staged(fingerprint_table(docs, shingle, seed), "fingerprints")
    classes = table.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    edges = links(classes.where("id is not null").select("id", "fp"), radius)
    found = components(edges)
    named = classes.join(found, classes["id"] == found["node"], "left").select("fp", "n", F.coalesce("component", "id").alias("component"))
    return (with_classes(table, staged(named.where("n > 1 or component is not null"), "classes"), ["fp"], "n")
            .select("doc_id", "fp", F.when(F.col("doc_id").isNull() & F.col("component").isNull(), None).otherwise(F.coalesce("component", "doc_id")).alias("component_id")))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, radius: int | None = None) -> DataFrame:
    """docs without the rows whose doc_id is not the least of its group; the columns of
    docs are kept as they are. Rows with a null doc_id stay, for they name no document.

    Groups are those of overlap.near_duplicates: shingles of five words, Jaccard similarity of
    0.8 or more. With ``radius`` documents are near copies also if their fingerprints are connected
    over pairs that differ in at most so many bits and this similarity is 0.5 or more: a few words
    changed in a long text leave the fingerprint, though many shingles go; texts that mostly repeat
    one shingle have its fingerprint, though the rest may differ. Fingerprints alone do not find
    all pairs of 0.8, so shared shingles make candidates beside them."""
    prints = {} if radius is None else {"prints": fingerprints, "near": lambda rows: links(rows, radius)}
    gone = staged(overlap.near_duplicates(docs, **prints).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    # Up to a million ids (some 20 MB) are broadcast, so that texts need no shuffle; more are not.
    gone = F.broadcast(gone) if gone.count() <= 1_000_000 else gone
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
