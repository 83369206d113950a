"""Divergence of sources: how far the term distribution of each source lies from the others of its language.

Tasks count terms, and the documents that hold them, for each language and source. A kept term
becomes one row with a vector that is indexed by the sources of its language; higher-order
functions on that vector emit what the term adds to each pair of sources, and a map-side
aggregation sums it. A pair in which neither source holds a term gets the same amount from
all such terms, so only pairs with a holder are emitted and the others are counted.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, staged, text_batches

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Entries of a task's tables after which they are handed on.
MOST_ENTRIES = 800_000
#: Characters of a text whose terms are listed at a time.
SLICE = 1 << 20
#: Language rows are copied so often when they are joined by a shuffle, so that no task gets all terms of one.
SALTS = 256
#: (lang, source) groups up to which the language rows are broadcast (some 40 bytes a group).
MOST_BROADCAST = 100_000


def _terms(text: str):
    """Lists of the terms of a text; no term is cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            inside = TERM.match(text, end - 1)
            end = inside.end() if inside else end
        yield TERM.findall(ascii_lower(text[at:end]))
        at = end


def _counted(batches):
    """(gid, term, n, docs) of the rows of a task, summed as far as memory allows."""
    held: dict[int, tuple[Counter, Counter]] = {}

    def out():
        for gid, (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i: i + 50_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(part), gid, np.int64)), pa.array(part, pa.string()),
                    pa.array(np.fromiter(map(n.__getitem__, part), np.int64, len(part))),
                    pa.array(np.fromiter(map(docs.__getitem__, part), np.int64, len(part)))], ["gid", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for text, gid in zip(batch.column("text"), batch.column("gid").to_pylist()):
            n, docs = held.setdefault(gid, (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in _terms(text.as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size > MOST_ENTRIES:
                yield from out()
                size = 0
    yield from out()


def _grouped(docs: DataFrame) -> DataFrame:
    """(gid, lang, source, text): null is '', and gid is a hash that stands for lang and source."""
    text_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return rows.withColumn("gid", F.xxhash64("lang", "source"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(gid, term, n, docs): occurrences of each term in each group, and the documents that hold it.
    Tasks have summed before rows move; they are dealt by term, which also brings a term's groups together."""
    found = _grouped(docs).select("text", "gid").mapInArrow(_counted, "gid long, term string, n long, docs long")
    return found.repartition("term").groupBy("gid", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _part(count: str, total: str, kept: str) -> str:
    """SQL of 1 + floor(1000000000 * (count + 2) / (total + 2 * kept)); the product may pass 64 bits."""
    return (f"1 + (cast({count} + 2 as decimal(19,0)) * cast(1000000000 as decimal(10,0)))"
            f" div cast({total} + 2 * {kept} as decimal(19,0))")


def _gap(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)); the square is at most 10^18."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))"


def _languages(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """One row a language: its number of kept terms, their count, and its sources in order,
    each with its place, its count and the part of a term that it lacks."""
    held = kept.select("lang", F.explode("cells").alias("cell")).groupBy("lang", F.col("cell.i").alias("i")).agg(F.sum("cell.n").alias("n"))
    totals = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    counts = groups.join(held, ["lang", "i"], "left").join(totals, "lang", "left").select(
        "lang", "i", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all"))
    lacking = F.when(F.col("v") > 0, F.expr(_part("0L", "n", "v")))
    return counts.groupBy("lang", "v", "all").agg(F.array_sort(F.collect_list(F.struct("i", "source", "n", lacking.alias("p0")))).alias("sources"))


def _with_language(rows: DataFrame, languages: DataFrame, groups: int) -> DataFrame:
    """rows joined with the row of their language: broadcast while there are few groups,
    else dealt over copies, so that the terms of a large language spread."""
    if groups <= MOST_BROADCAST:
        return rows.join(F.broadcast(languages), "lang")
    copies = languages.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    return rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(term), {SALTS}) as int)")).join(copies, ["lang", "salt"]).drop("salt")


def vectors(kept: DataFrame, languages: DataFrame, groups: int) -> DataFrame:
    """Each kept term with ``wide``, its vector over the sources of its language: place, count and part in each."""
    rows = _with_language(kept, languages, groups).withColumn("held", F.map_from_entries("cells"))
    counted = rows.withColumn("wide_n", F.expr("transform(sources, s -> coalesce(held[s.i], 0L))"))
    part = _part("wide_n[i]", "s.n", "v")
    return counted.withColumn("wide", F.expr(f"transform(sources, (s, i) -> struct(i, wide_n[i] as n, if(wide_n[i] = 0, s.p0, {part}) as p))"))


def _pairs(wide: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, source, item, value): both directions of each pair of sources. A source that holds a term meets
    those behind it, and those before it that lack the term."""
    rows = wide.select("lang", "wide", F.expr("filter(wide, x -> x.n > 0)").alias("holders"), F.expr("filter(wide, x -> x.n = 0)").alias("lackers"))
    behind = f"transform(slice(wide, x.i + 2, size(wide)), y -> struct(x.i as a, y.i as b, {_gap('x.p', 'y.p')} as f))"
    before = f"transform(filter(lackers, y -> y.i < x.i), y -> struct(y.i as a, x.i as b, {_gap('x.p', 'y.p')} as f))"
    emitted = F.expr(f"flatten(transform(holders, x -> if(size(lackers) = 0, {behind}, concat({behind}, {before}))))")
    terms = rows.select("lang", F.explode(emitted).alias("e")).select("lang", "e.a", "e.b", "e.f")
    summed = terms.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.count("*").alias("seen"))
    first = languages.select("lang", "v", F.posexplode("sources").alias("a", "x"), "sources")
    every = first.select("lang", "v", "a", "x", F.posexplode("sources").alias("b", "y")).where("b > a")
    whole = every.join(summed, ["lang", "a", "b"], "left").select(
        "lang", F.col("x.source").alias("x"), F.col("y.source").alias("y"),
        F.expr(f"coalesce(f, 0L) + if(v = 0, 0L, (v - coalesce(seen, 0L)) * ({_gap('x.p0', 'y.p0')}))").alias("value"))
    return whole.select("lang", F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")),
                                                  F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("e"), "value").select(
        "lang", "e.source", "e.item", "value")


def _terms_above(wide: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a source holds, and more of than its language."""
    cells = wide.withColumn("q", F.expr(_part("total", "all", "v"))).select(
        "lang", "term", "q", F.explode(F.expr("filter(wide, x -> x.n > 0)")).alias("e"), "sources")
    return cells.where("e.p > q").select("lang", F.expr("sources[e.i].source").alias("source"), F.col("term").alias("item"), F.expr(_gap("e.p", "q")).alias("value"))


def _ranked(df: DataFrame) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(by))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of docs (text, lang, source).

    Part ``pair``: the divergence from each other source of the language, all ranks. Part
    ``term``: the ``top`` terms that the source holds more of than its language. Terms count
    if ``least_docs`` documents of the language hold them.

    A null text, lang or source is ''. Groups without terms have pairs, and no terms; a source
    alone in its language has no pairs; an empty table gives an empty result. Rows that repeat
    count each time. Long texts are read to their end. Ties go by the bytes of the item. Extra
    columns are ignored."""
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("i")
    groups = staged(_grouped(docs).select("gid", "lang", "source").distinct().select("gid", "lang", "source", place), "groups")
    n, hashes = groups.agg(F.count("*"), F.count_distinct("gid")).first()
    if n != hashes:
        raise ValueError("two groups of language and source have one hash")
    ids = groups.select("gid", "lang", "i")
    kept = staged(term_counts(docs).join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, "gid").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("i", "n")).alias("cells"))
        .where(F.col("docs") >= least_docs), "terms")
    languages = staged(_languages(groups, kept), "languages")
    wide = vectors(kept, languages, n)
    out = "lang", "source", "part", "item", "value", "rank"
    pairs = _ranked(_pairs(wide, languages)).withColumn("part", F.lit("pair"))
    terms = _ranked(_terms_above(wide)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.select(*out).unionByName(terms.select(*out))
