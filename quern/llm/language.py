"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams of a language in order. A document's own
most frequent n-grams are compared with each profile by the out-of-place distance: for each
of its n-grams, how far its rank is from the rank in the profile, or the largest distance if
the profile lacks it. The least sum names the language.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import doc_columns, free, text_batches
from quern.llm.grams import chunks, codes, grams

SIZES = (1, 2, 3, 4)
RANKS = 300
UNKNOWN = "und"


def _counts(texts: list[str]):
    """(text number, hashes, counts) for each text with a letter."""
    code, starts = codes(texts, letters_only=True)
    found = [grams(code, n) for n in SIZES]
    cuts = [np.searchsorted(at, starts) for at, _ in found]
    for k in range(len(texts)):
        values, counts = np.unique(np.concatenate([h[c[k]: c[k + 1]] for (_, h), c in zip(found, cuts)]), return_counts=True)
        if len(values):
            yield k, values, counts


def ranked(values: np.ndarray, counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent hashes, in order; ties go by hash."""
    if len(values) > most:
        low = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= low
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:most]


class Profiles:
    def __init__(self, ranks: dict[str, np.ndarray], most: int = RANKS):
        self.names, self.most = sorted(ranks), most
        every = np.unique(np.concatenate([ranks[n] for n in self.names])) if ranks else np.empty(0, np.uint32)
        self.hashes, self.rank = every, np.full((len(self.names), len(every) + 1), -1, np.int64)
        for row, name in enumerate(self.names):
            self.rank[row, np.searchsorted(every, ranks[name])] = np.arange(len(ranks[name]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, own)
        at[at == len(self.hashes)] = 0
        at = np.where(self.hashes[at] == own, at, len(self.hashes)) if len(self.hashes) else np.zeros(len(own), np.int64)
        there = self.rank[:, at]
        return np.where(there < 0, self.most, np.abs(there - np.arange(len(own))[None])).sum(axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The nearest language (ties: the first by name) and 1 - distance / largest distance."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.names:
            for first, held in chunks(texts):
                for k, values, counts in _counts(held):
                    own = ranked(values, counts, self.most)
                    far = self.distances(own)
                    best = int(np.argmin(far))
                    names[first + k] = self.names[best]
                    scores[first + k] = 1 - far[best] / (self.most * len(own))
        return names, scores


def fit(docs: DataFrame, most_each: int = 1000) -> Profiles:
    """Profiles from at most ``most_each`` documents of each language, drawn by a hash of
    doc_id from docs (doc_id, text, lang). Rows with a null doc_id, text or lang are not used."""
    usable = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    n = usable.groupBy("lang").agg(F.count("*").alias("all")).select(F.col("lang").alias("l"), "all")
    # One row a language; a join on lang would deal whole languages to single tasks, so it is broadcast if it is small.
    langs = n.count()
    n = F.broadcast(n) if langs <= 100_000 else n
    # A hash lets about twice as many through, so that no window gathers a whole language.
    likely = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("all") < 2_000_000.0 * most_each
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = usable.select("doc_id", "lang").join(n, F.col("lang") == F.col("l")).where(likely).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_each).select("doc_id", "lang")
    # At most most_each rows a language; if that is few, texts need no shuffle to be picked.
    drawn = F.broadcast(drawn) if langs * most_each <= 1_000_000 else drawn

    def count(batches):
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                for first, held in chunks(group["text"].tolist(), 200_000):
                    found = [(v, c) for _, v, c in _counts(held)]
                    if found:
                        values, inverse = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
                        total = np.bincount(inverse, weights=np.concatenate([c for _, c in found]))
                        yield pd.DataFrame({"lang": lang, "gram": values.astype(np.int64), "n": total.astype(np.int64)})

    sums = (usable.join(drawn, ["doc_id", "lang"], "left_semi").select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    top = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= RANKS)
    rows = top.select("lang", "gram", "rank").toPandas().sort_values("rank")  # RANKS rows a language
    return Profiles({lang: g["gram"].to_numpy().astype(np.uint32) for lang, g in rows.groupby("lang")})


def predicted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text).

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text
    if there is no profile. Ties go to the first language by name. Texts are read to their
    end; rows that repeat are treated alike; a null doc_id stays null. Extra columns are
    ignored; an empty table gives an empty result."""
    spread = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for pdf in batches:
            names, scores = spread.value.predict(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": names, "score": scores})

    return doc_columns(docs, "doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs without the documents whose language is unknown, lang being the predicted one
    where it was null. Other columns stay as they are."""
    text_batches(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("string")
    def name(text: pd.Series) -> pd.Series:
        return pd.Series(spread.value.predict(text.tolist())[0], dtype=object)

    # A filter on a deterministic function is pushed below its projection, and both would run it.
    [found] = free(docs, "__lang")
    out = docs.withColumn(found, name.asNondeterministic()("text")).where(F.col(found) != UNKNOWN)
    return out.withColumn("lang", F.coalesce("lang", found)).select(docs.columns)
