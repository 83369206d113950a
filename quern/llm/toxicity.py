"""Toxicity from subword-bag embeddings and a linear softmax.

A text is cut into segments of a few words. A segment is the average of the vectors of its
words and their character n-grams, all in one hashed table, and a linear softmax turns the
average into a probability; vectors and softmax are trained jointly in numpy. A misspelling
that was never seen shares most n-grams with the word it comes from. Labels are given for
whole texts and a toxic text may hold little that is toxic, so a text is as toxic as its
worst segment: after a first round over all segments, each round trains on the segment
that scores highest in each text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_columns
from quern.llm.grams import chunks, codes, grams, mix

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
SEGMENT = 4
#: Subwords of fewer training texts keep a zero vector, so that noise in labels is not learned by heart.
LEAST_TEXTS = 4


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table row of each subword, first subword of each segment, text of each segment)."""
    code, starts = codes(texts, letters_only=False)
    word_at = np.nonzero((code[1:] != 0) & (code[:-1] == 0))[0] + 1
    if not len(word_at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    word_no = np.zeros(len(code), np.int64)
    word_no[word_at] = 1
    word_no = np.cumsum(word_no) - 1
    text_of = np.searchsorted(starts, word_at, "right") - 1
    first = np.searchsorted(text_of, text_of, "left")
    within = (np.arange(len(word_at)) - first) // SEGMENT
    new = np.ones(len(word_at), bool)
    new[1:] = (text_of[1:] != text_of[:-1]) | (within[1:] != within[:-1])
    segment = np.cumsum(new) - 1
    owners, rows = [], []
    for n in SIZES:
        at, h = grams(code, n)
        # A leading zero stands before the gram's word.
        owners.append(word_no[np.minimum(at + (code[at] == 0), len(code) - 1)])
        rows.append(h)
    with np.errstate(over="ignore"):
        place = np.arange(len(code)) - word_at[np.maximum(word_no, 0)]
        letters = mix(code * np.uint32(0x9E3779B1) + place.astype(np.uint32) * np.uint32(0x85EBCA77))
        letters[code == 0] = 0
        whole = mix(np.add.reduceat(letters, word_at).astype(np.uint32) + np.uint32(77))
    owners.append(np.arange(len(word_at)))
    rows.append(whole)
    owner, row = segment[np.concatenate(owners)], np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    begin = np.searchsorted(owner, np.arange(segment[-1] + 1))
    return (row[order] & np.uint32(BUCKETS - 1)).astype(np.int64), begin, text_of[new]


class Model:
    """table: each subword's share of the logit (its vector times the difference of the softmax rows)."""

    def __init__(self, table: np.ndarray, bias: float, prior: float):
        self.table, self.bias, self.prior = table, bias, prior

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        for first, held in chunks(texts):
            row, begin, owner = bags(held)
            if len(begin):
                logit = np.add.reduceat(self.table[row].astype(np.float64), begin) / np.diff(np.append(begin, len(row))) + self.bias
                worst = np.full(len(held), -np.inf)
                np.maximum.at(worst, owner, logit)
                ok = worst > -np.inf
                out[first: first + len(held)][ok] = 1 / (1 + np.exp(-np.clip(worst[ok], -30, 30)))
        return out


def train(texts: list[str], toxic: np.ndarray, dim: int = 8, rounds: int = 10, rate: float = 0.6, seed: int = 3) -> Model:
    """The joint training. Without both labels the score is the share of toxic texts."""
    toxic = np.asarray(toxic, np.int64)
    prior = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < prior < 1:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))), prior)
    parts, texts_with = [], np.zeros(BUCKETS, np.int64)
    for first, held in chunks(texts):
        r, b, o = bags(held)
        if len(b):
            parts.append((first, r.astype(np.int32), b, o))
            text_of = np.repeat(o, np.diff(np.append(b, len(r))))
            texts_with += np.bincount(np.unique(text_of * BUCKETS + r) & (BUCKETS - 1), minlength=BUCKETS)
    if not parts:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, prior)
    row = np.concatenate([p[1] for p in parts])
    begin, owner, base = [], [], 0
    for first, r, b, o in parts:
        begin.append(b + base)
        owner.append(o + first)
        base += len(r)
    parts.clear()
    begin, owner = np.concatenate(begin), np.concatenate(owner)
    size = np.diff(np.append(begin, len(row)))
    rng = np.random.default_rng(seed)
    common = texts_with >= min(LEAST_TEXTS, 1 + len(toxic) // 100)
    vectors = (rng.uniform(-1, 1, (BUCKETS, dim)) / dim).astype(np.float32)
    vectors[~common] = 0
    softmax, bias = np.zeros((dim, 2)), np.zeros(2)
    softmax[:, 1] = rng.uniform(-1, 1, dim)
    power_v, power_s, power_b = np.full(BUCKETS, 1e-3, np.float32), np.full((dim, 2), 1e-3), np.full(2, 1e-3)
    weight = np.where(toxic == 1, np.sqrt((1 - prior) / prior), 1.0)
    for turn in range(rounds):
        if turn < 2:
            chosen = rng.permutation(len(begin))[: max(20_000, 6 * len(toxic))]
        else:
            table = vectors @ (softmax[:, 1] - softmax[:, 0])
            logit = np.add.reduceat(table[row], begin) / size
            order = np.lexsort((-logit, owner))
            top = np.ones(len(order), bool)
            top[1:] = owner[order][1:] != owner[order][:-1]
            second = np.concatenate([[False], top[:-1]]) & ~top
            # A clean text is clean in every segment; a toxic one is toxic in its worst.
            extra = order[second]
            other = rng.choice(np.nonzero(toxic[owner] == 0)[0], size=min(len(toxic), len(begin)))
            chosen = rng.permutation(np.concatenate([order[top], extra[toxic[owner[extra]] == 0], other]))
        for at in range(0, len(chosen), 256):
            pick = chosen[at: at + 256]
            n = size[pick]
            flat = row[np.repeat(begin[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            cut = np.cumsum(n) - n
            mean = np.add.reduceat(vectors[flat], cut, axis=0) / n[:, None]
            logits = mean @ softmax + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), toxic[owner[pick]]] -= 1
            p *= weight[owner[pick]][:, None]
            to_mean = p @ softmax.T
            grad_s, grad_b = mean.T @ p / len(pick), p.mean(axis=0)
            power_s += grad_s**2
            power_b += grad_b**2
            softmax -= rate * 0.3 * grad_s / np.sqrt(power_s)
            bias -= rate * 0.3 * grad_b / np.sqrt(power_b)
            live = common[flat]
            used, inverse = np.unique(flat[live], return_inverse=True)
            share = np.repeat(to_mean / n[:, None], n, axis=0)[live]
            grad = np.stack([np.bincount(inverse, weights=share[:, k], minlength=len(used)) for k in range(dim)], axis=1)
            power_v[used] += (grad**2).mean(axis=1)
            vectors[used] -= rate * grad / np.sqrt(power_v[used])[:, None]
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)


def fit(docs: DataFrame, labels: DataFrame, most_each: int = 2000, most_chars: int = 6_000) -> Model:
    """Trains on at most ``most_each`` texts of each label, drawn by a hash of doc_id from
    labels (doc_id, toxic), of at most ``most_chars`` characters each. Rows with a null doc_id
    or label are not used."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.where("toxic = 1").orderBy(*order).limit(most_each).unionByName(known.where("toxic = 0").orderBy(*order).limit(most_each))
    # At most 2 * most_each rows are broadcast.
    rows = (doc_columns(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id")
            .where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
            .select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text", "toxic"]))
    return train(rows["text"].tolist(), rows["toxic"].to_numpy(np.int64) if len(rows) else np.empty(0, np.int64))


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs (doc_id, text).

    A null or empty text, or one without words, gets the share of toxic texts in training.
    Long texts are read to their end. Rows that repeat are scored alike; a null doc_id stays
    null. Extra columns are ignored; an empty table gives an empty result."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            score = spread.value.score(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score, "predicted": (score >= threshold).astype(np.int32)})

    return doc_columns(docs, "doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")
