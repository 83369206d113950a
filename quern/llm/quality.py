"""Quality by a sparse ensemble of rules.

Small trees are boosted on statistics of labelled texts; every path from a root is a rule, a
conjunction of comparisons of a statistic with a number. A lasso logistic regression over all
rules keeps few, and those are compiled into one Spark column expression, so that scoring is
an expression over the columns of statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import doc_columns

#: Statistics of a text; all are shares or logarithms, so that none grows with the input.
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "line_words", "upper", "digits", "other", "spaces", "marks", "symbols",
    "distinct_words", "distinct_lines", "distinct_pairs", "stopped_words", "bare_words", "single_letters", "top_word", "ends",
)
#: Words and lines of a text that are compared with each other at a time; statistics of longer texts are means over such parts.
PART = 50_000
_WORD = re.compile(r"\S+")

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_OTHER = _BYTES >= 128
_SPACE = np.isin(_BYTES, list(b" \t\n\r\x0b\x0c"))
_MARK = np.isin(_BYTES, list(b".,;:!?'\"()-"))
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_MARK & ~_DIGIT & ~np.isin(_BYTES | 32, np.arange(97, 123))


def _part(words: list[str]) -> np.ndarray:
    """Shares among some words: distinct, distinct pairs, ending in a mark or symbol, letters only, one letter, the most common."""
    n = len(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    stopped = bare = single = 0
    for w, k in counts.items():
        stopped += k * (not w[-1].isalnum())
        bare += k * w.isalpha()
        single += k * (len(w) == 1)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    return np.array([len(counts) / n, pairs, stopped / n, bare / n, single / n, max(counts.values()) / n])


def statistics(text: str | None) -> np.ndarray:
    """The numbers of STATISTICS of a whole text; all zero for a text without words."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(raw, minlength=256) / max(1, len(raw))
    total, n, held = np.zeros(6), 0, []
    for found in _WORD.finditer(text):
        held.append(found.group())
        if len(held) == PART:
            total, n, held = total + _part(held) * len(held), n + len(held), []
    if held:
        total, n = total + _part(held) * len(held), n + len(held)
    if not n:
        return np.zeros(len(STATISTICS))
    words = total / n
    lines = [x for x in text.split("\n") if x]
    stripped = text.rstrip()
    return np.array([
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), len(raw) / n, np.log1p(n / len(lines)),
        share[_UPPER].sum(), share[_DIGIT].sum(), share[_OTHER].sum(), share[_SPACE].sum(), share[_MARK].sum(), share[_SYMBOL].sum(),
        words[0], len(set(lines)) / len(lines), words[1], words[2], words[3], words[4], words[5], float(stripped[-1] in ".!?")])


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, and a double for each of STATISTICS) for each row of docs (doc_id, text)."""
    def run(batches):
        for pdf in batches:
            found = np.array([statistics(t) for t in pdf["text"]]).reshape(-1, len(STATISTICS))
            out = pd.DataFrame(found, columns=list(STATISTICS))
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    return doc_columns(docs, "doc_id", "text").mapInPandas(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Condition = tuple[int, bool, float]


@dataclass
class Ensemble:
    """Rules (each a tuple of (statistic, above, bound)) with their weights, and what holds without any."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.all([(x[:, s] > b) == above for s, above, b in rule], axis=0) for rule in self.rules], axis=1) if self.rules else np.zeros((len(x), 0), bool)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.holds(x) @ np.array(self.weights, float) + self.bias, -30, 30)))

    def column(self) -> Column:
        """The score as a Spark expression over the columns of STATISTICS."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            test = F.lit(True)
            for s, above, bound in rule:
                col = F.col(STATISTICS[s])
                test = test & (col > F.lit(float(bound)) if above else col <= F.lit(float(bound)))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def _cuts(x: np.ndarray, most: int = 48) -> list[np.ndarray]:
    """Bounds to try for each statistic: midpoints of its distinct values, or of its quantiles."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        if len(v) > most:
            v = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most + 1)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def _tree(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """Paths of a regression tree on the gradients: [(conditions, rows, is a leaf)]."""
    width = max(len(c) for c in cuts) + 1
    out, todo = [], [((), np.arange(len(grad)))]
    while todo:
        path, rows = todo.pop()
        best = None
        if len(path) < depth and len(rows) >= 2 * least:
            g, h = grad[rows], hess[rows]
            for j in range(bins.shape[1]):
                b = bins[rows, j]
                n = np.cumsum(np.bincount(b, minlength=width))[:-1]
                sg, sh = np.cumsum(np.bincount(b, g, width))[:-1], np.cumsum(np.bincount(b, h, width))[:-1]
                fine = (n >= least) & (len(rows) - n >= least) & (np.arange(width - 1) < len(cuts[j]))
                gain = np.where(fine, sg**2 / (sh + 1) + (g.sum() - sg) ** 2 / (h.sum() - sh + 1) - g.sum() ** 2 / (h.sum() + 1), -1.0)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0] + 1e-12):
                    best = gain[k], j, k
        if path:
            out.append((path, rows, best is None))
        if best is not None:
            _, j, k = best
            above = bins[rows, j] > k
            todo.append((path + ((j, False, float(cuts[j][k])),), rows[~above]))
            todo.append((path + ((j, True, float(cuts[j][k])),), rows[above]))
    return out


def _lasso(holds: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights of an L1-penalised logistic regression by accelerated proximal steps; ``share`` is each rule's penalty."""
    n, m = holds.shape
    z = holds.astype(np.float64)
    w, bias = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    # The spectral norm by power iteration bounds the curvature.
    v = np.ones(m) / np.sqrt(m)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1) + 1e-9)
    ahead, ahead_b, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead + ahead_b, -30, 30)))
        new = ahead - step * (z.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * share, 0)
        new_b = ahead_b - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        w, bias, t = new, new_b, t2
    return w, bias


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 0.002) -> Ensemble:
    """Boosts trees, takes all their paths as rules, and fits the weights. With one label only, no rule is left."""
    y = np.asarray(y, float)
    if not len(y) or not 0 < y.mean() < 1:
        p = y.mean() if len(y) else 0.5
        return Ensemble([], [], float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    cuts = _cuts(x)
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    logit, least = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), max(2, len(y) // 200)
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = y - p, p * (1 - p)
        for path, rows, leaf in _tree(bins, cuts, grad, hess, depth, least):
            rules.setdefault(tuple(sorted(path)))
            if leaf:
                logit[rows] += rate * grad[rows].sum() / (hess[rows].sum() + 1)
    found = Ensemble(list(rules), [], 0.0)
    if not found.rules:
        return Ensemble([], [], float(np.log(y.mean() / (1 - y.mean()))))
    holds = found.holds(x)
    # A rule that holds for few rows pays as much as one that holds for many.
    spread = np.sqrt(np.maximum(holds.mean(axis=0) * (1 - holds.mean(axis=0)), 1e-4))
    w, bias = _lasso(holds, y, penalty * np.maximum(spread, 0.1) / 0.5)
    kept = np.nonzero(np.abs(w) > 1e-6)[0]
    return Ensemble([found.rules[i] for i in kept], [float(w[i]) for i in kept], bias)


def fit(docs: DataFrame, labels: DataFrame, most_each: int = 5000, most_chars: int = 200_000) -> Ensemble:
    """Trains on at most ``most_each`` texts of each label, drawn by a hash of doc_id from labels
    (doc_id, quality), of at most ``most_chars`` characters each; only their statistics reach the
    driver. The score is set back to the share of the labels among all known ones, so that it does
    not move with the size of the draw. Rows with a null doc_id, label or text are not used."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.where("quality = 1").orderBy(*order).limit(most_each).unionByName(known.where("quality = 0").orderBy(*order).limit(most_each))
    # At most 2 * most_each rows are broadcast.
    rows = described(doc_columns(docs, "doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
                     .join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi"))
    found = rows.join(F.broadcast(drawn), "doc_id").toPandas().sort_values(["doc_id", "quality", *STATISTICS])
    model = train(found[list(STATISTICS)].to_numpy(float), found["quality"].to_numpy(float))
    ones, zeros = known.agg(F.sum("quality"), F.sum(1 - F.col("quality"))).first()
    if ones and zeros:
        model.bias += float(np.log(ones / zeros) - np.log(min(ones, most_each) / min(zeros, most_each)))
    return model


def scored(docs: DataFrame, model: Ensemble, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs (doc_id, text).

    A null or empty text, or one without words, has statistics of zero and is scored by them.
    Long texts are read to their end. Rows that repeat are scored alike; a null doc_id stays
    null. Extra columns are ignored; an empty table gives an empty result."""
    found = described(docs).select("doc_id", model.column().alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
