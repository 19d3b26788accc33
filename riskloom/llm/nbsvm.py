"""Quality classifier: a support vector machine on Naive Bayes scaled n-grams.

A text's features are the n-grams it has (indicators): words, word pairs, and
runs of three word shapes (letter case, digits, trailing signs, "same word as
before"), hashed into ``DIMS`` places and scaled to unit length.  Every feature is
multiplied by its class log-count ratio, then a linear hinge-loss model is fitted
by dual coordinate descent.  Margins become probabilities by a logistic curve
fitted on out-of-fold margins, each class weighted by its share of all training
labels.

The fit uses at most ``FIT_ROWS`` labelled rows a class, those with the smallest
hashed ids; class shares are counted over all labels, and every row is scored
over its whole text.  Only the text enters a score.

Nulls: a null text is the empty text; null labels are not used; ids whose label
rows disagree are not used; a null id is held out.  Repeated rows get equal
scores.  Without labels of both classes the score is the share of label 1 (0.5
with no label).  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import long_text_batches, nearest_ids, release_memory, texts

DIMS = 1 << 18
FIT_ROWS = 3000
KEEP_AT = 0.3
FOLDS = 3
_MASK = np.uint64(0xFFFFFFFF)


def shape_of(word: str) -> int:
    """0..255: letter case or kind of the word's core, what trails it and how often."""
    core = word.rstrip("!?.,;:%$#&*~^=+-_|/\\<>()[]{}\"'")
    tail = word[len(core):]
    if not core:
        kind = 0
    elif core.isdigit():
        kind = 1
    elif any(c.isdigit() for c in core):
        kind = 2
    elif not core.isalpha():
        kind = 3
    elif core.islower():
        kind = 4
    elif core.isupper():
        kind = 5 if len(core) > 1 else 6
    else:
        kind = 6 if core[1:].islower() else 7
    sign = (" .,!?;:|%$#&*".find(tail[0]) + 1 or 14) if tail else 0
    return kind * 32 + sign * 2 + (len(tail) > 1)


class Words(dict):
    """Word -> shape << 32 | hash of the lower-cased word; emptied at ``bound`` entries."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        got = self[word] = shape_of(word) << 32 | zlib.crc32(word.lower().encode())
        return got


def features(text: str, words: Words) -> np.ndarray:
    """Distinct places of the n-grams of the whole text, ascending."""
    tokens = text.split()
    if not tokens:
        return np.zeros(1, np.int64)
    both = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = both & _MASK, both >> np.uint64(32)
    same = np.zeros(len(word), np.uint64)
    same[1:] = word[1:] == word[:-1]
    cls = shape * np.uint64(2) + same + np.uint64(1)
    pad = np.concatenate([np.zeros(2, np.uint64), cls])
    runs = (pad[:-2] << np.uint64(20)) + (pad[1:-1] << np.uint64(10)) + pad[2:] + (np.uint64(3) << np.uint64(60))
    pairs = word[:-1] * np.uint64(0x9E3779B1) + word[1:] + (np.uint64(1) << np.uint64(63))
    grams = np.concatenate([word, pairs, runs])
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((grams >> np.uint64(46)).astype(np.int64))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(DIMS, alpha), np.full(DIMS, alpha)
    for x, label in zip(rows, y):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                            rounds: int = 12, tol: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model; ``cost`` bounds each dual variable."""
    w = np.zeros(DIMS)
    dual = np.zeros(len(rows))
    norm = np.array([v @ v for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v) - 1
            new = min(max(dual[i] - g / norm[i], 0.0), cost[i])
            worst = max(worst, abs(new - dual[i]))
            if new != dual[i]:
                w[x] += (new - dual[i]) * y[i] * v
                dual[i] = new
        if worst < tol:
            break
    return w


def fit_weights(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Weight per place, ratio included: the margin of ``x`` is ``sum(weights[x]) / sqrt(len(x))``."""
    r = log_count_ratio(rows, y)
    values = [r[x] / np.sqrt(len(x)) for x in rows]
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    return dual_coordinate_descent(rows, values, y, c * 0.5 / share) * r


def margin(weights: np.ndarray, x: np.ndarray) -> float:
    return float(weights[x].sum() / np.sqrt(len(x)))


def logistic_curve(m: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of ``y`` (0/1) on margins, by Newton steps."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y <= 0).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        d, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * m).sum() + 1e-6 * a, d.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS):
    """Model from the labelled rows that are not held out: (weights, slope, offset), weights None for a constant score."""
    long_text_batches(docs.sparkSession)
    agreed = (labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
              .groupBy("doc_id").agg(F.min(label_col).alias("lo"), F.max(label_col).alias("y"))
              .filter("lo = y").select("doc_id", (F.col("y") > 0).alias("y")))
    n = {r["y"]: r["n"] for r in agreed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = nearest_ids(agreed, "y", fit_rows).union(nearest_ids(agreed, "not y", fit_rows))

    def run(batches):
        words = Words()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"],
                                "x": [features(t, words).astype("<i4").tobytes() for t in pdf["text"]]})

    # at most 2 * fit_rows ids: a fixed bound on what is broadcast and on what comes back
    rows = (texts(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
            .mapInPandas(run, "doc_id bigint, y boolean, x binary").collect())
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([1 if r["y"] else -1 for r in rows], float)
    if len(set(y)) < 2:
        share = n.get(True, 0) / max(1, sum(n.values())) if n else 0.5
        return None, 0.0, share
    x = [np.frombuffer(r["x"], "<i4") for r in rows]
    fold = np.arange(len(x)) % FOLDS
    m = np.zeros(len(x))
    for k in range(FOLDS):
        own = np.flatnonzero(fold != k)
        w = fit_weights([x[i] for i in own], y[own]) if len(set(y[own])) == 2 else np.zeros(DIMS)
        for i in np.flatnonzero(fold == k):
            m[i] = margin(w, x[i])
    weight = np.where(y > 0, n[True] / (y > 0).sum(), n[False] / (y < 0).sum()) / sum(n.values())
    a, b = logistic_curve(m, y, weight)
    model = fit_weights(x, y).astype(np.float32), a, b
    del rows, x, w
    release_memory()        # later stages run beside this process
    return model


def score_udf(model):
    weights, a, b = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for batch in batches:
            if weights is None:
                yield pd.Series(np.full(len(batch), b))
                continue
            got = np.array([margin(weights, features(t, words)) for t in batch])
            yield pd.Series(1 / (1 + np.exp(-np.clip(a * got + b, -500, 500))))
        del words
        release_memory()

    return score


def scored(docs: DataFrame, model, score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""
    return docs.withColumn(score_col, score_udf(model)(F.coalesce("text", F.lit(""))))
