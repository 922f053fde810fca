"""Quality classifier: ordinal (cumulative-link) regression on graded ratings.

A text is the mean of its tokens' hashed features: each run of non-spaces counts as its lower-cased word and as its
shape (kinds of characters, repeats taken together); the share of tokens that repeat the one before is a feature of
its own.  One weight vector is shared by all grades, and ordered thresholds
cut its score: P(grade >= k) = logistic(score - threshold_k).  A fit uses at most ``MAX_ROWS`` rated rows (the first by
a hash of the id; a documented bound, 6000), whose features reach the driver as sparse counts; every text is scored.

Null and empty texts have no tokens and score by the thresholds alone.  Ratings that are null are left out; without
any rating all weights are 0 and every text keeps a tail probability above one half.  A document rated twice counts
twice.  Repeated rows score alike; further columns of the input are kept, but for those that the result names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, text_or_empty, with_columns
from .tokens import Memo

BUCKETS, MAX_ROWS, LEAST_DOCUMENTS, EPOCHS, RATE, RIDGE, GAIN = 1 << 18, 6000, 10, 200, 0.3, 1e-5, 10.0
_kinds = {c: "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else c for c in map(chr, range(128))}


def shape(token: str) -> str:
    kinds = (_kinds.get(c) or ("x" if c.islower() else "X" if c.isupper() else "x" if c.isalpha() else c) for c in token)
    return "".join(k for k, _ in groupby(kinds))


def features(token: str) -> tuple[int, int]:
    """Buckets of a token's word and shape."""
    return xxhash.xxh3_64_intdigest("w" + token.lower()) % BUCKETS, xxhash.xxh3_64_intdigest("s" + shape(token)) % BUCKETS


_features = Memo(features, 50_000)
AGAIN = xxhash.xxh3_64_intdigest("again") % BUCKETS


def again(tokens: list[str]) -> float:
    """The share of tokens that equal the one before."""
    return sum(map(eq, tokens, tokens[1:])) / len(tokens)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of its tokens."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    ids, counts = np.unique(np.array(_features.all(tokens), dtype=np.int32).ravel(), return_counts=True)
    return np.append(ids, np.int32(AGAIN)), np.append(counts / len(tokens), again(tokens)).astype(np.float32)


def rated_sample(docs: DataFrame, ratings: DataFrame, columns: list[Column], id_column: str, most: int) -> DataFrame:
    """(columns..., text) of at most ``most`` ratings whose documents are in ``docs``, the first by a hash of the id; so few that they may be broadcast."""
    there = docs.select(F.col(id_column).cast("long").alias("__id"))
    rated = ratings.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("__id"), *columns)
    few = rated.join(there, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(most)
    texts = docs.select(F.col(id_column).cast("long").alias("__id"), text_or_empty().alias("text"))
    return texts.join(F.broadcast(few), "__id").drop("__id")


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def ordinal_loss(w: np.ndarray, raw: np.ndarray, grades: np.ndarray, rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood with its ridge, and its slopes in the weights and in ``raw``: the first threshold and the logarithms of the gaps.

    Entry k says that text ``rows[k]`` has ``values[k]`` of feature ``ids[k]``.
    """
    n, levels, at = len(grades), len(raw) + 1, np.arange(len(grades))
    theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
    tail = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[ids] * values, n)[:, None] - theta[None, :], -40, 40)))
    upper = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
    p = np.maximum(upper[at, grades] - upper[at, grades + 1], 1e-9)
    slope = upper * (1 - upper)  # of each bound in its logit
    d_score = -(slope[at, grades] - slope[at, grades + 1]) / p
    d_theta = np.zeros(levels + 1)
    np.add.at(d_theta, grades, slope[at, grades] / p)
    np.add.at(d_theta, grades + 1, -slope[at, grades + 1] / p)
    after = np.cumsum(d_theta[1:levels][::-1])[::-1] / n  # a gap moves its threshold and all later ones
    d_raw = np.concatenate([after[:1], after[1:] * np.exp(raw[1:])])
    d_w = np.bincount(ids, d_score[rows] * values, len(w)) / n + RIDGE * w
    return float(-np.log(p).mean() + RIDGE / 2 * w @ w), d_w, d_raw


def fit_ordinal(grades: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], levels: int) -> Ordinal:
    """Maximum likelihood with a ridge by adaptive full-batch steps."""
    weights = np.zeros(BUCKETS)
    if not len(grades):
        return Ordinal(weights, -4.0 + np.arange(levels - 1))
    ids = np.concatenate([b for b, _ in bags])
    rows = np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags])
    values = np.concatenate([v for _, v in bags]).astype(np.float64) * GAIN
    keep = np.bincount(ids, minlength=BUCKETS)[ids] >= LEAST_DOCUMENTS
    used, ids = np.unique(ids[keep], return_inverse=True)
    rows, values = rows[keep], values[keep]
    share = np.array([((grades >= k).sum() + 0.5) / (len(grades) + 1) for k in range(1, levels)])
    cut = np.log((1 - share) / share)
    w, raw = np.zeros(len(used)), np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    g, graw = np.zeros(len(used)), np.zeros(len(raw))
    for _ in range(EPOCHS):
        _, d_w, d_raw = ordinal_loss(w, raw, grades, rows, ids, values)
        g += d_w**2
        graw += d_raw**2
        w -= RATE * d_w / (np.sqrt(g) + 1e-8)
        raw -= RATE * d_raw / (np.sqrt(graw) + 1e-8)
    weights[used] = w * GAIN
    return Ordinal(weights, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def fit_quality(docs: DataFrame, ratings: DataFrame, grade: Column, levels: int, id_column: str = "doc_id", most: int = MAX_ROWS) -> Ordinal:
    """A model of ``grade`` (0 to levels - 1, a column over ``ratings``) by the text of the rated documents."""
    sample = rated_sample(docs, ratings.filter(grade.isNotNull()), [grade.cast("int").alias("grade")], id_column, most)

    def run(batches):
        for batch in rows_of(batches, 1000):
            found = [bag(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["grade", "ids", "shares"])

    rows = sorted(sample.mapInArrow(run, "grade int, ids binary, shares binary").collect(), key=lambda r: (r.grade, bytes(r.ids), bytes(r.shares)))
    return fit_ordinal(np.array([r.grade for r in rows], dtype=np.int64), [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32)) for r in rows], levels)


def score_quality(docs: DataFrame, model: Ordinal, level: int = 1) -> DataFrame:
    """``docs`` with expected_grade and tail_probability, that of a grade of ``level`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    memo = None

    def make(texts):
        nonlocal memo
        weights = shared.value.weights
        if memo is None:
            memo = Memo(lambda token: float(sum(weights[i] for i in features(token))), 150_000)
        score, more = np.zeros(len(texts)), float(weights[AGAIN])
        for i, text in enumerate(texts):
            tokens = text.split()
            score[i] = sum(memo.all(tokens)) / len(tokens) + more * again(tokens) if tokens else 0.0
        tails = shared.value.tails(score)
        return [tails.sum(axis=1), np.ascontiguousarray(tails[:, level - 1])]

    fields = [(n, T.DoubleType(), pa.float64()) for n in ("expected_grade", "tail_probability")]
    return with_columns(docs, text_or_empty(), make, fields)
