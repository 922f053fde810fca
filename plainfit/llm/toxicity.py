"""Toxicity by multiple-instance learning: labels are on documents, scores are on sentences.

A sentence's chance of being toxic is logistic in the sum of the hashed weights of its words and of their first 4, 5
and 6 letters (inflected and compound words share them); a document is toxic if any
sentence is (noisy-or): 1 - product of (1 - p).  A sentence without any weighted word is no evidence (p = 0), so that
length alone adds nothing.  Training maximises the likelihood of the documents' labels through
the noisy-or, so the weights learn which sentences explain a label; ``locate`` then gives the offending sentences with
their places.  A fit uses at most ``MAX_ROWS`` labelled rows (the first by a hash of the id; a documented bound, 6000).

Sentences end at . ! ? or a line's end.  Null and empty texts and texts without words have no sentence and score 0.
Labels that are null are left out; without labels every score is near 0.  An empty table gives an empty result.
Repeated rows score alike; further columns of the input are kept, but for those that the result names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialise, rows_of, text_or_empty, with_columns
from .quality import rated_sample
from .tokens import Memo

BUCKETS, MAX_ROWS, LEAST_DOCUMENTS, LEAST_Z, EPOCHS, RATE, RIDGE, START = 1 << 20, 6000, 4, 3.5, 300, 0.1, 1e-4, -6.0
STEMS = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")


def buckets(word: str) -> tuple[int, ...]:
    """A word's bucket and those of its first letters; four in all, a short word's own again where it has no more."""
    own = xxhash.xxh3_64_intdigest(word) % BUCKETS
    return own, *(xxhash.xxh3_64_intdigest(f"{word[:k]}-") % BUCKETS if len(word) >= k else own for k in STEMS)


_buckets = Memo(buckets, 50_000)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any."""
    return [w for s in SENTENCE.findall(text.lower()) if (w := WORD.findall(s))]


@dataclass
class NoisyOr:
    weights: np.ndarray
    start: float


def noisy_or_loss(w: np.ndarray, b: float, labels: np.ndarray, owner: np.ndarray, sentence: np.ndarray, ids: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Negative log likelihood of the documents' labels with its ridge, and its slopes in the weights and the start ``b``.

    Word k is of feature ``ids[k]`` in sentence ``sentence[k]``, which is one of document ``owner[sentence[k]]``.
    """
    z = np.clip(np.bincount(sentence, w[ids], len(owner)) + b, -30, 30)
    p = 1 / (1 + np.exp(-z))
    log_none, positive = np.bincount(owner, -np.logaddexp(0, z), len(labels)), labels.astype(bool)
    some = np.maximum(-np.expm1(log_none), 1e-9)
    # d loss / d z: p for a clean document, -p (1 - P) / P for a toxic one
    d = p * np.where(positive, -np.exp(log_none) / some, 1.0)[owner]
    ridge = RIDGE * len(labels) / 100
    loss = -np.where(positive, np.log(some), log_none).sum() + ridge / 2 * w @ w
    return float(loss), np.bincount(ids, d[sentence], len(w)) + ridge * w, float(d.sum())


def fit_noisy_or(labels: np.ndarray, used: np.ndarray, words: list[np.ndarray], sizes: list[np.ndarray]) -> NoisyOr:
    """``used``: the buckets that may have weights; ``words``: each document's places in ``used`` in order; ``sizes``: how many each of its sentences has."""
    weights = np.zeros(BUCKETS, dtype=np.float64)
    if not len(labels):
        return NoisyOr(weights, START - 3)
    ids, length = np.concatenate(words), np.concatenate(sizes)
    owner = np.repeat(np.arange(len(labels)), [len(s) for s in sizes])[length > 0]
    length = length[length > 0]
    sentence = np.repeat(np.arange(len(length)), length)
    w, b, gw, gb = np.zeros(len(used)), START, np.zeros(len(used)), 0.0
    for _ in range(EPOCHS):
        _, d_w, d_b = noisy_or_loss(w, b, labels, owner, sentence, ids)
        gw += d_w**2
        gb += d_b**2
        w -= RATE * 5 * d_w / (np.sqrt(gw) + 1e-8)
        b -= RATE * d_b / (np.sqrt(gb) + 1e-8)
    weights[used] = w
    return NoisyOr(weights, float(b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: Column, id_column: str = "doc_id", most: int = MAX_ROWS) -> NoisyOr:
    """A model of the 0/1 column ``label`` of ``labels`` by the sentences of the labelled documents."""
    sample = materialise(rated_sample(docs, labels.filter(label.isNotNull()), [label.cast("int").alias("label")], id_column, most), "labelled")
    whole = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("share")).first()

    def occur(batches):
        """In how many documents, and toxic ones, of a batch each bucket occurs."""
        for batch in rows_of(batches, 500):
            every, toxic = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for y, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.unique(np.array(_buckets.all([w for s in sentences(text) for w in s]), dtype=np.int64).ravel())
                (toxic if y else every).append(own)
            ids, n = np.unique(np.concatenate(every + toxic), return_counts=True)
            t = np.bincount(np.searchsorted(ids, np.concatenate(toxic)), minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64))], names=["bucket", "n", "t"])

    # Only what occurs clearly more often in toxic documents can explain a label; the other weights stay 0.
    n, expected = F.col("n"), F.col("n") * float(whole.share)
    explains = (n >= LEAST_DOCUMENTS) & (F.col("t") - expected >= LEAST_Z * F.sqrt(expected * (1 - float(whole.share))))
    counts = sample.mapInArrow(occur, "bucket long, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    used = np.array(sorted(r.bucket for r in counts.filter(explains).select("bucket").collect()), dtype=np.int64)  # at most one for each bucket
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def run(batches):
        place = np.full(BUCKETS, -1, dtype=np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for batch in rows_of(batches, 500):
            ids, sizes = [], []
            for text in batch.column("text").to_pylist():
                own = sentences(text)
                found = place[np.array(_buckets.all([w for s in own for w in s]), dtype=np.int64).reshape(-1, 1 + len(STEMS))]
                owner = np.repeat(np.arange(len(own)), [len(s) for s in own])
                hits = (found >= 0).sum(axis=1)
                ids.append(found[found >= 0].tobytes())
                sizes.append(np.bincount(owner, hits, len(own)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())], names=["label", "ids", "sizes"])

    rows = sorted(sample.mapInArrow(run, "label int, ids binary, sizes binary").collect(), key=lambda r: (r.label, bytes(r.ids), bytes(r.sizes)))
    return fit_noisy_or(np.array([r.label for r in rows]), used, [np.frombuffer(r.ids, np.int32) for r in rows], [np.frombuffer(r.sizes, np.int32) for r in rows])


def _weights_of(model: NoisyOr) -> Memo:
    return Memo(lambda word: float(sum(model.weights[i] for i in buckets(word))), 150_000)


def score_toxicity(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``docs`` with ``toxicity``, the noisy-or of its sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    memo = None

    def make(texts):
        nonlocal memo
        memo, start = memo or _weights_of(shared.value), shared.value.start
        z, owner = [], []
        for i, text in enumerate(texts):
            own = [sum(w) for s in sentences(text) if any(w := memo.all(s))]
            z += own
            owner += [i] * len(own)
        none = np.bincount(np.array(owner, dtype=np.int64), -np.logaddexp(0, np.clip(np.array(z) + start, -30, 30)), len(texts))
        return [-np.expm1(none) + 0.0]

    return with_columns(docs, text_or_empty(), make, [("toxicity", T.DoubleType(), pa.float64())], 1000)


def locate(docs: DataFrame, model: NoisyOr, id_column: str = "doc_id", least: float = 0.5) -> DataFrame:
    """(doc_id, begin, end, sentence, score) of every sentence scored ``least`` or more; places count characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, begin int, end int, sentence string, score double"

    def run(batches):
        memo, start = _weights_of(shared.value), shared.value.start
        for batch in rows_of(batches, 1000):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for m in SENTENCE.finditer(text):
                    if any(found := memo.all(WORD.findall(m[0].lower()))):
                        p = 1 / (1 + np.exp(-np.clip(sum(found) + start, -30, 30)))
                        if p >= least:
                            rows.append((doc, m.start(), m.end(), m[0], float(p)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()], strict=True)], names=["doc_id", "begin", "end", "sentence", "score"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)
