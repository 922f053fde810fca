"""Toxicity does not grow with a text's length alone."""

import numpy as np
from pyspark.sql import functions as F

from plainfit.llm import toxicity


def test_sentences_without_evidence_add_nothing(spark):
    weights = np.zeros(toxicity.BUCKETS)
    weights[toxicity.buckets("vile")[0]] = 20.0
    model = toxicity.NoisyOr(weights, -8.0)
    long = "Nothing is said here. " * 6000
    docs = spark.createDataFrame([(1, long), (2, long + "You vile thing."), (3, "You vile thing.")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, model).collect()}
    assert got[1] == 0
    assert got[2] == got[3] > 0.5
    assert [r.doc_id for r in toxicity.locate(docs, model).collect()] == [2, 3]


def test_a_fitted_model_lets_long_clean_documents_pass(spark):
    rng = np.random.default_rng(3)
    clean = lambda n: ". ".join(" ".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    texts = [(i, clean(8) + (". you horrid fool" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.col("toxic"))
    more = spark.createDataFrame([(1, clean(100_000)), (2, clean(100_000) + ". you horrid fool")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(more, model).collect()}
    assert got[1] < 0.5 < got[2]
