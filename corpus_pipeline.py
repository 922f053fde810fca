"""Corpus pipeline: five stages over ``documents``, each calling one operator of plainfit.llm.

Every stage gets what the one before it kept, as a stored table, and all but the last return the columns of
``documents``.  Null texts are kept as they are by the filters (nothing speaks against them) and packed as empty ones.
Rows with null ids are rows like others; rows that share id and text are one after the third stage, and what shares an
id only stays apart.  Without labels the filters keep all.  Further columns pass through, and an empty table gives an
empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainfit.llm import near, packing, pii, quality, queries, toxicity
from plainfit.llm.common import materialise


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least good with probability one half and more, by the ordinal model of the graded ratings."""
    model = quality.fit_quality(docs, queries.table(spark, sf_dir, "labels"), queries.grade(), 3)
    return quality.score_quality(docs, model).filter("tail_probability >= 0.5").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores stays below one half."""
    model = toxicity.fit_toxicity(docs, queries.table(spark, sf_dir, "labels").filter(~queries.held_out()), F.col("toxic"))
    return toxicity.score_toxicity(docs, model).filter("toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of links on five-word runs at similarity 0.8 and more."""
    return near.keep_first(docs).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; ``n_chars`` follows the text."""
    replaced = pii.replace_pii(docs, queries.KEY)
    return replaced.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens in sequences of at most 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", select_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the fitted models, the keyed hashes or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stage's result stored and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
