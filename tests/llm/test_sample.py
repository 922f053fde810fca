"""The labelled sample is drawn from the ratings whose documents are there."""

from pyspark.sql import functions as F

from plainfit.llm import quality


def test_sample_fills_up_from_the_documents_there(spark):
    ratings = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("grade"))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    assert quality.rated_sample(docs, ratings, [F.col("grade")], "doc_id", 40).count() == 40
