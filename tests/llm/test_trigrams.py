"""The registered backoff scores of order 3 equal DuckDB's, and use the word before the last."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plainfit.llm import queries

SF = "/root/testdata/sf0.001"


def test_registered_trigrams_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = {r.doc_id: (r.n_words, r.score) for r in queries.queries()["op3_trigrams"](spark, SF).collect()}
    want = {d: (n, s) for d, n, s in con.sql(queries.oracle_sql()["op3_trigrams"]).fetchall()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and got[d][1] == pytest.approx(want[d][1], abs=2e-6) for d in want)


def test_registered_trigrams_see_broken_phrases(spark, tmp_path):
    # "a b c" is known as a whole in the first text; the last one has known pairs only.
    texts = ["a b c", "a b c", "x b c", "a b y", "a b c", "y b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score for r in queries.queries()["op3_trigrams"](spark, str(tmp_path)).collect()}
    pairs = {r.doc_id: r.score for r in queries.queries()["op3_backoff"](spark, str(tmp_path)).collect()}
    assert score[4] == score[0] and score[5] < score[0]
    assert score[5] < pairs[5]
