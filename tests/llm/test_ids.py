"""Null ids, and one id on several texts, in near duplicates and backoff scores."""

from pyspark.sql import functions as F

from plainfit.llm import lm, near

COPY = "one two three four five six seven eight nine ten"
ROWS = [(None, COPY), (None, COPY), (5, COPY), (None, "null ids alone hold these very words twice"), (None, "null ids alone hold these very words twice"), (7, "the first text of an id that has two"), (7, "quite another text that shares the id only by chance"), (8, "a row that is there two times"), (8, "a row that is there two times"), (None, None), (None, "!!")]


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_null_and_shared_ids_in_links(spark):
    got = near.jaccard_join(table(spark)).collect()
    assert len(got) == len(ROWS)
    count = lambda **k: sum(all(r[n] == v for n, v in k.items()) for r in got)
    assert count(class_id=5, copy_id=5, n_links=2) == 3
    assert count(doc_id=None, class_id=None, n_links=1) == 2
    assert count(doc_id=7, class_id=7, n_links=0) == 2
    assert count(doc_id=None, class_id=None, n_links=0) == 2


def test_one_row_of_each_class_stays(spark):
    got = sorted(((r.doc_id, r.text) for r in near.keep_first(table(spark)).collect()), key=repr)
    want = [(5, COPY), ROWS[3], ROWS[5], ROWS[6], ROWS[7], ROWS[9], ROWS[10]]
    assert got == sorted(want, key=repr)


def test_backoff_scores_of_null_ids(spark):
    docs = table(spark)
    got = lm.backoff_scores(docs).collect()
    assert len(got) == len(ROWS) and sum(r.doc_id is None for r in got) == 6
    ids = docs.select(F.coalesce("doc_id", F.lit(99)).alias("doc_id"), "text")
    want = lm.backoff_scores(ids).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else 99, r.n_words, round(r.score or 0, 9))
    assert sorted(map(key, got)) == sorted(map(key, want))
