"""Empty tables, null and repeated ids, repeated rows, very long texts and tables without queries, for the operators that had no such test."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from plainfit.llm import flac, lm, packing, queries, topk
from plainfit.llm.common import materialise

ROWS = [(1, "a b c d. e f g."), (1, "a b c d. e f g."), (1, "other text"), (None, "no id here"), (None, None), (2, ""), (3, "word " * 40_000)]


def sf(spark, tmp_path, rows, **more):
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"payload": F.lit(1), "score": F.lit("x"), **more}).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_flac_of_odd_tables_and_a_seek(spark, tmp_path):
    got = queries.op2_flac(spark, sf(spark, tmp_path, ROWS)).collect()
    want = sorted((repr(i), hashlib.sha256(flac.padded(t or "")).hexdigest(), len((t or "").encode()), zlib.crc32(flac.padded(t or "")[-64:])) for i, t in ROWS)
    assert sorted((repr(r.doc_id), r.payload_sha256, r.n_bytes, r.tail_crc32) for r in got) == want
    assert queries.op2_flac(spark, sf(spark, tmp_path / "none", [])).count() == 0
    # PCM blocks as a table: the block that holds a sample is found by the text's id and the sample's number.
    text = "".join(chr(32 + i * i % 90) for i in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    blocks = materialise(flac.decode_flac(flac.encode_flac(docs, "doc_id", "text")), "pcm")
    for sample in (0, 4096, 33_333, 49_999):
        row = blocks.filter((F.col("id") == 1) & (F.col("first_sample") <= sample) & (F.col("first_sample") + F.col("n_samples") > sample)).collect()
        assert len(row) == 1 and not row[0].error
        pcm = np.frombuffer(row[0].pcm, np.int8).astype(int) + 128
        assert chr(pcm[sample - row[0].first_sample]) == text[sample]


def test_backoff_of_a_document_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_WORDS", 50)
    monkeypatch.setattr(lm, "PART_WORDS", 70)
    docs = spark.createDataFrame([(1, "a b c " * 100), (2, "a b d"), (2, "a b d"), (None, "b c"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.score) for r in lm.backoff_scores(docs, 2).collect()), key=repr)
    whole = spark.createDataFrame([(1, "a b c " * 100), (2, "a b d"), (2, "a b d"), (None, "b c"), (3, None)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lm, "BLOCK_WORDS", 1_000_000)
    once = sorted(((r.doc_id, r.n_words, r.score) for r in lm.backoff_scores(whole, 2).collect()), key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in once] == [(1, 300), (2, 3), (2, 3), (3, 0), (None, 2)]
    assert np.allclose([r[2] for r in got if r[2] is not None], [r[2] for r in once if r[2] is not None])


def test_top_k_without_rows_or_queries(spark):
    vectors = spark.createDataFrame([(1, [0.5, 0.25]), (3, [0.5, 1.0])], "vec_id long, embedding array<float>")
    for rows in (vectors.limit(0), vectors):
        assert topk.top_k(rows, 5, "vec_id", "embedding", lambda c: c % 20 == 0).collect() == []


def test_scores_of_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = {0: "dull poor bad".split(), 1: "clear good sound".split()}
    rows = [(i, " ".join(rng.choice(words[i % 2] + ["the", "of", "and"], 12)) + ".") for i in range(300)]
    again = [*rows, *rows[:50], *rows[:50], (None, "clear good"), (500, None)]
    path = sf(spark, tmp_path, again)
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for name, column in (("op5_quality", "expected_grade"), ("op9_toxicity", "score")):
        got = queries.queries()[name](spark, path).collect()
        assert len(got) == len(again)
        by_id: dict = {}
        for r in got:
            by_id.setdefault(r.doc_id, set()).add(r[column])
        assert all(len(v) == 1 for k, v in by_id.items() if k is not None and k < 300)  # equal rows, equal scores
    assert queries.queries()["op9_toxicity"](spark, path).filter("doc_id is null").first().held_out is None


def test_pieces_and_packing_of_repeated_and_null_ids(spark, tmp_path):
    path = sf(spark, tmp_path, ROWS)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((repr(i), len(ids := model.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in ROWS)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256) for r in queries.op6_pieces(spark, path).collect()) == want
    packed = packing.pack_documents(spark.read.parquet(f"{path}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    used: dict = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) <= 1024
    assert sum(1 for r in packed if r.piece == 0) == len(ROWS)
    assert sum(1 for r in packed if r.doc_id is None and r.piece == 0) == 2 and sum(1 for r in packed if r.doc_id == 1) == 3
