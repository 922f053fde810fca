"""Block files are in ascending order of the document ids by name, whatever the number of ranges; columns that clash; long runs."""

import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plainfit.llm import huffman, piece_bpe, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_files_by_name_are_in_order_of_the_ids(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(i), " ".join(rng.choice(["one", "two", "three", "hello", "Größe"], int(rng.integers(0, 60))))) for i in rng.permutation(3000)]
    rows += [(7, f"again {k}") for k in range(40)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"{tmp_path}/ids"
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        huffman.write_ids(docs, WORDS, path)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = sorted(Path(f"{path}/blocks").glob("part-*.parquet"))
    before = {r.part: r.first_ for r in spark.read.parquet(f"{path}/parts").withColumnRenamed("first", "first_").collect()}
    blocks = [b for f in files for b in pq.read_table(f).to_pylist()]
    assert len({b["part"] for b in blocks}) >= 8
    first = [before[b["part"]] + b["start"] for b in blocks]
    assert first == [0, *np.cumsum([b["n"] for b in blocks])[:-1]]
    ids = [d for b in blocks for d in b["doc_ids"]]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    # The model itself, document by document.
    model = tokens.WordBpe(Path(WORDS).read_bytes())
    want = sorted((d is not None, d or 0, [*model.encode(t or "").tolist(), 1]) for d, t in rows)
    schema = "doc_id long, start long, ids array<int>"

    def make(doc_ids, starts, parts):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.tolist() for x in parts], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    got = huffman.read_ids(spark, path, make, schema).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == want
    starts = sorted((r.start, len(r.ids)) for r in got)
    assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1]]


def test_an_empty_table_of_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    from plainfit.llm import queries

    assert huffman.store_and_read(docs, WORDS, queries._ids_digest, "doc_id long, start long, n_tokens long, ids_crc32 long").count() == 0


def test_columns_named_as_inside_and_long_unbroken_runs(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, "some text", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, read string, __in string")
    got = piece_bpe.decode_pieces(piece_bpe.encode_pieces(rows, path), path)
    assert got.columns == ["doc_id", "text", "read", "__in", "ids", "decoded"]
    assert [(r.decoded, r.read) for r in got.orderBy("doc_id").collect()] == [("some text", "x"), ("", "x")]
    assert piece_bpe.encode_pieces(rows.limit(0), path).count() == 0
    model = piece_bpe.PieceBpe(Path(path).read_bytes())
    times = []
    for n in (50_000, 200_000):
        run = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz"), n))
        began = time.time()
        model.encode(run)
        times.append(time.time() - began)
    assert times[1] < 10 * max(times[0], 0.1)
    assert rows.select(F.lit(1)).count() == 2
