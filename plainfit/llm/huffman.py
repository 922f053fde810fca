"""Token ids as canonical, length-limited Huffman code in independent blocks.

``write_ids`` tokenises texts, counts ids over the whole corpus, derives one code, sorts the packed ids by document and
writes block files in that order; ``read_ids`` decodes them.  A block holds whole documents, its bit string begins at a byte, and every
``INTERVAL`` ids a checkpoint gives the bit offset, so that one can start reading there; the decoder itself uses the
checkpoints to look up many runs at a time in the code's table.

Null and empty texts hold the end id only.  Documents with null ids come first, those with the same id in order of a
hash of theirs.  Further
columns are ignored.  An empty table gives an empty file set.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, rows_of, shared_path, text_or_empty
from .tokens import WordBpe, load_once, ship

LIMIT, INTERVAL, BLOCK = 16, 256, 1 << 16
HEAD = struct.Struct("<4sIIII")  # magic, ids, ids between checkpoints, checkpoints, bytes of code
MAGIC = b"IDH1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no word over ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need words of over {limit} bits")
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, merged = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([weight, merged])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(weight))
        merged = both[by][: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * len(weight) - 2, np.zeros(len(weight), dtype=np.int64)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


class Code:
    """Canonical words of given lengths: by length, then id; and the table from the next bits to (id, length)."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit, self.length = limit, lengths.astype(np.int64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        width = np.int64(1) << (limit - self.length[order])
        first = np.cumsum(width) - width
        self.word = np.zeros(len(lengths), dtype=np.int64)
        self.word[order] = first >> (limit - self.length[order])
        self.table_id = np.zeros(1 << limit, dtype=np.uint32)
        self.table_length = np.ones(1 << limit, dtype=np.int64)
        filled = int(width.sum())
        self.table_id[:filled] = np.repeat(order, width)
        self.table_length[:filled] = np.repeat(self.length[order], width)

    def encode(self, ids: np.ndarray, interval: int = INTERVAL) -> bytes:
        """One block."""
        size = self.length[ids]
        end = np.cumsum(size)
        begin = end - size
        bits = int(end[-1]) if len(ids) else 0
        n = (bits + 7) // 8
        at = begin >> 3
        value = self.word[ids] << (24 - (begin & 7) - size)  # words of up to 17 bits in three bytes
        body = sum(np.bincount(at + k, weights=(value >> (16 - 8 * k)) & 255, minlength=n + 3)[: n + 3] for k in range(3)) if len(ids) else np.zeros(3)
        checks = begin[::interval].astype("<u4")
        return HEAD.pack(MAGIC, len(ids), interval, len(checks), n) + checks.tobytes() + body[:n].astype(np.uint8).tobytes()

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        """The ids of several blocks; every run between checkpoints is a lane, and all lanes advance together."""
        starts, lane_n, data, sizes, at = [], [], [], [], 0
        for block in blocks:
            magic, n, interval, checks, size = HEAD.unpack_from(block)
            if magic != MAGIC or len(block) != HEAD.size + 4 * checks + size or checks != -(-n // interval):
                raise ValueError("not a whole block")
            starts.append(np.frombuffer(block, "<u4", checks, HEAD.size).astype(np.int64) + 8 * at)
            lane_n.append(np.minimum(interval, n - interval * np.arange(checks)))
            data.append(np.frombuffer(block, np.uint8, size, HEAD.size + 4 * checks))
            sizes.append(n)
            at += size
        if not sum(sizes):
            return [np.empty(0, dtype=np.uint32) for _ in blocks]
        raw = np.concatenate([*data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        pos, n = np.concatenate(starts), np.concatenate(lane_n)
        order = np.argsort(-n, kind="stable")
        pos, steps = pos[order], np.bincount(n, minlength=int(n.max()) + 1)
        active = len(pos) - np.cumsum(steps)  # lanes with more than i ids
        out = np.zeros((int(n.max()), len(pos)), dtype=np.uint32)
        mask, shift = np.uint32((1 << self.limit) - 1), 24 - self.limit
        for i in range(len(out)):
            m = int(active[i])
            p = pos[:m]
            look = (window[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            out[i, :m] = self.table_id[look]
            p += self.table_length[look]
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        flat = out.T[back]
        ids = flat[np.arange(flat.shape[1])[None, :] < n[:, None]]
        return np.split(ids, np.cumsum(sizes)[:-1])


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str = "doc_id") -> DataFrame:
    """Stored rows (doc_id, ids), and for each task one of counts: texts are turned into packed ids before anything is shuffled."""
    raw = ship(docs.sparkSession, tokenizer_path)

    def run(batches):
        model = load_once(WordBpe, raw.value)
        counts, end = np.zeros(max(model.size, end_id + 1), dtype=np.int64), np.array([end_id], dtype=model.dtype).tobytes()
        for batch in rows_of(batches, 2000):
            ids = [model.encode_bytes(x) + end for x in batch.column(1).to_pylist()]
            counts += np.bincount(np.frombuffer(b"".join(ids), model.dtype), minlength=len(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, counts.tobytes()], [pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["doc_id", "ids", "counts"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialise(texts.mapInArrow(run, "doc_id long, ids binary, counts binary"), "ids")


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, id_column: str = "doc_id", limit: int = LIMIT) -> None:
    """Write the files under ``path``: ``code`` (the lengths), ``blocks`` and ``parts``.

    A row of ``blocks`` is one block with its documents, its part and the number of ids before it in that part.  Files
    by name, parts, blocks in a part and documents in a block are in ascending order of the document ids.  ``parts``
    has for each part the number of ids before it, which makes a block's place in the whole.
    """
    spark, raw = docs.sparkSession, ship(docs.sparkSession, tokenizer_path)
    table = tokenised(docs, tokenizer_path, end_id, id_column)
    model = load_once(WordBpe, raw.value)
    size, dtype = max(model.size, end_id + 1), model.dtype

    def unpack(batches):
        for batch in batches:
            total = sum((np.frombuffer(x, dtype=np.int64) for x in batch.column(0).to_pylist()), np.zeros(size, dtype=np.int64))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    summed = table.filter("counts is not null").select("counts").mapInArrow(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, dtype=np.int64)
    for r in summed:  # at most one row for each id of the vocabulary
        counts[r.id] = r.n
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(limit, lengths.tobytes())], "max_bits int, lengths binary").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches):
        code, part = Code(shared.value, limit), TaskContext.get().partitionId()
        names, kinds = ["part", "start", "n", "block", "doc_ids", "doc_sizes"], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        held, n, start = [], 0, 0

        def block():
            row = [part, start, n, code.encode(np.frombuffer(b"".join(x for _, x in held), dtype)), [d for d, _ in held], [len(x) // dtype.itemsize for _, x in held]]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

        for batch in rows_of(batches, 500):
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc, ids))
                n += len(ids) // dtype.itemsize
                if n >= BLOCK:
                    yield block()
                    held, n, start = [], 0, start + n
        if held:
            yield block()

    # Rows of one id are told apart by a hash of theirs, so that an id of very many rows is dealt to several tasks.
    rows = table.filter("counts is null").select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(run, "part int, start long, n long, block binary, doc_ids array<long>, doc_sizes array<long>").write.option("compression", "none").parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one small row for each task
    first = np.cumsum([0, *(r.n for r in parts)]).tolist()
    spark.createDataFrame([(r.part, f) for r, f in zip(parts, first, strict=False)], "part int, first long").coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str, make, schema: str) -> DataFrame:
    """Decode the files.  ``make(doc_ids, starts, ids per document)`` turns each few blocks' documents into a record batch of ``schema``."""
    row = spark.read.parquet(f"{path}/code").first()
    parts = {r.part: r.first for r in spark.read.parquet(f"{path}/parts").select("part", F.col("first")).collect()}  # one small row for each writing task
    shared = spark.sparkContext.broadcast((row.max_bits, row.lengths, parts))  # a byte for each id of the vocabulary

    def run(batches):
        limit, lengths, before = shared.value
        code = Code(np.frombuffer(bytes(lengths), dtype=np.uint8), limit)
        for batch in rows_of(batches, 8):
            part, start, blocks, docs, sizes = (batch.column(i).to_pylist() for i in range(5))
            doc_ids, starts, ids_ = [], [], []
            for p, at, ids, d, n in zip(part, start, code.decode(blocks), docs, sizes, strict=True):
                ends = np.cumsum(n)
                doc_ids += d
                starts += (before[p] + at + ends - n).tolist()
                ids_ += np.split(ids, ends[:-1])
            yield make(doc_ids, starts, ids_)

    return spark.read.parquet(f"{path}/blocks").select("part", "start", "block", "doc_ids", "doc_sizes").mapInArrow(run, schema)


def store_and_read(docs: DataFrame, tokenizer_path: str, make, schema: str, end_id: int = 1) -> DataFrame:
    path = shared_path(docs.sparkSession, "huffman")
    write_ids(docs, tokenizer_path, path, end_id)
    return read_ids(docs.sparkSession, path, make, schema)
