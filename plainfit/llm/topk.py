"""Exact top-k search: tiled matrix products, a selection per tile, and tree merging of each query's lists.

Vectors are packed into shards (one row holds up to ``SHARD`` vectors) and queries into blocks; each pair of a block
and a shard is one tile and one matrix product.  Shards and query blocks are dealt to a grid of groups of a few of
each, so what is shuffled is packed blocks, and k scores a query and group.  The lists are merged ``FAN`` at a time, level by level, so no task sees more than ``FAN`` lists of a
block, however many shards there are.

Vectors that are null or hold null or non-finite components take no part.  Vectors of different lengths are not
compared.  Components are floored after scaling, at most 2^62 in size; a sum beyond 64 bits is held at the limit.
Ties go to the smaller id.  A row with a query's own id is never its candidate; repeated rows each count.  Further
columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, rows_of

SHARD, QUERIES, PER_GROUP, FAN, TOP = 4096, 512, 4, 16, (1 << 63) - 1
BLOCKS = "dim int, block long, n int, ids binary, vectors binary"
LISTS = "query_block long, part long, query_ids binary, counts binary, ids binary, scores binary"
NAMES = [x.split()[0] for x in LISTS.split(", ")]


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale * x), rows with a null or non-finite component left out."""
    x = F.col("v")
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    top = float(2**62)
    return rows.filter(F.col("id").isNotNull() & x.isNotNull() & ~bad).select("id", F.transform(x, lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-top)), F.lit(top)))).alias("v"))


def narrowed(values: np.ndarray) -> bytes:
    """Integers in the least signed type that holds them, its width first: what is shuffled is mostly two bytes a component."""
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= values.min(initial=0) and values.max(initial=0) <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of up to ``size`` vectors of one length, as the stored table has them."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dim):
            nonlocal made
            ids, vectors = zip(*held.pop(dim), strict=True)
            row = [dim, task << 32 | made, len(ids), np.array(ids, dtype=np.int64).tobytes(), narrowed(np.array(vectors, dtype=np.int64))]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            flat, ends = batch.column(1).flatten().to_numpy(), np.cumsum(batch.column(1).value_lengths().to_numpy())
            for key, vector in zip(batch.column(0).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                held.setdefault(len(vector), []).append((key, vector))
                if len(held[len(vector)]) == size:
                    yield block(len(vector))
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, BLOCKS)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: as float64 where no sum can pass 2^53, as int64 where none can pass 2^63, else with Python's integers."""
    bound = (int(np.abs(q).max(initial=0)) or 1) * (int(np.abs(c).max(initial=0)) or 1) * max(1, q.shape[1])
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if bound < TOP:
        return q @ c.T
    return np.clip(q.astype(object) @ c.T.astype(object), -TOP, TOP).astype(np.int64)


def select(ids: np.ndarray, scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best by (score descending, id): how many, their ids, their scores."""
    low = np.where(valid, scores, -TOP)
    edge = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -TOP)
    count, out_ids, out_scores = np.zeros(len(low), dtype=np.int64), np.zeros((len(low), k), dtype=np.int64), np.zeros((len(low), k), dtype=np.int64)
    for i in range(len(low)):
        at = np.flatnonzero(valid[i] & (scores[i] >= edge[i]))
        at = at[np.lexsort((ids[i, at], -scores[i, at]))][:k]
        count[i], out_ids[i, : len(at)], out_scores[i, : len(at)] = len(at), ids[i, at], scores[i, at]
    return count, out_ids, out_scores


def merged(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One list for each query of several."""
    valid = np.concatenate([np.arange(ids.shape[1])[None, :] < count[:, None] for count, ids, _ in lists], axis=1)
    return select(np.concatenate([x for _, x, _ in lists], axis=1), np.concatenate([x for _, _, x in lists], axis=1), valid, k)


def packed(query_block: int, part: int, query_ids: bytes, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
    return query_block, part, query_ids, *(x.astype(np.int64).tobytes() for x in found)


def unpacked(row, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.counts, np.int64), np.frombuffer(row.ids, np.int64).reshape(-1, k), np.frombuffer(row.scores, np.int64).reshape(-1, k)


def top_k(df: DataFrame, k: int, id_column: str, vector_column: str, is_query, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row for which ``is_query`` (of the id column) holds."""
    rows = materialise(quantised(df, id_column, vector_column, scale), "vectors")
    shards = materialise(blocks(rows, SHARD), "shards")
    queries = materialise(blocks(rows.filter(is_query(F.col("id"))), QUERIES), "queries")
    n_shards, n_queries = shards.count(), queries.count()
    # A group is a few shards and a few query blocks; shards go to each row of the grid, query blocks to each column.
    across, down = max(1, math.ceil(n_shards / PER_GROUP)), max(1, math.ceil(n_queries / PER_GROUP))
    left = shards.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(across))).withColumn("h", F.explode(F.expr(f"sequence(0, {down - 1})")))
    right = queries.withColumn("h", F.pmod(F.xxhash64("block"), F.lit(down)).cast("int")).withColumn("g", F.explode(F.expr(f"sequence(0L, {across - 1}L)")))
    keys = ["dim", "g", "h"]

    def multiply(some_shards: pd.DataFrame, some_queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q in some_queries.itertuples():
            query_ids = np.frombuffer(q.ids, np.int64)
            x, found = widened(q.vectors).reshape(len(query_ids), -1), []
            for s in some_shards.itertuples():
                ids = np.frombuffer(s.ids, np.int64)
                scores = products(x, widened(s.vectors).reshape(len(ids), -1))
                found.append(select(np.broadcast_to(ids, scores.shape), scores, query_ids[:, None] != ids[None, :], k))
            if found:
                out.append(packed(q.block, int(q.g), q.ids, merged(found, k)))
        return pd.DataFrame(out, columns=NAMES)

    lists = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(multiply, LISTS)

    def merge(some: pd.DataFrame) -> pd.DataFrame:
        first = some.iloc[0]
        return pd.DataFrame([packed(first.query_block, first.part, first.query_ids, merged([unpacked(r, k) for r in some.itertuples()], k))], columns=NAMES)

    width = across
    while width > 1:
        width = math.ceil(width / FAN)
        lists = lists.withColumn("part", F.col("part") % width).groupBy("query_block", "part").applyInPandas(merge, LISTS)

    def spread(batches):
        for batch in rows_of(batches, 8):
            for row in batch.to_pandas().itertuples():
                q, (count, ids, scores) = np.frombuffer(row.query_ids, np.int64), unpacked(row, k)
                on = np.arange(k)[None, :] < count[:, None]
                rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), on.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, count)), pa.array(rank[on]), pa.array(ids[on]), pa.array(scores[on])], names=["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(spread, "query_id long, rank int, vec_id long, score long")
