"""Vector codes: each of several parts of a vector is replaced by the number of its nearest codebook entry.

Codebooks are fitted on all vectors: distinct parts are counted once, sorted by ranges in lexicographic order and
stored, so a part that very many vectors share is one row with a weight.  Each batch of sorted parts is a trie whose
levels are the dimensions: a node holds the distances of its prefix to all entries, a child adds its own dimension to
the distances of its parent, and so parts with a common prefix share that work.  The trie is walked depth first in runs
of ``RUN`` leaves, which bounds what is held to ``RUN`` times the number of entries.  A leaf takes the least of its
distances and adds its weighted part to the sums of that entry.  Only sums leave a task, at most one row an entry; the
new entries (parts x entries rows) are made on the driver and broadcast, whose size is that of the codebooks.

All is exact: components are integers, floors go down, ties go to the lower entry, and wider integers are used where 64
bits could overflow.  Vectors that are null or hold null or non-finite components are dropped, and so are those of
another length than the first vector's or of one that the number of parts doesn't divide.  Components are held at 2^62,
errors at 2^63 - 1.  Null ids come last in the order of ids, repeated ids are ordered by their vectors, and each row is
coded.  With fewer vectors than entries there are as many entries as vectors.  Columns not asked for are ignored, and an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_name, rows_of

RUN, SALTS, TOP = 512, 16, (1 << 63) - 1


def quantised(x: Column, scale: int) -> Column:
    """floor(scale * component) of an array of doubles; null if a component is null or not finite."""
    top = float(2**62)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~bad, F.transform(x, lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-top)), F.lit(top)))))


def fitting(bound: int) -> type:
    """The least type for integers up to ``bound``: Python's own beyond 64 bits."""
    return next((t for t in (np.int32, np.int64) if bound <= np.iinfo(t).max), object)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each of ``parts``, which are in lexicographic order, and the squared distance to it."""
    widest = int(np.abs(parts).max(initial=0)) + int(np.abs(entries).max(initial=0))
    kind = fitting(widest * widest * max(1, parts.shape[1]))
    x, c = parts.astype(kind), entries.astype(kind)
    best, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=kind)
    for low in range(0, len(x), RUN):
        leaves = x[low : low + RUN]
        differs = np.logical_or.accumulate(leaves[1:] != leaves[:-1], axis=1)
        node, distance = np.zeros(len(leaves), dtype=np.int64), np.zeros((1, len(c)), dtype=kind)
        for j in range(x.shape[1]):
            first = np.append(0, np.flatnonzero(differs[:, j]) + 1)  # the first leaf below each node of this level
            distance = distance[node[first]] + (leaves[first, j, None] - c[None, :, j]) ** 2
            node = np.zeros(len(leaves), dtype=np.int64)
            node[first[1:]] = 1
            node = np.cumsum(node)
        least = distance.argmin(axis=1)
        best[low : low + RUN], error[low : low + RUN] = least[node], distance[np.arange(len(least)), least][node]
    return best, error


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and which of them each row is."""
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], back


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def stored_parts(rows: DataFrame, n_parts: int, width: int) -> DataFrame:
    """(position, part, n): the distinct parts at each position and how many vectors have them, sorted by ranges."""
    parts = F.posexplode(F.array(*(F.slice("v", k * width + 1, width) for k in range(n_parts)))).alias("position", "part")
    counted = rows.select(parts).groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    return materialise(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")


def moved(parts: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry that is nearest to some part becomes the floored mean of those."""
    width, shared = books[0].shape[1], parts.sparkSession.sparkContext.broadcast(books)
    schema = "position int, entry int, n long, sums array<decimal(38,0)>"
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38))]

    def run(batches):
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            position, part, n = batch.column(0).to_numpy(), matrix(batch.column(1), width), batch.column(2).to_numpy()
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                at = at[np.lexsort(part[at].T[::-1])]
                entry, _ = nearest(part[at], shared.value[p])
                kind = object if int(np.abs(part[at]).max(initial=0)) * int(n[at].sum()) > TOP else np.int64
                sums = np.zeros((len(shared.value[p]), width), dtype=kind)
                np.add.at(sums, entry, part[at].astype(kind) * n[at].astype(kind)[:, None])
                for e in np.unique(entry):
                    had = total.setdefault((int(p), int(e)), [0, [0] * width])
                    had[0] += int(n[at][entry == e].sum())
                    had[1] = [a + int(b) for a, b in zip(had[1], sums[e], strict=True)]
        rows = [(p, e, n, [Decimal(s) for s in sums]) for (p, e), (n, sums) in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["position", "entry", "n", "sums"])

    summed = parts.mapInArrow(run, schema).groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    books = [b.copy() for b in books]
    for r in summed.collect():  # at most one row for each entry
        books[r.position][r.entry] = [int(s) // r.n for s in r.sums]
    return books


def fitted(rows: DataFrame, n_parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], DataFrame]:
    """The codebooks of stored rows (id, v, ...), and the rows that have their length."""
    usable = rows.filter((F.size("v") > 0) & (F.size("v") % n_parts == 0))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = usable.select("id", "v").orderBy(*order).first()
    if first is None:
        return [], usable
    width = len(first.v) // n_parts
    usable = usable.filter(F.size("v") == len(first.v))
    start = np.array([r.v for r in usable.select("id", "v").orderBy(*order).limit(entries).collect()], dtype=np.int64)
    books = [start[:, k * width : (k + 1) * width].copy() for k in range(n_parts)]
    parts = stored_parts(usable, n_parts, width)
    for _ in range(rounds):
        books = moved(parts, books)
    return books, usable


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(df: DataFrame, id_column: str, vector_column: str, keep: Sequence[str] = (), n_parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, kept columns, code, error) of every usable vector, and the codebooks."""
    kept = [F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)]
    x = F.col(f"`{vector_column}`").cast("array<double>")
    rows = materialise(df.select(F.col(f"`{id_column}`").cast("long").alias("id"), quantised(x, scale).alias("v"), *kept).filter(F.col("v").isNotNull()), "vectors")
    books, usable = fitted(rows, n_parts, entries, rounds)
    shared, digits = df.sparkSession.sparkContext.broadcast(books), max(2, len(f"{entries - 1:x}"))
    others = [c for c in usable.columns if c != "v"]
    schema = T.StructType([*(usable.schema[c] for c in others), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in rows_of(batches, 5000):
            at, codes, errors = batch.schema.get_field_index("v"), [], []
            for k, book in enumerate(shared.value):
                width = book.shape[1]
                found, back = distinct(matrix(batch.column(at), width * n_parts)[:, k * width : (k + 1) * width])
                best, error = nearest(found, book)
                codes.append(np.array([f"{i:0{digits}x}" for i in range(len(book))], dtype=object)[best][back])
                errors.append(error.astype(object)[back])
            made = [pa.array([min(e, TOP) for e in sum(errors)], pa.int64())] if errors else [pa.nulls(batch.num_rows, pa.int64())]
            code = pa.array(sum(codes[1:], codes[0]), pa.string()) if codes else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), code, *made], names=[*others, "code", "error"])

    coded = usable.mapInArrow(run, schema)
    return coded.select(F.col("id").alias(id_column), *(F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)), "code", "error"), books


def with_group_error(coded: DataFrame, group: str, out: str) -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of the same ``group``, nulls together.

    Sums are made before anything is joined, and rows of one group are dealt to ``SALTS`` keys.
    """
    salt, total = new_name(coded, "salt"), new_name(coded, "total")
    sums = coded.groupBy(F.col(group).alias(f"{total}_of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP)).cast("long").alias(total))
    sums = sums.withColumn(f"{salt}_of", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    dealt = coded.withColumn(salt, F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(sums, F.col(group).eqNullSafe(F.col(f"{total}_of")) & (F.col(salt) == F.col(f"{salt}_of")))
    return joined.select(*(F.col(c) for c in coded.columns), F.col(total).alias(out))
