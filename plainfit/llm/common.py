"""What several operators of this subpackage share: scratch tables, batches, hashes, word splitting and components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialise, shared_path

__all__ = ["MIX_A", "MIX_B", "WORD", "WordHashes", "connected_components", "materialise", "mix64", "new_name", "rows_of", "shared_path", "shingle_hashes", "text_or_empty", "with_columns", "words_of"]

#: A word is a maximal run of letters and digits of the lower-cased text.
WORD = re.compile(r"[^\W_]+")
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def rows_of(batches: Iterator[pa.RecordBatch], at_most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``at_most``, so that what is held at a time has a bound."""
    for batch in batches:
        for i in range(0, batch.num_rows, at_most):
            yield batch.slice(i, at_most)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, elementwise."""
    h = h ^ (h >> np.uint64(31))
    h = h * MIX_A
    h = h ^ (h >> np.uint64(29))
    h = h * MIX_B
    return h ^ (h >> np.uint64(32))


class WordHashes:
    """64-bit word hashes with a bounded two-generation memo: frequent words stay, rare ones go."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.young, self.old = limit, {}, {}

    def _miss(self, word: str) -> int:
        if (h := self.old.get(word)) is None:
            h = xxhash.xxh3_64_intdigest(word.encode())
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        got = list(map(self.young.get, words))
        if None in got:
            miss = self._miss
            got = [miss(words[i]) if v is None else v for i, v in enumerate(got)]
        return np.array(got, dtype=np.uint64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter non-empty text is one shingle; no words, none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix64(out ^ word_hashes[i : n - size + 1 + i])
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def new_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be none of the columns of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_columns(df: DataFrame, read: Column, make: Callable[[list], list], fields: list[tuple[str, T.DataType, pa.DataType]], at_most: int = 2000) -> DataFrame:
    """``df`` with columns that ``make(list of values)`` gives, as one list each, for the values of ``read``, batch by batch.

    Columns of ``df`` that go by one of the new names are replaced.
    """
    names = {n.lower() for n, _, _ in fields}
    keep = [c for c in df.columns if c.lower() not in names]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t, _ in fields)])
    inner = df.select(*(F.col(f"`{c}`") for c in keep), read.alias(new_name(df, "read")))

    def run(batches):
        for batch in rows_of(batches, at_most):
            made = make(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(m, t) for m, (_, _, t) in zip(made, fields, strict=True))], names=[*keep, *(n for n, _, _ in fields)])

    return inner.mapInArrow(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph of ``edges`` (src long, dst long); a component is its least node.

    Alternates large-star and small-star rounds on edges (u, v), u > v.  Least neighbours are found by partial
    aggregates and stored before they are joined to the edges, so that the join is between two tables by itself and
    Spark can split the partition of a node with very many neighbours.  Every round is written to the shared folder;
    only two counts reach the driver.
    """
    edges = materialise(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u != v").distinct(), "cc")
    for _ in range(max_rounds):
        # Large star: the greater end of an edge moves on to the least neighbour of the smaller one.
        lower = materialise(edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), "cc")
        large = edges.join(lower, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        large = materialise(large.groupBy("u", "v").agg(F.max("moved").alias("moved")), "cc")
        # Small star: the smaller neighbours of a node hang on to the least of them.
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"), F.max("moved").alias("moved")), "cc")
        state = low.agg(F.max("moved").alias("moved"), F.max("n").alias("n")).first()
        stars = low.select("u", F.col("m").alias("v"))
        if not state.moved and (state.n or 1) == 1:
            break
        if state.n > 1:
            several = large.join(low.filter("n > 1").select("u", "m"), "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            stars = stars.union(several).distinct()
        edges = materialise(stars, "cc")
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
