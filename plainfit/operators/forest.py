"""Random forests of bootstrapped rows, grown level by level: one job counts a level of many trees over a table of binned rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bins import edges_of
from ..sources.scratch import materialise
from .aggregate import best_split

#: Bins of a column, as in Spark's trees.
BINS = 32
#: Columns of up to about so many values are cut by counts of their values.
FEW = 5_000
#: So many trees grow side by side; their draws are stored with the rows.
TREES = 20
#: So many rows are added up at once, and so many distinct ones held by a task before it passes them on.
ROWS, DISTINCT = 1 << 16, 1 << 17
#: Cells of a task's table of open nodes; more nodes take several jobs.
CELLS = 1 << 22


def _walk(x: np.ndarray, column: np.ndarray, cut: np.ndarray, left: np.ndarray, root: int, depth: int) -> np.ndarray:
    """The node at which each of ``x`` (columns x rows) ends; values up to ``cut`` go left, others to the node beside it."""
    at, rows = np.full(x.shape[1], root), np.arange(x.shape[1])
    for _ in range(depth):
        c = column[at]
        at = np.where(c < 0, at, left[at] + (x[c, rows] > cut[at]))
    return at


@dataclass
class Forest:
    """The mean of trees over named columns; all trees' nodes are in one list, a leaf has no ``column`` (-1)."""

    cols: list[str]
    roots: list[int]
    depth: int
    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """``df`` with predictions; rows with a null column have none."""
        roots, depth, value, nodes = self.roots, self.depth, self.value, (self.column, self.threshold, self.left)

        @F.pandas_udf("double")
        def score(*xs: pd.Series) -> pd.Series:
            x = np.stack([v.to_numpy() for v in xs])
            return pd.Series(sum(value[_walk(x, *nodes, r, depth)] for r in roots) / len(roots))

        whole = F.lit(True)
        for c in self.cols:
            whole = whole & F.col(c).isNotNull()
        return df.withColumn(out, F.when(whole, score(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.cols))))


def cuts_of(df: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper bounds of the bins but the last: all values of a column that has no more than ``bins``, quantiles of others.

    Columns of few values are counted, which takes a fraction of the time of quantiles.
    """
    near = df.agg(*(F.approx_count_distinct(c) for c in cols)).first()
    few = [c for c, n in zip(cols, near, strict=True) if n <= FEW]
    counts: dict[str, list] = {c: [] for c in few}
    if few:
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in few)))
        for r in df.groupBy(*few).count().select(each.alias("x"), "count").groupBy("x.c", "x.v").agg(F.sum("count").alias("n")).collect():  # about FEW values of a column
            counts[r.c].append((r.v, r.n))
    out = {}
    for c, found in counts.items():
        v, n = np.array(sorted(found), dtype=float).reshape(-1, 2).T
        at = np.arange(len(v)) if len(v) <= bins else np.unique(np.searchsorted(np.cumsum(n), n.sum() * np.arange(1, bins) / bins))
        out[c] = v[at[at < len(v) - 1]].tolist()
    rest = [c for c in cols if c not in out]
    out |= dict(zip(rest, edges_of(df, rest, bins), strict=True)) if rest else {}
    return [out[c] for c in cols]


def _drawn(data: DataFrame, edges: list[list[float]], middle: float, trees: int, seed: int) -> DataFrame:
    """(codes, w, s) of binned rows: how often each tree's bootstrap drew them, by Poisson's law row by row, and the sums of the labels less ``middle`` that it drew.

    Equal rows are added up within a task, as far as it holds them.
    """
    d, sizes = len(edges), [len(e) + 1 for e in edges]

    def added(codes, w, s):
        if np.prod(sizes, dtype=float) < 2**62:
            key = np.ravel_multi_index(tuple(codes), sizes)
        else:
            key = np.zeros(codes.shape[1], dtype=np.int64)
            for c, n in zip(codes, sizes, strict=True):
                key = np.unique(key * n + c, return_inverse=True)[1]
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        total = lambda v: np.stack([np.bincount(at, x, len(first)) for x in v])
        return codes[:, first], total(w), total(s)

    def run(batches):
        rng, waiting, held = np.random.default_rng([seed, TaskContext.get().partitionId()]), [], None

        def together():
            x = np.concatenate(waiting, axis=1)
            codes = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, x[:d], strict=True)])
            w = rng.poisson(1.0, (trees, x.shape[1])).astype(np.float64)
            new = added(codes, w, w * x[d])
            waiting.clear()
            return new if held is None else added(*(np.concatenate(both, axis=1) for both in zip(held, new, strict=True)))

        def rows(codes, w, s):
            for i in range(0, codes.shape[1], 10_000):
                flat = lambda v, t: pa.array(list(v[:, i : i + 10_000].T), pa.list_(t))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([flat(codes, pa.int32()), flat(w, pa.float64()), flat(s, pa.float64())], names=["codes", "w", "s"])

        for batch in batches:
            waiting.append(np.stack([c.to_numpy() for c in batch.columns[:d]] + [batch.column(d).to_numpy() - middle]))
            if sum(x.shape[1] for x in waiting) >= ROWS:
                held = together()
                if held[0].shape[1] > DISTINCT:
                    yield from rows(*held)
                    held = None
        if waiting:
            held = together()
        if held is not None:
            yield from rows(*held)

    return materialise(data.mapInArrow(run, "codes array<int>, w array<double>, s array<double>"), "drawn")


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, draws and sums, each as one row for a column or tree."""
    return tuple(np.ascontiguousarray(c.flatten().to_numpy().reshape(batch.num_rows, -1).T) for c in batch.columns)


def _grown(drawn: DataFrame, d: int, trees: int, depth: int, tried: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(column, cut, left, value) of the nodes of all trees; each node tries ``tried`` columns, drawn anew."""
    column, cut, left, tree = [-1] * trees, [0] * trees, [0] * trees, list(range(trees))
    open_, each = list(range(trees)), tried * BINS
    for level in range(depth):
        found = []
        for i in range(0, len(open_), max(1, CELLS // each)):
            some = open_[i : i + max(1, CELLS // each)]  # in order of their trees
            pick = np.stack([rng.permutation(d)[:tried] for _ in some])
            found += _splits(drawn, d, (np.array(column), np.array(cut), np.array(left)), level, np.array(some), np.array([tree[k] for k in some]), pick)
        open_ = []
        for r in sorted(found, key=lambda r: r.node):
            column[r.node], cut[r.node], left[r.node] = r.best.col, r.best.bin, len(column)
            open_ += [len(column), len(column) + 1]
            for many, v in ((column, -1), (cut, 0), (left, 0), (tree, tree[r.node])):
                many += [v, v]
        open_.sort(key=lambda k: tree[k])
        if not open_:
            break
    nodes = np.array(column), np.array(cut), np.array(left)

    def leaves(batches):
        sums = np.zeros((2, len(column)))
        for batch in batches:
            x, w, s = _arrays(batch)
            for t in range(trees):
                at = _walk(x, *nodes, t, depth)
                sums += [np.bincount(at, w[t], len(column)), np.bincount(at, s[t], len(column))]
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["node", "n", "s"])

    value = np.zeros(len(column))
    for r in drawn.mapInArrow(leaves, "node int, n double, s double").groupBy("node").agg((F.sum("s") / F.sum("n")).alias("v")).collect():  # as many as the forest has leaves
        value[r.node] = r.v
    return *nodes, value


def _splits(drawn: DataFrame, d: int, nodes: tuple[np.ndarray, ...], level: int, some: np.ndarray, tree: np.ndarray, pick: np.ndarray) -> list:
    """(node, best) with the column and bin of those of ``some`` nodes that gain by a split on one of their columns in ``pick``."""
    tried = pick.shape[1]
    each, place = tried * BINS, np.full(len(nodes[0]), -1)
    place[some] = np.arange(len(some))

    def count(batches):
        table = np.zeros((2, len(some) * each))
        for batch in batches:
            x, w, s = _arrays(batch)
            for t in np.unique(tree).tolist():
                a, b = np.searchsorted(tree, [t, t + 1])
                at = place[_walk(x, *nodes, t, level)]
                rows = np.flatnonzero((at >= 0) & (w[t] > 0))
                at = at[rows]
                for j in range(tried):
                    key = (at - a) * each + j * BINS + x[pick[at, j], rows]
                    for v, into in ((w, table[0]), (s, table[1])):
                        into[a * each : b * each] += np.bincount(key, v[t, rows], (b - a) * each)
        cell = np.flatnonzero(table[0])
        at, j = cell // each, cell % each // BINS
        yield pa.RecordBatch.from_arrays([pa.array(some[at] * d + pick[at, j]), pa.array((cell % BINS).astype(np.int32)), *(pa.array(v[cell]) for v in table)], names=["feature", "bin", "n", "s"])

    # A feature is a column at a node; its rows are dealt once for the sums, the running sums and the best bin.
    counts = drawn.mapInArrow(count, "feature long, bin int, n double, s double").repartition("feature").groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = best_split(counts, 1).filter("gain > 0").select(F.expr(f"feature div {d}").alias("node"), (F.col("feature") % d).alias("col"), "bin", "gain")
    return best.groupBy("node").agg(F.max(F.struct("gain", (-F.col("col")).alias("back"), "col", "bin")).alias("best")).collect()  # no more than open nodes


def forest(df: DataFrame, cols: list[str], label: Column, trees: int = 50, depth: int = 5, seed: int = 42) -> Forest:
    """Trees on bootstrapped rows, a third of the columns tried at each node (all by a single tree); rows with nulls are left out of the fit."""
    data = df.select(*(F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(cols)), label.cast("double").alias("__y")).na.drop()
    edges = cuts_of(data, [f"__f{i}" for i in range(len(cols))])
    middle = data.agg(F.avg("__y")).first()[0]
    if middle is None:
        raise ValueError("no rows to fit")
    tried = len(cols) if trees == 1 else -(-len(cols) // 3)
    parts = []
    for first in range(0, trees, TREES):
        n = min(TREES, trees - first)
        drawn = _drawn(data, edges, middle, n, seed + first)
        parts.append((n, *_grown(drawn, len(cols), n, depth, tried, np.random.default_rng([seed, first]))))
    starts = np.cumsum([0, *(len(p[1]) for p in parts)]).tolist()
    column, cut, left, value = (np.concatenate(v) for v in zip(*((c, k, at + start, v) for start, (_, c, k, at, v) in zip(starts, parts, strict=False)), strict=True))
    threshold = np.array([edges[c][k] if c >= 0 else 0.0 for c, k in zip(column.tolist(), cut.tolist(), strict=True)])
    return Forest(cols, [start + t for start, p in zip(starts, parts, strict=False) for t in range(p[0])], depth, column, threshold, left, value + middle)
