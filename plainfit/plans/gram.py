"""The moment job: one pass gives sum(w * [1, z, y]' [1, z, y]) for each group, and fits are solved from that alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many columns the moments are plain sums in generated code; beyond, Arrow batches and matrix products.
MOST_PLAIN = 8
#: So many groups' moments may come to the driver; fits of more groups stay with ``fit_by``.
MOST_GROUPS = 10_000


@dataclass
class Moments:
    """Moments about ``center``: ``matrix`` over (1, columns..., label), all minus their centers but the 1; ``rows`` counts rows without weights."""

    names: list[str]
    center: np.ndarray
    matrix: np.ndarray
    rows: float = 0.0

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.names, self.center, self.matrix + other.matrix, self.rows + other.rows)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.names, self.center, self.matrix - other.matrix, self.rows - other.rows)

    def centered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """(means, S = cross products about the means, columns with label, label's own, label's mean)."""
        mean = self.matrix[0, 1:] / self.n
        s = self.matrix[1:, 1:] - self.n * np.outer(mean, mean)
        full = mean + self.center
        return full[:-1], s[:-1, :-1], s[:-1, -1], float(s[-1, -1]), float(full[-1])

    def sse(self, coef: np.ndarray, intercept: float) -> float:
        """Squared error of an equation on the rows of these moments."""
        b = np.concatenate([[-intercept - coef @ self.center[:-1] + self.center[-1]], -coef, [1.0]])
        return float(max(0.0, b @ self.matrix @ b))

    def only(self, keep: list[int]) -> Moments:
        """The same rows' moments of some of the columns."""
        at = [0, *(k + 1 for k in keep), len(self.names) + 1]
        return Moments([self.names[k] for k in keep], self.center[[*keep, -1]], self.matrix[np.ix_(at, at)], self.rows)


#: So many rows give the centers, which only have to be near the data.
CENTER_ROWS = 512


def _gram_table(df: DataFrame, cols: dict[str, Column], label: Column, by: list[str], weight: Column | None) -> tuple[DataFrame, np.ndarray, list[tuple[int, int]]]:
    """(by..., m array<double>, rows) with a row for each group, the centers, and the places of ``m``.

    Moments are about the means of the first few rows, so that large offsets don't cancel; what is solved from them
    doesn't depend on that choice.  Rows with a null or NaN are left out.
    """
    p = len(cols) + 1
    data = df.select(*by, *(c.cast("double").alias(f"__x{i}") for i, c in enumerate(cols.values())), label.cast("double").alias(f"__x{p - 1}"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("__w"))
    xs = [f"__x{i}" for i in range(p)]
    few = np.array([[np.nan if x is None else x for x in r] for r in data.select(*xs).limit(CENTER_ROWS).collect()], dtype=float).reshape(-1, p)
    known = np.isfinite(few)
    center = np.where(known, few, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    if p <= MOST_PLAIN:
        data = data.filter(F.expr(" and ".join(f"{c} is not null and not isnan({c})" for c in [*xs, "__w"])))
        value = [F.lit(1.0), *(F.col(c) - float(m) for c, m in zip(xs, center, strict=True))]
        sums = [F.coalesce(F.sum(F.col("__w") * value[i] * value[j]), F.lit(0.0)) for i, j in pairs]
        return data.groupBy(*by).agg(F.array(*sums).alias("m"), F.count(F.lit(1)).cast("double").alias("rows")), center, pairs
    kinds = T.StructType([*data.select(*by).schema, T.StructField("m", T.ArrayType(T.DoubleType())), T.StructField("rows", T.DoubleType())])
    upper, names, weighted = np.triu_indices(p + 1), [*by, "m", "rows"], weight is not None

    def partial(batches):
        # Nulls come as NaN and are left out here, so that Spark works every column out once.
        sums: dict[tuple, list] = {}
        for batch in batches:
            x = np.empty((p + 1, batch.num_rows))
            x[0] = 1.0
            for i, (c, m) in enumerate(zip(xs, center, strict=True)):
                np.subtract(batch.column(c).to_numpy(zero_copy_only=False), m, out=x[i + 1])
            w = batch.column("__w").to_numpy(zero_copy_only=False)
            keep = ~np.isnan(x.sum(axis=0) + w)
            if not keep.all():  # infinities of either sign add up to NaN, but stay
                keep = ~(np.isnan(x).any(axis=0) | np.isnan(w))
            group, at = np.zeros(batch.num_rows, dtype=np.int64), np.flatnonzero(keep)
            for c in by:  # codes of the distinct keys, column by column
                codes = batch.column(c).dictionary_encode(null_encoding="encode")
                group = np.unique(group * len(codes.dictionary) + codes.indices.to_numpy(), return_inverse=True)[1]
            if by:
                at = at[np.argsort(group[at], kind="stable")]
            parts = np.split(at, np.flatnonzero(np.diff(group[at])) + 1) if by and len(at) else [at] if len(at) else []
            for at in parts:
                part = x if len(at) == batch.num_rows and not by else x[:, at]
                key = tuple(batch.column(c)[int(at[0])].as_py() for c in by)
                m, n = sums.get(key, (0, 0))
                sums[key] = (m + ((part * w[at]) if weighted else part) @ part.T, n + len(at))
        if sums:
            keys = [pa.array([k[i] for k in sums]).cast(batch.schema.field(b).type) for i, b in enumerate(by)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([m[upper].tolist() for m, _ in sums.values()], pa.list_(pa.float64())), pa.array([float(n) for _, n in sums.values()])], names=names)

    each = data.mapInArrow(partial, kinds).select(*by, F.posexplode(F.concat("m", F.array("rows"))).alias("i", "v")).groupBy(*by, "i").agg(F.sum("v").alias("v"))
    whole = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("m"))  # as long as the matrix
    return whole.filter(F.size("m") > 0).select(*by, F.slice("m", 1, len(pairs)).alias("m"), F.element_at("m", -1).alias("rows")), center, pairs


def _moments(names: list[str], center: np.ndarray, pairs: list[tuple[int, int]], values, rows: float) -> Moments:
    m = np.zeros((len(center) + 1,) * 2)
    i, j = np.array(pairs).T
    m[i, j] = m[j, i] = values
    return Moments(names, center, m, rows)


def gram(df: DataFrame, cols: dict[str, Column], label: Column, by: list[str] | None = None, weight: Column | None = None) -> dict[tuple, Moments]:
    """Moments of each group; rows with a null in a column, label or weight are left out.

    One matrix for each group comes to the driver, for folds, replicates and segments up to ``MOST_GROUPS``; beyond,
    use ``fit_by``.
    """
    by = by or []
    table, center, pairs = _gram_table(df, cols, label, by, weight)
    found = table.limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: solve them with fit_by")
    return {tuple(r[c] for c in by): _moments(list(cols), center, pairs, r["m"], r["rows"]) for r in found}


def fit_by(df: DataFrame, cols: dict[str, Column], label: Column, by: list[str], solve: Callable[[Moments], object], weight: Column | None = None) -> DataFrame:
    """(by..., coef array<double>, intercept, n, rmse): an equation for each group, solved from its moments in the executors."""
    table, center, pairs = _gram_table(df, cols, label, by, weight)
    names = list(cols)
    schema = T.StructType([*table.select(*by).schema, T.StructField("coef", T.ArrayType(T.DoubleType())), *(T.StructField(n, T.DoubleType()) for n in ("intercept", "n", "rmse"))])

    def run(batches):
        for batch in batches:
            out = []
            for m, rows in zip(batch.column("m").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                part = _moments(names, center, pairs, m, rows)
                fit = solve(part)
                out.append((np.asarray(fit.coef, dtype=float).tolist(), float(fit.intercept), part.rows, (part.sse(fit.coef, fit.intercept) / part.n) ** 0.5))
            cols_ = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(b) for b in by), *(pa.array(c, t) for c, t in zip(cols_, [pa.list_(pa.float64()), *[pa.float64()] * 3], strict=True))], names=schema.names)

    return table.mapInArrow(run, schema)
