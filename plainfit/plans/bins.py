"""The binned moment job: one pass gives how often two columns' bins meet, and the label's sum in each bin."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Binned:
    """Cells are the bins of all columns, one column after another; ``edges[j]`` are right-closed bounds of column j."""

    names: list[str]
    edges: list[list[float]]
    meet: np.ndarray  # cells x cells: rows in both
    labels: np.ndarray  # cells: sums of the label
    values: np.ndarray  # cells: sums of the column's own value
    squares: float  # sum of the squared label

    def __add__(self, other: Binned) -> Binned:
        return Binned(self.names, self.edges, self.meet + other.meet, self.labels + other.labels, self.values + other.values, self.squares + other.squares)

    @property
    def cells(self) -> list[slice]:
        stops = np.cumsum([len(e) + 1 for e in self.edges]).tolist()
        return [slice(a, b) for a, b in zip([0, *stops], stops, strict=False)]

    @property
    def n(self) -> float:
        return float(self.meet[self.cells[0], self.cells[0]].sum())

    @property
    def label_sum(self) -> float:
        return float(self.labels[self.cells[0]].sum())

    def sse(self, f: np.ndarray, intercept: float) -> float:
        """Squared error of intercept + the sum of each row's cells of ``f``."""
        counts = np.diag(self.meet)
        cross = self.squares - 2 * (self.labels @ f + intercept * self.label_sum)
        return float(max(0.0, cross + f @ self.meet @ f + 2 * intercept * (counts @ f) + self.n * intercept**2))


def edges_of(df: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """Inner quantiles without repeats; a constant column has none.  Approximate at a ten-thousandth, so that memory has a bound."""
    qs = [i / bins for i in range(1, bins)]
    row = df.agg(*(F.percentile_approx(c, qs, 10_000).alias(f"q{i}") for i, c in enumerate(cols)), *(F.max(c).alias(f"m{i}") for i, c in enumerate(cols))).first()
    return [sorted({float(q) for q in row[f"q{i}"] or [] if q < row[f"m{i}"]}) for i in range(len(cols))]


def binned(df: DataFrame, cols: list[str], label: Column, edges: list[list[float]], by: Column | None = None) -> dict:
    """A ``Binned`` for each value of ``by``; rows with a null or NaN in a column or the label are left out.

    A task holds one table of cells x cells for each group, and what it sends is that table's filled cells.
    """
    parts = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)] + [label.cast("double").alias("y")]
    data = df.select((F.lit(0) if by is None else by.cast("int")).alias("g"), *parts).na.drop()  # NaN too
    sizes = [len(e) + 1 for e in edges]
    total = sum(sizes)
    offsets = np.cumsum([0, *sizes[:-1]])

    def partial(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            group, y = batch.column(0).to_numpy(), batch.column(len(cols) + 1).to_numpy()
            xs = [batch.column(i + 1).to_numpy() for i in range(len(cols))]
            codes = [o + np.searchsorted(e, x, side="left") for o, e, x in zip(offsets, edges, xs, strict=True)]
            for g in np.unique(group):
                at = group == g
                t = tables.setdefault(int(g), np.zeros((total + 3, total)))
                for i, a in enumerate(codes):
                    for b in codes[i:]:
                        t[:total] += np.bincount(a[at] * total + b[at], minlength=total * total).reshape(total, total)
                    t[total] += np.bincount(a[at], y[at], total)
                    t[total + 1] += np.bincount(a[at], xs[i][at], total)
                t[total + 2, 0] += y[at] @ y[at]
        for g, t in tables.items():
            cell = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), g, np.int32)), pa.array(cell), pa.array(t.ravel()[cell])], names=["g", "cell", "v"])

    out: dict = {}
    for r in data.mapInArrow(partial, "g int, cell long, v double").groupBy("g", "cell").agg(F.sum("v").alias("v")).collect():  # bounded by the cells
        out.setdefault(r.g, np.zeros((total + 3, total))).flat[r.cell] = r.v
    return {g: Binned(cols, edges, np.triu(t[:total]) + np.triu(t[:total], 1).T, t[total], t[total + 1], float(t[total + 2, 0])) for g, t in out.items()}
