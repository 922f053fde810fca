"""The evaluation grid from moments: all linear and additive models on all datasets, fitted and tested from two jobs.

Rows carry their dataset and whether they are for testing.  One moment job and one binned job, keyed by both, reduce
them to a table for each pair; models are solved from the tables of the training rows, and their errors on the test rows
follow from the tables of those.  So the rows are read as often for one model as for many, and for one dataset as for a
thousand; trees and other models that need the rows themselves go through ``teacher.evaluate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bins import Binned, binned, edges_of
from ..plans.gram import MOST_GROUPS, Moments, gram
from .additive import backfitted
from .linear import Equation

#: What is solved from the moments of the training rows, and cell values and intercept from their bins.
Linear = Callable[[Moments], Equation]
Additive = Callable[[Binned], tuple[np.ndarray, float]]


def bin_means(b: Binned) -> tuple[np.ndarray, float]:
    """Backfitted bins: cell values and intercept."""
    f = backfitted(b)
    return f, (b.label_sum - np.diag(b.meet) @ f) / b.n


def _failed(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:300]


def moment_grid(rows: DataFrame, dataset: str, test: Column, cols: list[str], label: Column, linear: dict[str, Linear] | None = None, additive: dict[str, Additive] | None = None, bins: int = 16, edges: list[list[float]] | None = None, min_rows: int = 10) -> DataFrame:
    """(dataset, model, n, rmse, error): ``n`` test rows and the error on them; a failed fit has its message instead.

    Datasets are the values of the column, ``MOST_GROUPS`` at most, and those of fewer than ``min_rows`` training rows
    have a message for every model.  Rows with a null in a column or the label are left out.  Bins are those of all
    datasets together, or ``edges``.
    """
    keyed, spark = rows.withColumns({"__dataset": F.col(dataset), "__test": test.cast("boolean")}), rows.sparkSession
    linear, additive, out = linear or {}, additive or {}, []
    moments = gram(keyed, {c: F.col(c) for c in cols}, label, ["__dataset", "__test"]) if linear else {}
    tables: dict = {}
    if additive:
        names = sorted(r[0] for r in keyed.select("__dataset").filter("__dataset is not null").distinct().limit(MOST_GROUPS + 1).collect())
        if len(names) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} datasets")
        place = F.array_position(F.lit(names), F.col("__dataset")).cast("int")
        known = keyed.filter("__dataset is not null and __test is not null")
        found = binned(known, cols, label, edges_of(known, cols, bins) if edges is None else edges, 2 * (place - 1) + F.col("__test").cast("int")) if names else {}
        tables = {(names[k // 2], bool(k % 2)): b for k, b in found.items()}

    def add(name, model, size, tested, fit):
        if size < min_rows:
            out.append((name, model, tested, None, f"{size:g} rows are too few"))
            return
        try:
            sse = fit()
            out.append((name, model, tested, math.sqrt(sse / tested) if tested else None, None))
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:  # a model that fails is a row of the result
            out.append((name, model, tested, None, _failed(e)))

    for name in sorted({k[0] for k in moments if k[0] is not None}):
        train, held = moments.get((name, False)), moments.get((name, True))
        for model, solve in linear.items():
            add(name, model, train.rows if train else 0, int(held.rows) if held else 0, lambda solve=solve, train=train, held=held: (lambda e: held.sse(e.coef, e.intercept) if held else 0.0)(solve(train)))
    for name in sorted({k[0] for k in tables}):
        train, held = tables.get((name, False)), tables.get((name, True))
        for model, solve in additive.items():
            add(name, model, train.n if train else 0, int(held.n) if held else 0, lambda solve=solve, train=train, held=held: (lambda f, a: held.sse(f, a) if held else 0.0)(*solve(train)))
    kind = rows.schema[dataset].dataType.simpleString()
    return spark.createDataFrame(out, f"dataset {kind}, model string, n long, rmse double, error string")
