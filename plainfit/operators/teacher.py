"""Strong teachers, correctors on residuals, blends, distillation and the evaluation grid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.gram import gram
from ..sources.scratch import materialise
from ..sources.tables import pending_pairs
from .additive import stump_gam
from .forest import Forest, forest
from .linear import ridge
from .model import linear_model


@dataclass
class Teacher:
    """A fitted boosted model over named columns."""

    cols: list[str]
    model: object

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """``df`` with predictions; rows with a null column have none."""
        whole = F.lit(True)
        for c in self.cols:
            whole = whole & F.col(c).isNotNull()
        filled = df.withColumns({f"__f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(self.cols)})
        names = [f"__f{i}" for i in range(len(self.cols))]
        data = VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="keep").transform(filled)
        return self.model.transform(data).withColumn(out, F.when(whole, F.col("__teacher"))).drop("__features", "__teacher", *names)


def teacher(df: DataFrame, cols: list[str], label: Column, kind: str = "rf", trees: int | None = None, depth: int | None = None, seed: int = 42, rate: float = 0.1) -> Teacher | Forest:
    """A random forest (50 trees of depth 5) or boosted trees (100 of depth 3, each counting ``rate``); rows with nulls are left out of the fit.

    Boosting is fitted on the distinct rows with their counts and mean labels: on squared errors that gives the same
    trees, and every round reads those rows only.
    """
    if kind == "rf":
        return forest(df, cols, label, trees or 50, depth or 5, seed)
    names = [f"__f{i}" for i in range(len(cols))]
    data = df.select(*(F.col(c).cast("double").alias(n) for n, c in zip(names, cols, strict=True)), label.cast("double").alias("__y")).na.drop()
    data = materialise(data.groupBy(*names).agg(F.avg("__y").alias("__y"), F.count(F.lit(1)).cast("double").alias("__w")), "distinct")
    data = VectorAssembler(inputCols=names, outputCol="__features").transform(data)
    made = GBTRegressor(featuresCol="__features", labelCol="__y", weightCol="__w", predictionCol="__teacher", maxDepth=depth or 3, seed=seed, maxIter=trees or 100, stepSize=rate)
    return Teacher(cols, made.fit(data))


@dataclass
class Corrected:
    """A readable model and, where its gate was open, a weighted teacher of its residuals.  ``base`` alone is the printed part."""

    base: object
    corrector: object | None
    weight: float

    def card(self) -> str:
        """The printed part, and that there is more where there is."""
        return self.base.card() + (f"\nplus {self.weight:g} times a corrector of the residuals that is not printed" if self.corrector is not None else "")

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        if self.corrector is None:
            return self.base.transform(df, out)
        both = self.base.transform(self.corrector.transform(df, "__residual"), out)
        return both.withColumn(out, F.col(out) + self.weight * F.coalesce("__residual", F.lit(0.0))).drop("__residual")


def with_additive_corrector(base, df: DataFrame, cols: list[str], label: Column, held_out: Column, gate: float = 0.1, **options) -> Corrected:
    """As ``with_corrector``, with cyclic boosted stumps of the residuals."""
    rest = label - base.column()
    left = df.agg((F.avg(F.pow(rest, 2)) / F.var_pop(F.when(rest.isNotNull(), label))).alias("share")).first().share
    options = {"cyclic": True, "rounds": 400, "straight": None, "passes": 0} | options
    return Corrected(base, stump_gam(df, cols, rest, held_out, **options) if left is not None and left > gate else None, 1.0)


def with_corrector(base, df: DataFrame, cols: list[str], label: Column, kind: str = "rf", gate: float = 0.1, weight: float = 1.0, **options) -> Corrected:
    """Fits residuals only if the base model leaves more than ``gate`` of the label's variance."""
    rest = label - base.column()
    left = df.agg((F.avg(F.pow(rest, 2)) / F.var_pop(F.when(rest.isNotNull(), label))).alias("share")).first().share
    return Corrected(base, teacher(df, cols, rest, kind, **options) if left is not None and left > gate else None, weight)


def blend_weights(df: DataFrame, predictions: list[str], label: Column) -> list[float]:
    """Weights of predictions, none negative, with sum 1 and the least squared error on the validation rows ``df``; equal ones without rows."""
    found = gram(df, {c: F.col(c) for c in predictions}, label)
    k = len(predictions)
    w = np.full(k, 1 / k)
    if not found or not next(iter(found.values())).n:
        return w.tolist()
    m = found[()]
    back = np.eye(k + 2)
    back[0, 1:] = m.center
    raw = (back.T @ m.matrix @ back)[1:, 1:]  # products about zero
    # errors of the predictions; their weighted sum is the blend's error, since the weights sum to 1
    d = raw[:-1, :-1] - raw[:-1, -1:] - raw[:-1, -1:].T + raw[-1, -1]
    for _ in range(2000):  # exchanges between pairs, each solved exactly
        moved = 0.0
        for i in range(k):
            for j in range(k):
                bend = d[i, i] + d[j, j] - 2 * d[i, j]
                if i != j and bend > 0:
                    step = float(np.clip((d[j] - d[i]) @ w / bend, -w[i], w[j]))
                    w[i], w[j], moved = w[i] + step, w[j] - step, max(moved, abs(step))
        if moved < 1e-12:
            break
    return w.tolist()


@dataclass
class Blend:
    """A weighted sum of fitted models, with an intercept of its own."""

    models: list
    weights: list[float]
    intercept: float

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        names = [f"__b{i}" for i in range(len(self.models))]
        for n, m in zip(names, self.models, strict=True):
            df = m.transform(df, n)
        total = sum((float(w) * F.col(n) for w, n in zip(self.weights, names, strict=True)), F.lit(float(self.intercept)))
        return df.withColumn(out, total).drop(*names)


def teacher_blend(df: DataFrame, cols: list[str], label: Column, held_out: Column, alpha: float = 1.0, trees: int | None = None, gbt: tuple[int, int, float] = (100, 3, 0.1), rf: tuple[int, int] = (50, 5)) -> Blend:
    """Boosted trees (number, depth, rate), a forest (number, depth) and a ridge, weighted by the held-out rows (none negative, sum 1), all fitted anew on all rows; the intercept follows the weights.

    ``trees`` replaces both numbers.
    """
    def fits(rows: DataFrame) -> list:
        m = gram(rows, {c: F.col(c) for c in cols}, label)[()]
        return [teacher(rows, cols, label, "gbt", trees or gbt[0], gbt[1], rate=gbt[2]), teacher(rows, cols, label, "rf", trees or rf[0], rf[1]), linear_model(ridge(m, alpha))]

    scored = df.filter(held_out).select(*cols, label.cast("double").alias("__y"))
    first, names = fits(df.filter(~held_out)), ["__b0", "__b1", "__b2"]
    for n, m in zip(names, first, strict=True):
        scored = m.transform(scored, n)
    scored = materialise(scored.select(*names, "__y"), "blend")
    weights = blend_weights(scored, names, F.col("__y"))
    gap = scored.agg(F.avg(F.col("__y") - sum((float(w) * F.col(n) for w, n in zip(weights, names, strict=True)), F.lit(0.0)))).first()[0]
    return Blend(fits(df), weights, gap or 0.0)


def distil(df: DataFrame, label: Column, said: object, student: Callable[[DataFrame, Column], object], alpha: float = 0.6) -> object:
    """What ``student`` (rows, label) learns from ``alpha`` of a teacher's prediction and the rest of the label itself."""
    rows = said.transform(df, "__said").withColumn("__target", blended(label, {"__said": 1.0}, alpha))
    return student(rows, F.col("__target"))


@dataclass
class DualPath:
    """A strong model for scoring tables and a readable one; which of them answers is asked for, not guessed."""

    batch: object
    symbolic: object

    def transform(self, df: DataFrame, out: str = "pred", mode: str = "batch") -> DataFrame:
        return {"batch": self.batch, "symbolic": self.symbolic}[mode].transform(df, out)

    def card(self) -> str:
        return self.symbolic.card() + "\n(tables are scored by another model unless mode is symbolic)"


def choose(candidates: dict[str, Callable[[DataFrame], object]], df: DataFrame, label: Column, fold: Column, k: int = 3) -> tuple[str, object, DataFrame]:
    """The candidate of least cross-validated squared error, fitted on all rows, and (model, rmse) of all."""
    errors = []
    for name, fit in candidates.items():
        e = cross_validated_error(df, fit, label, fold, k).agg((F.sum(F.pow("rmse", 2) * F.col("n")) / F.sum("n")).alias("mse")).first().mse
        errors.append((name, float(e) ** 0.5))
    best = min(errors, key=lambda x: x[1])[0]
    return best, candidates[best](df), df.sparkSession.createDataFrame(errors, "model string, rmse double")


@dataclass
class Calibrated:
    """slope * prediction + intercept."""

    model: object
    slope: float
    intercept: float

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return self.model.transform(df, out).withColumn(out, self.slope * F.col(out) + self.intercept)


def calibrate(model: object, df: DataFrame, label: Column) -> Calibrated:
    """The straight line that brings a fitted model's predictions closest to the label; as they are where they don't vary."""
    row = model.transform(df, "__said").agg(F.regr_slope(label, F.col("__said")).alias("b"), F.regr_intercept(label, F.col("__said")).alias("a")).first()
    return Calibrated(model, row.b if row.b is not None else 1.0, row.a if row.a is not None else 0.0)


def error_weights(df: DataFrame, predictions: list[str], label: Column) -> list[float]:
    """Weights of predictions in inverse proportion to their squared errors."""
    row = df.agg(*(F.avg(F.pow(label - F.col(c), 2)) for c in predictions)).first()
    w = np.array([1 / max(e or 0.0, 1e-300) for e in row])
    return (w / w.sum()).tolist()


def blended(label: Column, teachers: dict[str, float], alpha: float) -> Column:
    """The label to distil: ``alpha`` of the weighted teachers' predictions and the rest of the label itself."""
    return alpha * sum((w * F.col(c) for c, w in teachers.items()), F.lit(0.0)) + (1 - alpha) * label


def cross_validated_error(df: DataFrame, fit: Callable[[DataFrame], object], label: Column, fold: Column, k: int) -> DataFrame:
    """(fold, n, rmse): each fold is scored by what ``fit`` learns on the others.

    Models that are a Column score all folds in one pass, each row by its own fold's model.
    """
    parts = df.withColumn("__fold", fold.cast("int"))
    models = [fit(parts.filter(F.col("__fold") != i)) for i in range(k)]
    error = lambda pred: (F.count(pred).alias("n"), F.sqrt(F.avg(F.pow(label - F.col(pred), 2))).alias("rmse"))
    if all(hasattr(m, "column") for m in models):
        pred = F.coalesce(*(F.when(F.col("__fold") == i, m.column()) for i, m in enumerate(models)))
        scored = parts.withColumn("__pred", pred).groupBy(F.col("__fold").alias("fold")).agg(*error("__pred"))
        return df.sparkSession.range(k).select(F.col("id").cast("int").alias("fold")).join(scored, "fold", "left").select("fold", F.coalesce("n", F.lit(0)).alias("n"), "rmse")
    out = None
    for i, m in enumerate(models):
        one = m.transform(parts.filter(F.col("__fold") == i), "__pred").agg(F.lit(i).alias("fold"), *error("__pred"))
        out = one if out is None else out.unionByName(one)
    return out


def evaluate(models: dict[str, Callable[[DataFrame], object]], datasets: dict[str, tuple[DataFrame, DataFrame]], label: str, done: DataFrame | None = None, min_rows: int = 10) -> DataFrame:
    """(dataset, model, rmse, error): each model fitted and tested on each pair of (train, test); a failed fit has its message instead.

    Pairs of ``done`` (dataset, model) are left out, so that a run can be taken up again; a dataset of fewer than
    ``min_rows`` training rows has a message for every model.  The grid is as long as the two lists; all rows are read
    by Spark jobs.
    """
    spark = next(iter(datasets.values()))[0].sparkSession
    known = spark.createDataFrame([(d, m) for d in datasets for m in models], "dataset string, model string")
    open_ = {(r.dataset, r.model) for r in (known if done is None else pending_pairs(known, done)).collect()}  # as many as the two lists have pairs
    rows = []
    for name, (train, test) in datasets.items():
        left = {m: f for m, f in models.items() if (name, m) in open_}
        n = train.count() if left else 0
        if n < min_rows:
            rows += [(name, m, None, f"{n} rows are too few") for m in left]
            continue
        for model, fit in left.items():
            try:
                gap = fit(train).transform(test, "__pred").agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("__pred"), 2))).alias("rmse")).first()
                rows.append((name, model, gap.rmse, None))
            except Exception as e:  # a model that fails is a row of the result
                rows.append((name, model, None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]))
    return spark.createDataFrame(rows, "dataset string, model string, rmse double, error string")
