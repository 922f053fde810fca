"""Preparation: missing values, encodings, clipping, standardisation, splits, folds and replicates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clip, numeric
from ..plans.gram import Moments
from ..plans.order import exact_quantiles, running


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: numeric(c) for c in cols})


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of numeric columns and of the others."""
    number = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return number, [c for c in df.columns if c not in number]


def quantiles(df: DataFrame, cols: list[str], qs: list[float], approximate: bool = False) -> dict[str, list[float]]:
    """Quantile lists of columns: exact ones from counts of values by ranges, or all in one pass, each within a ten-thousandth of its rank."""
    if approximate:
        row = df.agg(*(F.percentile_approx(F.col(c), qs, 10_000).alias(c) for c in cols)).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(qs) for c in cols}
    long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("__at"), F.col(c).cast("double").alias("__value")) for i, c in enumerate(cols)))).alias("__e")).select("__e.*")
    found = {cols[r[0]]: list(r)[1:] for r in exact_quantiles(long, "__value", qs, ["__at"]).collect()}  # a row for each column
    return {c: found.get(c, [None] * len(qs)) for c in cols}


@dataclass
class MedianImputer:
    """Medians of the training rows for nulls; infinities and NaN count as null."""

    cols: list[str]
    medians: dict[str, float] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> MedianImputer:
        self.medians = {c: q[0] for c, q in quantiles(to_numeric(train, self.cols), self.cols, [0.5]).items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(numeric(c), F.lit(self.medians[c])) for c in self.cols})


@dataclass
class OrdinalEncoder:
    """Sorted categories of the training rows as 0, 1, ...; unseen and null ones are -1.

    The dictionary stays a table and is joined, so that it may have any number of categories.
    """

    col: str
    codes: DataFrame | None = None

    def fit(self, train: DataFrame) -> OrdinalEncoder:
        levels = train.select(F.col(self.col)).na.drop().distinct().withColumn("__one", F.lit(1))
        self.codes = running(levels, self.col, "__one", "__code").select(self.col, F.col("__code").cast("long"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.codes, self.col, "left").withColumn(self.col, F.coalesce("__code", F.lit(-1))).drop("__code")


def dummies(df: DataFrame, col: str, levels: list, drop_first: bool = True, ref=None) -> DataFrame:
    """An indicator for each level but the reference (the first, or ``ref``)."""
    ref = ref if ref is not None else levels[0] if drop_first else None
    return df.withColumns({f"{col}_{v}": F.when(F.col(col) == v, 1.0).otherwise(0.0) for v in levels if v != ref})


@dataclass
class Winsorizer:
    """Holds columns within two percentiles of the training rows."""

    cols: list[str]
    low: float = 0.01
    high: float = 0.99
    bounds: dict[str, list[float]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> Winsorizer:
        self.bounds = quantiles(train, self.cols, [self.low, self.high])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(F.col(c), *self.bounds[c]) for c in self.cols})


@dataclass
class Scaler:
    """Columns as (c - shift) / width by the training rows: mean and deviation (``standard``) or minimum and range (``minmax``).

    ``unscale`` turns coefficients of scaled columns into those of the raw ones, so that scoring needs no scaled copy.
    """

    cols: list[str]
    kind: str = "standard"
    shift: dict[str, float] = field(default_factory=dict)
    width: dict[str, float] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> Scaler:
        pairs = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}[self.kind]
        row = train.agg(*(f(c).cast("double").alias(f"{k}{i}") for i, c in enumerate(self.cols) for k, f in zip("ab", pairs, strict=True))).first()
        self.shift = {c: row[f"a{i}"] or 0.0 for i, c in enumerate(self.cols)}
        self.width = {c: row[f"b{i}"] or 1.0 for i, c in enumerate(self.cols)}  # a constant column is only shifted
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.shift[c]) / self.width[c] for c in self.cols})

    def unscale(self, coef: dict[str, float], intercept: float) -> tuple[dict[str, float], float]:
        raw = {c: b / self.width[c] for c, b in coef.items()}
        return raw, intercept - sum(raw[c] * self.shift[c] for c in coef)


def check_size(m: Moments, min_rows: int = 10, min_features: int = 1) -> bool:
    """Whether a fit is worth while, from moments that are there anyway."""
    return m.rows >= min_rows and len(m.names) >= min_features


def qcut(df: DataFrame, col: str, q: int, out: str) -> DataFrame:
    """Quantile bins 0, 1, ..., right-closed, equal edges taken together; the minimum is in the first."""
    edges = sorted(set(quantiles(df, [col], [i / q for i in range(q + 1)])[col]))
    c, code = F.col(col), F.lit(None).cast("int")
    for i, high in reversed(list(enumerate(edges[1:]))):
        code = F.when(c <= high, F.lit(i)).otherwise(code)
    return df.withColumn(out, code)


def normalize_label(train: DataFrame, test: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Both with the label less the training mean over its population deviation; a constant label stays."""
    row = train.agg(F.avg(label).alias("m"), F.stddev_pop(label).alias("s")).first()
    if not row.s:
        return train, test
    scaled = (F.col(label) - row.m) / row.s
    return train.withColumn(label, scaled), test.withColumn(label, scaled)


def hashed(key: list[str | Column], seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(buckets))


def split(df: DataFrame, key: list[str], frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` = test for a share of the rows that depends on the key alone."""
    return df.withColumn("split", F.when(hashed(key, seed, 10_000) < round(frac * 10_000), "test").otherwise("train"))


def with_fold(df: DataFrame, key: list[str], k: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", hashed(key, seed, k).cast("int"))


def cap(df: DataFrame, key: list[str], max_rows: int, seed: int = 42, features: list[str] | None = None, max_features: int | None = None) -> DataFrame:
    """A seeded sample of at most ``max_rows`` rows and, of the columns ``features``, at most ``max_features`` (a sampling operator)."""
    out = df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(max_rows)
    if features and max_features is not None and len(features) > max_features:
        chosen = {features[i] for i in np.random.default_rng(seed).permutation(len(features))[:max_features]}
        out = out.drop(*(c for c in features if c not in chosen))
    return out


def holdout(df: DataFrame, key: list[str], frac: float = 0.2, min_val: int = 20, small: int = 40, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a hash of ``key``: ``frac`` of the rows, about ``min_val`` at least; up to ``small`` rows are both."""
    n = df.count()
    if n <= small:
        return df, df
    share = min(max(frac, min_val / n), (n - min_val) / n)
    at, most = hashed(key, seed, 1 << 20), round(share * (1 << 20))
    return df.filter(at >= most), df.filter(at < most)


def bootstrap(df: DataFrame, key: list[str], b: int, seed: int = 42) -> DataFrame:
    """Rows by replicate with Poisson(1) weights from a hash of key and replicate; rows of weight 0 are left out."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    u = F.pmod(F.xxhash64(*key, "replicate", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, p, total = F.lit(9), 2.718281828459045**-1, 0.0
    bounds = []
    for k in range(9):
        total += p
        bounds.append((k, total))
        p /= k + 1
    for k, bound in reversed(bounds):
        weight = F.when(u < bound, F.lit(k)).otherwise(weight)
    return rows.withColumn("weight", weight.cast("double")).filter("weight > 0")
