"""Additive models of B-splines: smooth shapes of any degree, their roughness penalised, the strength by generalised cross-validation.

Each column has ``splines`` basis functions on evenly spaced knots from its minimum to its maximum; beyond, it is held at
the nearer end.  A basis function is a Column of its own, zero but on ``degree + 1`` spaces between knots, and those of a
column add up to 1.  All fits are solved from one moment job over all basis functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.gram import Moments, gram
from .model import Term, TermModel

#: Strengths that are tried, and what an effective degree of freedom counts for (fixed values).
STRENGTHS = tuple(10.0**k for k in np.linspace(-3, 3, 11))
CAUTION = 1.4


def bases(col: str, low: float, high: float, splines: int = 10, degree: int = 3) -> list[Term]:
    """The terms of a column between two bounds, with coefficient 1."""
    if degree < 0 or splines <= degree:
        raise ValueError("more splines than their degree are expected")
    width = (high - low) / (splines - degree) or 1.0
    return [Term("spline", col, 1.0, knot=low + (j - degree) * width, direction=degree, high=width, bounds=(low, high)) for j in range(splines)]


def pieces(degree: int) -> list[float]:
    """Factors of max(0, v - k)^degree, k = 0, 1, ..., in the basis function that begins at 0."""
    return [(-1) ** k * comb(degree + 1, k) / factorial(degree) for k in range(degree + 2)]


@dataclass
class SplineModel(TermModel):
    """A spline for each column; the card shows each shape at its knots."""

    strength: float = 0.0
    freedom: float = 0.0

    def shape(self, col: str, points: int = 9) -> list[tuple[float, float]]:
        """(value of the column, its part of the prediction) along its range."""
        own = [t for t in self.terms if t.a == col]
        low, high = own[0].bounds
        at = np.linspace(low, high, points)
        return [(float(x), float(sum(t.coef * value(t, x) for t in own))) for x in at]

    def card(self) -> str:
        lines = [f"y = {self.intercept:.6g}" + "".join(f" + s({c})" for c in self.columns())]
        for c in self.columns():
            lines += [f"s({c}):", *(f"  {c} = {x:.6g}: {v:+.6g}" for x, v in self.shape(c))]
        return "\n".join(lines)


def value(t: Term, x: float) -> float:
    """A basis function at a point."""
    v = min(max((min(max(x, t.bounds[0]), t.bounds[1]) - t.knot) / t.high, 0.0), t.direction + 1.0)
    return sum(f * (max(0.0, v - k) ** t.direction if t.direction else float(v > k)) for k, f in enumerate(pieces(t.direction)))


def roughness(columns: list[int], order: int = 2) -> np.ndarray:
    """Squared differences of neighbouring coefficients of each column, given how many splines each has."""
    blocks = [np.diff(np.eye(n), order, axis=0) if n > order else np.zeros((0, n)) for n in columns]
    out, at = np.zeros((sum(columns),) * 2), 0
    for d in blocks:
        n = d.shape[1]
        out[at : at + n, at : at + n] = d.T @ d
        at += n
    return out


def penalised(m: Moments, penalty: np.ndarray, strength: float) -> tuple[np.ndarray, float, float]:
    """Coefficients about the means, effective degrees of freedom, squared error."""
    _, s, c, yy, _ = m.centered()
    inverse = np.linalg.pinv(s + strength * penalty, rcond=1e-12, hermitian=True)
    coef = inverse @ c
    return coef, float(np.trace(inverse @ s)) + 1, float(max(0.0, yy - 2 * coef @ c + coef @ s @ coef))


def spline_gam(df: DataFrame, cols: list[str], label: Column, splines: int = 10, degree: int = 3, strengths: tuple[float, ...] = STRENGTHS) -> SplineModel:
    """The model whose strength has the least generalised cross-validation score; constant columns are left out."""
    row = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).agg(*(f(F.when(~F.isnan(c), F.col(c))).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("a", F.min), ("b", F.max)))).first()
    ranges = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}
    used = [c for c in cols if ranges[c][0] is not None and ranges[c][0] < ranges[c][1]]
    terms = [t for c in used for t in bases(c, *ranges[c], splines, degree)]
    if not terms:
        return SplineModel([], float(df.agg(F.avg(label)).first()[0] or 0.0))
    m = gram(df, {f"b{i}": t.column() for i, t in enumerate(terms)}, label)[()]
    penalty = roughness([splines] * len(used))

    def score(strength: float) -> float:
        _, freedom, sse = penalised(m, penalty, strength)
        return m.n * sse / max(m.n - CAUTION * freedom, 1e-9) ** 2

    strength = min(strengths, key=score)
    coef, freedom, _ = penalised(m, penalty, strength)
    mean, _, _, _, middle = m.centered()
    return SplineModel([Term(t.kind, t.a, float(b), knot=t.knot, direction=t.direction, high=t.high, bounds=t.bounds) for t, b in zip(terms, coef, strict=True)], float(middle - mean @ coef), strength, freedom)
