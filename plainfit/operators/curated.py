"""The ten named models: what to fit with which settings, each from the operators beside this module.

All take rows, columns, a label and a ``key`` (columns that name a row, by whose hash rows are held out or dealt to
folds), leave rows with nulls out of the fit, and give a model with ``transform`` and ``card``.  ``HONEST`` names those
that score exactly what their card says.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.gram import gram
from . import additive as G
from . import teacher as E
from .linear import ridge, screen, selected
from .model import Term, TermModel, linear_model, probe
from .prep import Winsorizer, hashed
from .tree import Tree, fit_tree

HONEST = ("smart_additive", "hinge_gam", "sparse_signed_basis_pursuit", "winsorized_sparse_ols", "tiny_tree")


def _held_out(key: list[str], seed: int = 42) -> Column:
    return hashed(key, seed, 5) == 0


def _fold(key: list[str], k: int = 3, seed: int = 42) -> Column:
    return hashed(key, seed, k)


def hinge_ebm(df: DataFrame, cols: list[str], label: Column, key: list[str]) -> E.Corrected:
    """Lasso on hinges at two quantiles of the 15 most correlated columns, and cyclic boosted stumps of the residuals where over a tenth of the variance is left."""
    return E.with_additive_corrector(G.hinge_lasso(df, cols, label, _fold(key), 2, 15), df, cols, label, _held_out(key), 0.1)


def hinge_gam(df: DataFrame, cols: list[str], label: Column, key: list[str]) -> G.PiecewiseModel:
    """Lasso on rising hinges at two quantiles of the 15 most correlated columns, read as bending lines."""
    return G.hinge_gam(df, cols, label, _fold(key), 2, 15)


def smart_additive(df: DataFrame, cols: list[str], label: Column, key: list[str]) -> G.ShapeModel:
    """Boosted stumps (200 rounds at 0.1, three rows a leaf), smoothed; shapes that are nearly lines become lines."""
    return G.stump_gam(df, cols, label, _held_out(key), rounds=200, rate=0.1, min_leaf=3, passes=3, straight=0.7, least_share=0.01)


def sparse_signed_basis_pursuit(df: DataFrame, cols: list[str], label: Column, key: list[str]) -> TermModel:
    """At most ten centred terms by pursuit, with a price of 1 % each."""
    return G.basis_pursuit(df, cols, label, _held_out(key))


def dual_path_sparse_symbolic(df: DataFrame, cols: list[str], label: Column, key: list[str], trees: int | None = None) -> E.DualPath:
    """Boosted trees, a forest and a ridge, blended, for tables; an equation of at most six terms on eight columns for reading."""
    held = _held_out(key)
    student = G.symbolic(df, screen(df, cols, label, 8), label, held, knots=1, most=6, alpha=1e-6, cost=0.002, small=0.08, kinds=("linear", "square", "hinge", "interact"), gain=0.01)
    return E.DualPath(E.teacher_blend(df, cols, label, held, 1.0, trees, gbt=(140, 3, 0.05), rf=(120, 10)), student)


def winsorized_sparse_ols(df: DataFrame, cols: list[str], label: Column, key: list[str], k: int = 8) -> TermModel:
    """Columns held between their first and last percentile, the eight best of the lasso path fitted by least squares."""
    bounds = Winsorizer(cols).fit(df).bounds
    terms = [Term("clipped", c, 1.0, knot=float(bounds[c][0]), high=float(bounds[c][1])) for c in cols if bounds[c][0] is not None]
    folds = gram(df.withColumn("__part", _fold(key)), {t.a: t.column() for t in terms}, label, ["__part"])
    fit = selected(folds, k, "lasso")
    return TermModel([Term("clipped", t.a, float(b), knot=t.knot, high=t.high) for t, b in zip(terms, fit.coef, strict=True) if b], fit.intercept)


def teacher_student_rule_spline(df: DataFrame, cols: list[str], label: Column, key: list[str], trees: int = 160) -> E.DualPath:
    """Boosted trees for tables; an equation of at most eight lines, squares, distances, hinges, steps, products and gated terms for reading."""
    kinds = ("linear", "square", "kink", "hinge", "step", "interact", "gate")
    student = G.symbolic(df, screen(df, cols, label, 10, 0.01), label, _held_out(key), knots=3, most=8, alpha=1e-3, small=0.0, kinds=kinds, gain=0.004)
    return E.DualPath(E.teacher(df, cols, label, "gbt", trees, 3, rate=0.05), student)


def hybrid_gam(df: DataFrame, cols: list[str], label: Column, key: list[str], trees: int = 50) -> E.Corrected:
    """``smart_additive`` and 0.7 of a forest of its residuals."""
    return E.with_corrector(smart_additive(df, cols, label, key), df, cols, label, "rf", 0.1, 0.7, trees=trees)


@dataclass
class Atlas(E.DualPath):
    """A blend for tables, a ridge distilled from it for reading, and the student's answers at a few points."""

    points: list[tuple[str, float]] = field(default_factory=list)

    def card(self) -> str:
        return "\n".join([super().card(), "answers:", *(f"  {name}: {value:.6g}" for name, value in self.points)])


def distilled_tree_blend_atlas(df: DataFrame, cols: list[str], label: Column, key: list[str], trees: int | None = None, alpha: float = 0.6) -> Atlas:
    """A ridge learned from the blend's predictions and the label, with its answers at the medians and at each column's tenth and ninetieth percentile."""
    blend = E.teacher_blend(df, cols, label, _held_out(key), 1.0, trees)
    student = E.distil(df, label, blend, lambda rows, target: linear_model(ridge(gram(rows, {c: F.col(c) for c in cols}, target)[()], 1.0, standardise=True)), alpha)
    q = df.agg(*(F.percentile_approx(c, [0.1, 0.5, 0.9], 10_000) for c in cols)).first()
    middle = {c: float(q[i][1]) for i, c in enumerate(cols)}
    at = [("all at their medians", middle), *((f"{c} at {q[i][k]:.6g}", middle | {c: float(q[i][k])}) for i, c in enumerate(cols) for k in (0, 2))]
    points = df.sparkSession.createDataFrame([(i, n, *(p[c] for c in cols)) for i, (n, p) in enumerate(at)], ", ".join(["ord int", "name string", *(f"`{c}` double" for c in cols)]))
    return Atlas(blend, student, [(r.name, r.pred) for r in probe(student, points, "ord").collect()])


def tiny_tree(df: DataFrame, cols: list[str], label: Column, key: list[str] = ()) -> Tree:
    """A tree of four leaves."""
    return fit_tree(df, cols, label, max_depth=2)


MODELS = {f.__name__: f for f in (hinge_ebm, distilled_tree_blend_atlas, dual_path_sparse_symbolic, hybrid_gam, teacher_student_rule_spline, sparse_signed_basis_pursuit, hinge_gam, winsorized_sparse_ols, tiny_tree, smart_additive)}
