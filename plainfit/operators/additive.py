"""Additive models: boosted stumps, backfitted bins, hinges and searched terms, all fitted from one moment job.

Rows are read to find quantiles and to fill the moment tables; boosting rounds, backfitting and searches then work on
tables whose size depends on columns and bins alone.  Every model ends as a ``TermModel``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations, pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fourier
from ..plans.bins import Binned, binned, edges_of
from ..plans.gram import Moments, gram
from .linear import Equation, cross_validated, lasso_cv, priced_rounding, prune, ridge, selected, top_by_correlation, top_correlations
from .model import Term, TermModel, linear_model, number
from .tree import ensemble


def new_column(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be new."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def smoothed(values: np.ndarray, passes: int = 3, middle: float = 0.6) -> np.ndarray:
    """Each pass mixes inner values with their neighbours; the ends stay."""
    side = (1 - middle) / 2
    for _ in range(passes if len(values) > 2 else 0):
        values = np.concatenate([values[:1], side * values[:-2] + middle * values[1:-1] + side * values[2:], values[-1:]])
    return values


@dataclass
class ShapeModel(TermModel):
    """Lines and steps; the card shows steps as tables, by how far they move the prediction."""

    small: float = 0.01
    #: Columns with more steps than this are scored by a search of their bounds instead of one comparison a step.
    many: int = 32

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """The same as ``column``, but for long shapes: the place of a value among its column's bounds is found by halving.

        Each halving is one projection over all such columns, so what a row costs grows with the logarithm of the
        bounds, and everything stays in generated code.
        """
        steps: dict[str, list[Term]] = {}
        for t in self.terms:
            if t.kind == "step":
                steps.setdefault(t.a, []).append(t)
        long = {c: sorted(ts, key=lambda t: t.knot) for c, ts in steps.items() if len(ts) > self.many}
        if not long:
            return super().transform(df, out)
        rest = TermModel([t for t in self.terms if t.kind != "step" or t.a not in long], self.intercept)
        places = {c: new_column(df, f"place{i}") for i, c in enumerate(long)}
        bounds = {c: F.lit([float(t.knot) for t in ts]) for c, ts in long.items()}
        found = df.withColumns({p: F.lit(0) for p in places.values()})
        halves = max(len(ts) for ts in long.values()).bit_length()
        for step in (1 << k for k in reversed(range(halves))):
            found = found.withColumns({p: F.col(p) + F.when(F.get(bounds[c], F.col(p) + (step - 1)) < F.col(f"`{c}`"), step).otherwise(0) for c, p in places.items()})
        total = rest.column()
        for c, ts in long.items():
            total = total + F.get(F.lit(np.cumsum([0.0, *(float(t.coef) for t in ts)]).tolist()), F.col(places[c]))
        return found.withColumn(out, total).drop(*places.values())

    def tables(self) -> dict[str, tuple[list[float], np.ndarray]]:
        """(bounds, values) of each column with steps, about the values' mean; the first value is up to the first bound."""
        out: dict = {}
        for t in sorted((t for t in self.terms if t.kind == "step"), key=lambda t: (t.a, t.knot)):
            out.setdefault(t.a, []).append((t.knot, t.coef))
        shapes = {c: ([k for k, _ in x], np.cumsum([0.0, *(v for _, v in x)])) for c, x in out.items()}
        return {c: (k, v - v.mean()) for c, (k, v) in shapes.items()}

    def card(self) -> str:
        tables, lines = self.tables(), []
        first = {c: -v[0] for c, (_, v) in tables.items()}  # what centering takes out of the steps
        straight = sorted((t for t in self.terms if t.kind != "step" and t.coef), key=lambda t: -abs(t.coef))
        lines.append(f"y = {self.intercept + sum(first.values()):.6g}" + "".join(f" {t.coef:+.6g} * {t.text()}" for t in straight) + "".join(f" + f({c})" for c in tables))
        spans = {c: float(np.ptp(v)) for c, (_, v) in tables.items()}
        total = sum(spans.values()) or 1.0
        for c in sorted(tables, key=lambda c: -spans[c]):
            knots, values = tables[c]
            if spans[c] < self.small * total:
                lines.append(f"f({c}): within {spans[c]:.6g}")
                continue
            sides = [f"{c} <= {knots[0]:.6g}", *(f"{x:.6g} < {c} <= {y:.6g}" for x, y in pairwise(knots)), f"{c} > {knots[-1]:.6g}"]
            lines += [f"f({c}):", *(f"  {side}: {v:+.6g}" for side, v in zip(sides, values, strict=True))]
        return "\n".join(lines)


def shape_model(b: Binned, f: np.ndarray, intercept: float, straight: float | None = None, least_share: float = 0.0) -> ShapeModel:
    """Cells as steps; a shape that a line over its bins explains to ``straight`` (R squared) and more, and that has ``least_share`` of all shapes' spans, becomes that line."""
    terms, spans = [], [float(np.ptp(f[at])) if at.stop > at.start else 0.0 for at in b.cells]
    for name, edges, at, span in zip(b.names, b.edges, b.cells, spans, strict=True):
        values, counts = f[at], np.diag(b.meet)[at]
        full = counts > 0
        if straight is not None and full.sum() > 1 and np.ptp(values[full]) > 0 and span >= least_share * sum(spans):
            x, v, w = b.values[at][full] / counts[full], values[full], counts[full]
            dx, dv = x - np.average(x, weights=w), v - np.average(v, weights=w)
            slope = (w * dx * dv).sum() / (w * dx**2).sum()
            if 1 - (w * (dv - slope * dx) ** 2).sum() / (w * dv**2).sum() >= straight:
                terms.append(Term("linear", name, float(slope)))
                intercept += float(np.average(v, weights=w) - slope * np.average(x, weights=w))
                continue
        intercept += float(values[0])
        terms += [Term("step", name, float(d), knot=float(e)) for e, d in zip(edges, np.diff(values), strict=True) if d]
    return ShapeModel(terms, float(intercept))


def _stumps(b: Binned, rounds: int, rate: float, min_leaf: float, valid: Binned | None, cyclic: bool, leaf_l2: float = 0.0, max_splits: int | None = None, share: float = 1.0, seed: int = 42) -> tuple[np.ndarray, int]:
    """Cell values after boosting, and how many rounds were best on ``valid``."""
    counts, f = np.diag(b.meet).copy(), np.zeros(len(b.labels))
    rest = b.labels - b.label_sum / b.n * counts
    best, used, rng = (np.inf, 0, f), {}, np.random.default_rng(seed)
    every = len(b.cells)

    def split(at: slice):
        n, s = np.cumsum(counts[at])[:-1], np.cumsum(rest[at])[:-1]
        right, total = n[-1:] + counts[at][-1] - n, rest[at].sum()
        ok = (n >= min_leaf) & (right >= min_leaf)
        if not ok.any():
            return None
        gain = np.where(ok, s**2 / np.maximum(n + leaf_l2, 1) + (total - s) ** 2 / np.maximum(right + leaf_l2, 1), -1.0)
        if max_splits is not None and len(used.get(at.start, ())) >= max_splits:  # only where it was split before
            gain = np.where(np.isin(np.arange(len(gain)), list(used[at.start])), gain, -1.0)
        k = int(gain.argmax())
        return gain[k], at, k, s[k] / (n[k] + leaf_l2), (total - s[k]) / (right[k] + leaf_l2)

    for done in range(1, rounds + 1):
        tried = [b.cells[(done - 1) % every]] if cyclic else b.cells if share >= 1 else [b.cells[i] for i in rng.permutation(every)[: max(1, round(share * every))]]
        found = [x for at in tried if (x := split(at))]
        if found:
            _, at, k, left, right = max(found, key=lambda x: x[0])
            used.setdefault(at.start, set()).add(k)
            step = np.zeros(len(f))
            step[at] = np.where(np.arange(at.stop - at.start) <= k, left, right) * rate
            f = f + step
            rest = rest - b.meet @ step
        if valid is not None and done % 10 == 0:
            error = valid.sse(f, b.label_sum / b.n)
            if error < best[0]:
                best = (error, done, f)
            elif done - best[1] >= 20:
                break
    return (best[2], best[1]) if valid is not None and best[1] else (f, rounds)


def stump_gam(df: DataFrame, cols: list[str], label: Column, held_out: Column, bins: int = 32, rounds: int = 200, rate: float = 0.1, min_leaf: float = 5, cyclic: bool = False, passes: int = 3, straight: float | None = 0.7, leaf_l2: float = 0.0, max_splits: int | None = None, share: float = 1.0, fits: int = 1, seed: int = 42, least_share: float = 0.01) -> ShapeModel:
    """Boosted stumps, stopped by the rows where ``held_out`` holds, refitted on all rows, smoothed and read as shapes.

    ``leaf_l2`` shrinks leaves, ``max_splits`` bounds a column's distinct splits, ``share`` is the part of the columns
    tried in a round, and ``fits`` the number of seeds whose shapes are averaged.
    """
    edges = edges_of(df, cols, bins)
    parts = binned(df, cols, label, edges, held_out.cast("int"))
    if not parts:
        return ShapeModel([], 0.0)
    more = {"leaf_l2": leaf_l2, "max_splits": max_splits, "share": share}
    if len(parts) == 2:
        _, rounds = _stumps(parts[0], rounds, rate, min_leaf, parts[1], cyclic, seed=seed, **more)
    whole = sum(list(parts.values())[1:], start=next(iter(parts.values())))
    f = np.mean([_stumps(whole, rounds, rate, min_leaf, None, cyclic, seed=seed + k, **more)[0] for k in range(fits)], axis=0)
    return _finished(whole, f, passes, straight, least_share)


def best_stump(b: Binned, counts: np.ndarray, rest: np.ndarray, min_leaf: float) -> tuple[slice, int, float, float] | None:
    """(cells of a column, last cell on the left, means of both sides) of the split that explains most of ``rest``."""
    best = None
    for at in b.cells:
        n, s = np.cumsum(counts[at])[:-1], np.cumsum(rest[at])[:-1]
        right, total = counts[at].sum() - n, rest[at].sum()
        ok = (n >= min_leaf) & (right >= min_leaf)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(right, 1), -1.0)
            k = int(gain.argmax())
            if best is None or gain[k] > best[0]:
                best = gain[k], at, k, s[k] / n[k], (total - s[k]) / right[k]
    return best and best[1:]


def stochastic_gam(df: DataFrame, cols: list[str], label: Column, part: Column, held_out: Column, parts: int = 16, share: float = 0.5, bins: int = 32, rounds: int = 200, rate: float = 0.1, min_leaf: float = 5, passes: int = 0, seed: int = 42, edges: list[list[float]] | None = None) -> ShapeModel:
    """Boosted stumps, each found on a random ``share`` of the rows, stopped by the rows where ``held_out`` holds.

    ``part`` deals the rows to numbers from 0 to ``parts`` - 1 (a hash of their key modulo ``parts``).  One job makes a
    table of each part; a round draws some parts and works on the sum of their tables, so no round reads the rows, and a
    seed gives the same model however the rows are spread over tasks.
    """
    edges = edges_of(df, cols, bins) if edges is None else edges
    found = binned(df, cols, label, edges, part.cast("int") + F.when(held_out, parts).otherwise(0))
    train, valid = {k: b for k, b in found.items() if k < parts}, [b for k, b in found.items() if k >= parts]
    if not train:
        return ShapeModel([], 0.0)
    valid = sum(valid[1:], start=valid[0]) if valid else None
    whole = sum(list(train.values())[1:], start=next(iter(train.values())))
    keys, middle, rng = sorted(train), whole.label_sum / whole.n, np.random.default_rng(seed)
    counts = {k: np.diag(b.meet) for k, b in train.items()}
    rest = {k: b.labels - middle * counts[k] for k, b in train.items()}
    f = np.zeros(len(whole.labels))
    best = (np.inf, 0, f)
    for done in range(1, rounds + 1):
        drawn = [keys[i] for i in rng.permutation(len(keys))[: max(1, round(share * len(keys)))]]
        stump = best_stump(whole, sum(counts[k] for k in drawn), sum(rest[k] for k in drawn), min_leaf)
        if stump:
            at, k, left, right = stump
            step = np.zeros(len(f))
            step[at] = np.where(np.arange(at.stop - at.start) <= k, left, right) * rate
            f = f + step
            for k, b in train.items():
                rest[k] = rest[k] - b.meet @ step
        if valid is not None and done % 10 == 0:
            error = valid.sse(f, middle)
            if error < best[0]:
                best = (error, done, f)
            elif done - best[1] >= 20:
                break
    return _finished(whole, best[2] if best[1] else f, passes, None)


def backfitted(b: Binned, rounds: int = 50) -> np.ndarray:
    """Cell values: each column's bins' means of what the others leave, in turn until nothing moves."""
    counts, f = np.diag(b.meet), np.zeros(len(b.labels))
    base = b.labels - b.label_sum / b.n * counts
    for _ in range(rounds):
        moved = 0.0
        for at in b.cells:
            others = f.copy()
            others[at] = 0
            new = (base[at] - b.meet[at] @ others) / np.maximum(counts[at], 1)
            new -= counts[at] @ new / b.n
            moved, f[at] = max(moved, float(np.abs(new - f[at]).max())), new
        if moved < 1e-9 * max(1.0, float(np.abs(f).max())):
            break
    return f


def bin_gam(df: DataFrame, cols: list[str], label: Column, bins: int = 16, rounds: int = 50, passes: int = 0, straight: float | None = None) -> ShapeModel:
    """Backfitting: each column's shape is its bins' means of what the others leave, in turn until nothing moves."""
    parts = binned(df, cols, label, edges_of(df, cols, bins))
    if not parts:
        return ShapeModel([], 0.0)
    b = parts[0]
    return _finished(b, backfitted(b, rounds), passes, straight)


def _finished(b: Binned, f: np.ndarray, passes: int, straight: float | None, least_share: float = 0.0) -> ShapeModel:
    counts = np.diag(b.meet)
    f = np.concatenate([smoothed(f[at], passes) for at in b.cells])
    intercept = (b.label_sum - counts @ f) / b.n  # smoothing moves the mean
    return shape_model(b, f, intercept, straight, least_share)


def bin_ridge_gam(df: DataFrame, cols: list[str], label: Column, bins: int = 16, alpha: float = 1.0, passes: int = 0, straight: float | None = None) -> ShapeModel:
    """Ridge on the indicators of all bins, whose moments are the binned job's table."""
    parts = binned(df, cols, label, edges_of(df, cols, bins))
    if not parts:
        return ShapeModel([], 0.0)
    b = parts[0]
    counts = np.diag(b.meet)
    left = b.meet - np.outer(counts, counts) / b.n + alpha * np.eye(len(counts))
    f = np.linalg.solve(left, b.labels - counts * b.label_sum / b.n)
    return _finished(b, f, passes, straight)


def shape_trees(df: DataFrame, cols: list[str], label: Column, held_out: Column, bins: int = 32, depth: int = 2, rounds: int = 60, rate: float = 0.3, min_leaf: float = 5) -> ShapeModel:
    """A tree of ``depth`` for each column in turn on what the others leave, stopped by the held-out rows."""
    parts = binned(df, cols, label, edges_of(df, cols, bins), held_out.cast("int"))
    if not parts:
        return ShapeModel([], 0.0)

    def tree(n: np.ndarray, s: np.ndarray, levels: int) -> np.ndarray:
        left, below = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
        ok = (left >= min_leaf) & (n.sum() - left >= min_leaf)
        if levels == 0 or not ok.any():
            return np.full(len(n), s.sum() / max(n.sum(), 1))
        gain = np.where(ok, below**2 / np.maximum(left, 1) + (s.sum() - below) ** 2 / np.maximum(n.sum() - left, 1), -np.inf)
        k = int(gain.argmax()) + 1
        return np.concatenate([tree(n[:k], s[:k], levels - 1), tree(n[k:], s[k:], levels - 1)])

    def fit(b: Binned, turns: int, valid: Binned | None) -> tuple[np.ndarray, int]:
        counts, f = np.diag(b.meet), np.zeros(len(b.labels))
        rest, best = b.labels - b.label_sum / b.n * counts, (np.inf, 0)
        for done in range(1, turns + 1):
            for at in b.cells:
                step = np.zeros(len(f))
                step[at] = rate * tree(counts[at], rest[at], depth)
                f, rest = f + step, rest - b.meet @ step
            if valid is not None:
                best = min(best, (valid.sse(f, b.label_sum / b.n), done))
                if done - best[1] >= 5:
                    break
        return f, best[1] or turns

    turns = fit(parts[0], rounds, parts[1])[1] if len(parts) == 2 else rounds
    whole = sum(list(parts.values())[1:], start=next(iter(parts.values())))
    return _finished(whole, fit(whole, turns, None)[0], 0, None)


def dictionary(cols: list[str], knots: dict[str, list[float]], kinds: tuple[str, ...] = ("linear", "hinge")) -> list[Term]:
    """Candidate terms: each column's linear, square and kink (about its middle knot), hinges and steps at its knots, sine and decay, products of two, and others beyond its middle knot."""
    out = []
    for i, c in enumerate(cols):
        out += [Term("linear", c, 1.0)] if "linear" in kinds else []
        out += [Term("square", c, 1.0, knot=knots[c][len(knots[c]) // 2])] if "square" in kinds and knots[c] else []
        out += [Term("hinge", c, 1.0, knot=k, direction=d) for k in knots[c] for d in (1, -1)] if "hinge" in kinds else []
        out += [Term("step", c, 1.0, knot=k) for k in knots[c]] if "step" in kinds else []
        out += [Term("kink", c, 1.0, knot=knots[c][len(knots[c]) // 2])] if "kink" in kinds and knots[c] else []
        out += [Term("gate", c, 1.0, other, knot=knots[c][len(knots[c]) // 2]) for other in cols if other != c] if "gate" in kinds and knots[c] else []
        out += [Term(k, c, 1.0) for k in ("sin", "decay") if k in kinds]
        out += [Term("interact", c, 1.0, other) for other in cols[i + 1 :]] if "interact" in kinds else []
    return out


def _with_coefs(terms: list[Term], coef: np.ndarray, intercept: float) -> TermModel:
    return TermModel([replace(t, coef=float(c)) for t, c in zip(terms, coef, strict=True) if c], float(intercept))


def _term_moments(df: DataFrame, terms: list[Term], label: Column, by: Column) -> dict[tuple, Moments]:
    return gram(df.withColumn("__part", by.cast("int")), {f"t{i}": t.column() for i, t in enumerate(terms)}, label, ["__part"])


def most_correlated(df: DataFrame, cols: list[str], label: Column, most: int | None) -> list[str]:
    """At most ``most`` of the columns, in their order."""
    if most is None or len(cols) <= most:
        return cols
    return [cols[i] for i in top_by_correlation(gram(df, {c: F.col(c) for c in cols}, label)[()], most)]


def knots_of(df: DataFrame, cols: list[str], quantiles: list[float]) -> dict[str, list[float]]:
    """Distinct inner quantiles of each column; a constant one has none.  Approximate at a ten-thousandth."""
    row = df.agg(*(F.percentile_approx(c, quantiles, 10_000).alias(f"q{i}") for i, c in enumerate(cols)), *(f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("l", F.min), ("h", F.max)))).first()
    return {c: sorted({float(q) for q in row[f"q{i}"] or []}) if row[f"l{i}"] != row[f"h{i}"] else [] for i, c in enumerate(cols)}


def hinge_lasso(df: DataFrame, cols: list[str], label: Column, fold: Column, knots: int = 3, max_features: int | None = 15, directions: tuple[int, ...] = (1, -1)) -> TermModel:
    """Lasso over linear terms and hinges at inner quantiles (a quarter to three quarters), its strength by cross-validation over ``fold``; one equation."""
    cols = most_correlated(df, cols, label, max_features)
    terms = [t for t in dictionary(cols, knots_of(df, cols, np.linspace(0.25, 0.75, knots).tolist())) if t.kind != "hinge" or t.direction in directions]
    fit, _ = lasso_cv(_term_moments(df, terms, label, fold))
    return _with_coefs(terms, fit.coef, fit.intercept)


@dataclass
class PiecewiseModel(TermModel):
    """Lines that bend; the card shows each column's slopes from bend to bend."""

    def segments(self, col: str) -> list[tuple[float | None, float | None, float, float]]:
        """(low, high, slope, value at 0) of the column's part between its bends."""
        own = [t for t in self.terms if t.a == col and t.kind in ("linear", "hinge")]
        knots = sorted({t.knot for t in own if t.kind == "hinge"})
        out = []
        for low, high in pairwise([None, *knots, None]):
            on = [t for t in own if t.kind == "linear" or (t.direction > 0 and low is not None and t.knot <= low) or (t.direction < 0 and high is not None and t.knot >= high)]
            slope = sum(t.coef * t.direction if t.kind == "hinge" else t.coef for t in on)
            out.append((low, high, slope, -sum(t.coef * t.direction * t.knot for t in on if t.kind == "hinge")))
        return out

    def card(self) -> str:
        single = [c for c in self.columns() if any(t.a == c and t.kind == "hinge" for t in self.terms)]
        lines = [f"y = {self.intercept:.6g}" + "".join(f" {t.coef:+.6g} * {t.text()}" for t in self.terms if t.coef and (t.kind not in ("linear", "hinge") or t.a not in single)) + "".join(f" + f({c})" for c in single)]
        for c in single:
            lines.append(f"f({c}):")
            for low, high, slope, base in self.segments(c):
                side = " ".join([*([f"{low:.6g} <"] if low is not None else []), c, *([f"<= {high:.6g}"] if high is not None else [])])
                lines.append(f"  {side}: {slope:+.6g} * {c} {base:+.6g}")
        return "\n".join(lines)


def hinge_gam(df: DataFrame, cols: list[str], label: Column, fold: Column, knots: int = 2, max_features: int | None = 15) -> PiecewiseModel:
    """Lasso over linear terms and rising hinges, read as one bending line for each column."""
    model = hinge_lasso(df, cols, label, fold, knots, max_features, (1,))
    return PiecewiseModel(model.terms, model.intercept)


def piecewise_gam(df: DataFrame, cols: list[str], label: Column, fold: Column, knots: int = 2, small: float = 0.02, alike: float = 0.05, interactions: int = 0, max_features: int | None = 15) -> PiecewiseModel:
    """``hinge_gam`` without small effects and slight bends, with the products that explain most of what is left, fitted anew by least squares.

    Effects below the share ``small`` of the largest go; so do bends by less than the share ``alike`` of the column's
    steepest slope.
    """
    cols = most_correlated(df, cols, label, max_features)
    terms = [t for t in dictionary(cols, knots_of(df, cols, np.linspace(0.25, 0.75, knots).tolist()), ("linear", "hinge", "interact") if interactions else ("linear", "hinge")) if t.direction > 0]
    folds = _term_moments(df, terms, label, fold)
    whole = sum(list(folds.values())[1:], start=next(iter(folds.values())))
    plain = [i for i, t in enumerate(terms) if t.kind != "interact"]
    fit, _ = lasso_cv({k: m.only(plain) for k, m in folds.items()})
    _, s, c, _, _ = whole.centered()
    coef = np.zeros(len(terms))
    coef[plain] = fit.coef
    effect = np.abs(coef) * np.sqrt(np.maximum(np.diag(s) / whole.n, 0))
    steepest = {n: max((abs(x[2]) for x in PiecewiseModel(_with_coefs(terms, coef, 0.0).terms, 0.0).segments(n)), default=0.0) for n in cols}
    keep = [i for i in plain if effect[i] > 0 and effect[i] >= small * effect.max() and (terms[i].kind != "hinge" or abs(coef[i]) >= alike * steepest[terms[i].a])]
    if interactions:
        left = np.abs(c - s @ coef) / np.sqrt(np.maximum(np.diag(s), 1e-300))
        both = sorted((i for i, t in enumerate(terms) if t.kind == "interact"), key=lambda i: -left[i])[:interactions]
        keep = sorted([*keep, *both])
    final = ridge(whole, 0.0, keep=keep)
    model = _with_coefs(terms, final.coef, final.intercept)
    return PiecewiseModel(model.terms, model.intercept)


def basis_pursuit(df: DataFrame, cols: list[str], label: Column, held_out: Column, most: int = 10, least: int = 2, alphas: tuple[float, ...] = (0.0, 1e-4, 1e-3, 1e-2, 1e-1, 1.0), bent: int = 10, paired: int = 6, cost: float = 0.01, patience: int = 2) -> TermModel:
    """Signed basis pursuit: the term closest to what is left is added, all are refitted by ridge, and the error on the held-out rows times 1 + ``cost`` for each term tells when to stop; coefficients are rounded by the same price.

    Terms are linear; hinges to both sides of the median and the square about it for the ``bent`` most correlated
    columns; products about the medians for pairs of the ``paired`` most correlated.
    """
    middle = {c: (k or [0.0])[0] for c, k in knots_of(df, cols, [0.5]).items()}
    rows = gram(df.filter(~held_out), {c: F.col(c) for c in cols}, label)
    order = top_correlations(rows[()]) if rows else []
    first = [c for c, _ in order]
    terms = [Term("linear", c, 1.0) for c in cols]
    terms += [t for c in first[:bent] for t in (Term("hinge", c, 1.0, knot=middle[c]), Term("hinge", c, 1.0, knot=middle[c], direction=-1), Term("square", c, 1.0, knot=middle[c]))]
    terms += [Term("interact", a, 1.0, b, knot=middle[a], high=middle[b]) for a, b in combinations(first[:paired], 2)]
    parts = _term_moments(df, terms, label, held_out)
    if not parts:
        return TermModel([], 0.0)
    train, valid = parts.get((0,)) or parts[(1,)], parts.get((1,)) or parts[(0,)]
    whole = train + valid if len(parts) == 2 else train
    _, s, c, _, _ = train.centered()
    size = np.sqrt(np.maximum(np.diag(s), 0))
    usable = size > 1e-9 * max(1e-300, size.max(initial=0.0))
    chosen: list[int] = []
    rest, best = c.copy(), (np.inf, 0, 0.0)
    while len(chosen) < min(most, int(usable.sum())):
        score = np.where(usable, np.abs(rest) / np.where(usable, size, 1.0), -1.0)
        score[chosen] = -1.0
        chosen.append(int(score.argmax()))
        fits = [(a, ridge(train, a, keep=chosen)) for a in alphas]
        price, alpha, fit = min(((valid.sse(f.coef, f.intercept) ** 0.5 * (1 + cost * len(chosen)), a, f) for a, f in fits), key=lambda x: x[0])
        rest = c - s @ fit.coef
        if price < best[0] - 1e-6:
            best = (price, len(chosen), alpha)
        if len(chosen) >= least and len(chosen) - best[1] >= patience:
            break
    keep = chosen[: best[1]]
    fit = priced_rounding(ridge(whole, best[2], keep=keep), valid, cost=cost)
    return _with_coefs(terms, fit.coef, fit.intercept)


def trunk_plus_terms(df: DataFrame, cols: list[str], label: Column, held_out: Column, k: int = 3, trunk: int = 8, gain: float = 0.005, knots: int = 3, kinds: tuple[str, ...] = ("hinge", "step", "interact"), alpha: float = 1e-6) -> TermModel:
    """A linear trunk of the ``trunk`` most correlated columns and at most ``k`` bends, steps or products, each for a gain of the share ``gain`` on the held-out rows."""
    cols = most_correlated(df, cols, label, trunk)
    terms = dictionary(cols, knots_of(df, cols, [i / (knots + 1) for i in range(1, knots + 1)]), ("linear", *kinds))
    parts = _term_moments(df, terms, label, held_out)
    train, valid = parts[(0,)], parts[(1,)]
    chosen = [i for i, t in enumerate(terms) if t.kind == "linear"]
    error = lambda keep: (lambda e: valid.sse(e.coef, e.intercept))(ridge(train, alpha, keep=keep))
    now = error(chosen)
    for _ in range(k):
        price, i = min(((error([*chosen, i]), i) for i in range(len(terms)) if i not in chosen), default=(np.inf, -1))
        if price > now * (1 - gain):
            break
        now, chosen = price, [*chosen, i]
    fit = ridge(train + valid, alpha, keep=sorted(chosen))
    return _with_coefs(terms, fit.coef, fit.intercept)


@dataclass
class CalibratedScore:
    """A linear score, and a line with two bends over it where that was worth it."""

    score: TermModel
    bends: list[tuple[float, float]]
    slope: float
    intercept: float

    def column(self) -> Column:
        s = self.score.column()
        out = F.lit(self.intercept) + self.slope * s
        for knot, coef in self.bends:
            out = out + coef * F.greatest(F.lit(0.0), s - knot)
        return out

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.column())

    def sql(self) -> str:
        s = f"({self.score.sql()})"
        return " + ".join([number(self.intercept), f"{number(self.slope)} * {s}", *(f"{number(c)} * greatest(0e0, {s} - {number(k)})" for k, c in self.bends)])

    def card(self) -> str:
        return "\n".join(["score " + self.score.card(), f"y = {self.intercept:.6g} {self.slope:+.6g} * score" + "".join(f" {c:+.6g} * max(0, score - {k:.6g})" for k, c in self.bends)])


def calibrated_score(df: DataFrame, cols: list[str], label: Column, held_out: Column, k: int = 8, gain: float = 0.01) -> CalibratedScore:
    """The best ``k`` columns' least squares, then a two-bend line over that score if it lowers the error on the held-out rows by the share ``gain``."""
    parts = gram(df.withColumn("__part", held_out.cast("int")), {c: F.col(c) for c in cols}, label, ["__part"])
    fit = selected(parts, k)
    score = linear_model(fit)
    score = TermModel([t for t in score.terms if t.coef], score.intercept)
    scored = df.withColumn("__s", score.column())
    knots = knots_of(scored, ["__s"], [1 / 3, 2 / 3])["__s"]
    bent = {"s": F.col("__s")} | {f"b{i}": F.greatest(F.lit(0.0), F.col("__s") - q) for i, q in enumerate(knots)}
    second = gram(scored.withColumn("__part", held_out.cast("int")), bent, label, ["__part"])
    train, valid = second[(0,)], second[(1,)]
    plain, full = ridge(train, 0.0, keep=[0]), ridge(train, 0.0)
    if valid.sse(full.coef, full.intercept) > (1 - gain) * valid.sse(plain.coef, plain.intercept):
        return CalibratedScore(score, [], 1.0, 0.0)
    final = ridge(train + valid, 0.0)
    return CalibratedScore(score, [(q, float(c)) for q, c in zip(knots, final.coef[1:], strict=True)], float(final.coef[0]), final.intercept)


def split_linear(df: DataFrame, cols: list[str], label: Column, held_out: Column, knots: int = 3, alpha: float = 1.0, gain: float = 0.01) -> TermModel:
    """A linear model that is another one beyond a bound of one column, if some bound lowers the error on the held-out rows by the share ``gain``; all candidates are solved from one moment job."""
    at = knots_of(df, cols, [i / (knots + 1) for i in range(1, knots + 1)])
    terms, places = [Term("linear", c, 1.0) for c in cols], {}
    for g in cols:
        for t in at[g]:
            own = [Term("step", g, 1.0, knot=t), *(Term("gate", g, 1.0, c, knot=t) for c in cols)]
            places[g, t] = [*range(len(cols)), *range(len(terms), len(terms) + len(own))]
            terms += own
    parts = _term_moments(df, terms, label, held_out)
    train, valid = parts[(0,)], parts[(1,)]
    error = lambda keep: (lambda e: valid.sse(e.coef, e.intercept))(ridge(train, alpha, standardise=True, keep=keep))
    plain = list(range(len(cols)))
    best = min(places.values(), key=error, default=plain)
    keep = best if error(best) <= (1 - gain) * error(plain) else plain
    fit = ridge(train + valid, alpha, standardise=True, keep=keep)
    return _with_coefs(terms, fit.coef, fit.intercept)


def one_knot_additive(df: DataFrame, cols: list[str], label: Column, held_out: Column, knots: int = 5, gain: float = 0.002, alpha: float = 1e-6) -> TermModel:
    """A line for each column and at most one bend or step, that of least training error, where it lowers the error on the held-out rows; all fitted together in the end."""
    terms = [t for t in dictionary(cols, knots_of(df, cols, [i / (knots + 1) for i in range(1, knots + 1)]), ("linear", "hinge", "step")) if t.direction > 0]
    parts = _term_moments(df, terms, label, held_out)
    train, valid = parts[(0,)], parts[(1,)]
    sse = lambda m, keep: (lambda e: m.sse(e.coef, e.intercept))(ridge(train, alpha, keep=keep))
    chosen = [i for i, t in enumerate(terms) if t.kind == "linear"]
    now = sse(valid, chosen)
    for c in cols:
        own = [i for i, t in enumerate(terms) if t.a == c and t.kind != "linear"]
        best = min(own, key=lambda i: sse(train, [*chosen, i]), default=None)
        if best is not None and (error := sse(valid, [*chosen, best])) <= now * (1 - gain):
            now, chosen = error, [*chosen, best]
    fit = ridge(train + valid, alpha, keep=sorted(chosen))
    return _with_coefs(terms, fit.coef, fit.intercept)


def boosted_hinges(df: DataFrame, cols: list[str], label: Column, held_out: Column, most: int = 10, knots: int = 5, alpha: float = 1e-6) -> TermModel:
    """Hinges added greedily, all refitted together each time, while the error on the held-out rows falls."""
    return symbolic(df, cols, label, held_out, knots, most, alpha, 0.0, 0.0, ("hinge",))


def spline_gam(df: DataFrame, cols: list[str], label: Column, fold: Column, knots: int = 3, alphas: tuple[float, ...] = (0.0, 1e-3, 1e-2, 1e-1, 1.0, 10.0)) -> PiecewiseModel:
    """Linear splines whose changes of slope are penalised (in standard units), the strength by cross-validation over ``fold``; lines themselves are free."""
    terms = [t for t in dictionary(cols, knots_of(df, cols, [i / (knots + 1) for i in range(1, knots + 1)])) if t.direction > 0]
    bends = np.array([float(t.kind == "hinge") for t in terms])
    folds = _term_moments(df, terms, label, fold)
    alpha = min(alphas, key=lambda a: cross_validated(folds, lambda m: ridge(m, a * m.n * bends, standardise=True)))
    whole = sum(list(folds.values())[1:], start=next(iter(folds.values())))
    fit = ridge(whole, alpha * whole.n * bends, standardise=True)
    model = _with_coefs(terms, fit.coef, fit.intercept)
    return PiecewiseModel(model.terms, model.intercept)


def gbt_shapes(df: DataFrame, cols: list[str], label: Column, rounds: int = 100, rate: float = 0.1, passes: int = 0) -> ShapeModel:
    """Boosted trees of one split each, summed up as one shape for each column; ``passes`` smooth the shapes over their steps."""
    trees, weights = ensemble(df, cols, label, "gbt", rounds, 1, rate)
    steps: dict[tuple[str, float], float] = {}
    intercept = 0.0
    for tree, w in zip(trees, weights, strict=True):
        root = tree.nodes[0]
        if root.feature is None:
            intercept += w * root.value
            continue
        left, right = tree.nodes[root.left].value, tree.nodes[root.right].value
        intercept += w * left
        steps[root.feature, root.threshold] = steps.get((root.feature, root.threshold), 0.0) + w * (right - left)
    terms = []
    for c in cols:
        own = sorted((k, v) for (f, k), v in steps.items() if f == c)
        values = smoothed(np.cumsum([0.0, *(v for _, v in own)]), passes)
        terms += [Term("step", c, float(d), knot=float(k)) for (k, _), d in zip(own, np.diff(values), strict=True) if d]
    return ShapeModel(terms, float(intercept))


@dataclass
class FourierModel:
    """Ridge on random Fourier features; ``slopes`` is the straight equation closest to it."""

    columns: dict[str, Column]
    equation: Equation
    slopes: Equation

    def column(self) -> Column:
        return sum((float(b) * self.columns[n] for n, b in zip(self.equation.names, self.equation.coef, strict=True)), F.lit(self.equation.intercept))

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.column())

    def card(self) -> str:
        return "about " + linear_model(self.slopes).card()


def fourier_ridge(df: DataFrame, cols: list[str], label: Column, fold: Column, count: int = 50, gamma: float = 0.5, alphas: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0, 10.0), seed: int = 42) -> FourierModel:
    """Ridge on seeded random features of the standardised columns, its strength by cross-validation over ``fold``."""
    row = df.agg(*(f(c) for c in cols for f in (F.avg, F.stddev_pop))).first()
    scale = {c: (row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i, c in enumerate(cols)}
    features = fourier(cols, count, gamma, seed, scale)
    folds = gram(df.withColumn("__part", fold.cast("int")), features, label, ["__part"])
    whole = sum(list(folds.values())[1:], start=next(iter(folds.values())))
    alpha = min(alphas, key=lambda a: cross_validated(folds, lambda m: ridge(m, a)))
    model = FourierModel(features, ridge(whole, alpha), Equation(cols, np.zeros(len(cols)), 0.0))
    model.slopes = ridge(gram(df, {c: F.col(c) for c in cols}, model.column())[()], 0.0)
    return model


def symbolic(df: DataFrame, cols: list[str], label: Column, held_out: Column, knots: int = 3, most: int = 12, alpha: float = 1e-6, cost: float = 0.002, small: float = 0.01, kinds: tuple[str, ...] = ("linear", "square", "hinge", "step", "interact"), gain: float = 0.0, hierarchy: bool = False) -> TermModel:
    """A short equation: terms are added by their error on the held-out rows, as long as each lowers it by the share ``cost`` and half as much more for a new column, and by ``gain``; effects below the share ``small`` of the largest are then left out.

    With ``hierarchy``, a product may enter only after a term of each of its columns.
    """
    terms = dictionary(cols, dict(zip(cols, edges_of(df, cols, knots + 1), strict=True)), kinds)
    parts = _term_moments(df, terms, label, held_out)
    if not parts:
        return TermModel([], 0.0)
    train, valid = parts.get((0,)) or parts[(1,)], parts.get((1,)) or parts[(0,)]

    def error(keep: list[int]) -> float:
        fit = ridge(train, alpha, keep=keep)
        return valid.sse(fit.coef, fit.intercept)

    def columns(keep: list[int]) -> set[str]:
        return {x for i in keep for x in (terms[i].a, terms[i].b) if x}

    chosen: list[int] = []
    now = error(chosen)
    while len(chosen) < most:
        single = {terms[i].a for i in chosen if not terms[i].b}
        may = [i for i, t in enumerate(terms) if i not in chosen and (not hierarchy or not t.b or {t.a, t.b} <= single)]
        priced = [(error([*chosen, i]), i) for i in may]
        priced = [(e * (1 + cost * (1 + 0.5 * len(columns([*chosen, i]) - columns(chosen)))), e, i) for e, i in priced]
        if not priced or min(priced)[0] >= now * (1 - gain):
            break
        _, now, best = min(priced)
        chosen.append(best)
    whole = train + valid if len(parts) == 2 else train
    fit = ridge(whole, alpha, keep=sorted(chosen))
    if chosen:
        fit = prune(whole, fit, small)
    return _with_coefs(terms, fit.coef, fit.intercept)


def error_of(model: TermModel, df: DataFrame, label: Column) -> DataFrame:
    """Rows, root mean squared error and R squared of a model."""
    gap = F.pow(label - model.column(), 2)
    return df.agg(F.count(gap).alias("n"), F.sqrt(F.avg(gap)).alias("rmse"), (1 - F.avg(gap) / F.var_pop(F.when(gap.isNotNull(), label))).alias("r2"))
