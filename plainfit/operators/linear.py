"""Linear models solved from moments: least squares, ridge, lasso, elastic net, selection, pruning and rounding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bins import binned, edges_of
from ..plans.gram import Moments, gram
from .prep import bootstrap


@dataclass
class Equation:
    """intercept + sum of coef * column."""

    names: list[str]
    coef: np.ndarray
    intercept: float

    def active(self) -> list[str]:
        return [n for n, c in zip(self.names, self.coef, strict=True) if c]


def _finish(m: Moments, coef: np.ndarray) -> Equation:
    mean, _, _, _, label = m.centered()
    return Equation(m.names, coef, float(label - mean @ coef))


def ols(m: Moments, keep: list[int] | None = None) -> Equation:
    return ridge(m, 0.0, keep=keep)


def ridge(m: Moments, alpha: float | np.ndarray, standardise: bool = False, keep: list[int] | None = None) -> Equation:
    """Least squares with ``alpha`` (one, or one for each column) times the squared coefficients (of unit deviation, if ``standardise``); the intercept is free."""
    _, s, c, _, _ = m.centered()
    keep = list(range(len(c))) if keep is None else keep
    scale = np.sqrt(np.maximum(np.diag(s)[keep] / m.n, 1e-300)) if standardise else np.ones(len(keep))
    left = s[np.ix_(keep, keep)] / np.outer(scale, scale) + np.diag(np.broadcast_to(alpha, len(c))[keep].astype(float))
    coef = np.zeros(len(c))
    coef[keep] = np.linalg.lstsq(left, c[keep] / scale, rcond=1e-12)[0] / scale
    return _finish(m, coef)


def elastic_net(m: Moments, alpha: float, l1_ratio: float = 1.0, rounds: int = 2000, start: np.ndarray | None = None) -> Equation:
    """Coordinate descent on the moments for mean squared error / 2 + alpha * (l1_ratio * |b| + (1 - l1_ratio) * b^2 / 2), on standardised columns."""
    _, s, c, _, _ = m.centered()
    scale = np.sqrt(np.maximum(np.diag(s) / m.n, 0))
    usable = scale > 1e-12
    safe = np.where(usable, scale, 1.0)
    q, r = s / m.n / np.outer(safe, safe), c / m.n / safe
    b = np.zeros(len(c)) if start is None else start * safe
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(usable):
            rest = r[j] - q[j] @ b + q[j, j] * b[j]
            new = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0) / (q[j, j] + alpha * (1 - l1_ratio))
            moved = max(moved, abs(new - b[j]))
            b[j] = new
        if moved < 1e-9 * max(1e-12, np.abs(r).max()):
            break
    return _finish(m, np.where(usable, b / safe, 0.0))


def lasso_path(m: Moments, n: int = 40, depth: float = 1e-3, l1_ratio: float = 1.0) -> list[tuple[float, Equation]]:
    _, s, c, _, _ = m.centered()
    scale = np.sqrt(np.maximum(np.diag(s) / m.n, 1e-300))
    top = float(np.abs(c / m.n / scale).max()) / l1_ratio
    out, start = [], None
    for alpha in np.geomspace(top, top * depth, n):
        fit = elastic_net(m, float(alpha), l1_ratio, start=start)
        start = fit.coef
        out.append((float(alpha), fit))
    return out


def cross_validated(folds: dict[tuple, Moments], fit) -> float:
    """Mean squared error over the folds of ``fit(training moments)``; the data isn't read again."""
    total = sum(folds.values(), start=Moments(*(lambda f: (f.names, f.center, np.zeros_like(f.matrix)))(next(iter(folds.values())))))
    errors = 0.0
    for part in folds.values():
        e = fit(total - part)
        errors += part.sse(e.coef, e.intercept)
    return errors / total.n


def _path_cv(folds: dict[tuple, Moments], n: int, l1_ratio: float) -> tuple[float, float, Moments]:
    """The least cross-validated error of a path, its alpha, and all rows' moments; each fold's path starts every fit from the one before."""
    total = sum(list(folds.values())[1:], start=next(iter(folds.values())))
    alphas = [a for a, _ in lasso_path(total, n, l1_ratio=l1_ratio)]
    errors = np.zeros(n)
    for part in folds.values():
        train, start = total - part, None
        for i, a in enumerate(alphas):
            fit = elastic_net(train, a, l1_ratio, start=start)
            start = fit.coef
            errors[i] += part.sse(fit.coef, fit.intercept)
    error, best = min(zip(errors, alphas, strict=True))
    return error, best, total


def lasso_cv(folds: dict[tuple, Moments], n: int = 40, l1_ratio: float = 1.0) -> tuple[Equation, float]:
    """The path's equation with the least cross-validated error, and its alpha."""
    _, best, total = _path_cv(folds, n, l1_ratio)
    return elastic_net(total, best, l1_ratio), best


def elastic_net_cv(folds: dict[tuple, Moments], ratios: tuple[float, ...] = (0.1, 0.5, 0.7, 0.9, 0.95, 1.0), n: int = 40) -> tuple[Equation, float, float]:
    """The equation, alpha and l1_ratio with the least cross-validated error."""
    (_, alpha, total), ratio = min(((_path_cv(folds, n, r), r) for r in ratios), key=lambda x: (x[0][0], -x[1]))
    return elastic_net(total, alpha, ratio), alpha, ratio


def ridge_loo(df: DataFrame, cols: dict[str, Column], label: Column, alphas: list[float]) -> tuple[Equation, float]:
    """Ridge by exact leave-one-out errors e / (1 - h); a second pass over the rows sums those of all alphas."""
    m = gram(df, cols, label)[()]
    mean, s, c, _, middle = m.centered()
    values, vectors = np.linalg.eigh(s)
    values, g = np.maximum(values, 0), vectors.T @ c
    u = [sum((float(v) * (x.cast("double") - float(a)) for v, x, a in zip(vectors[:, k], cols.values(), mean, strict=True)), F.lit(0.0)).alias(f"u{k}") for k in range(len(g))]
    rows = df.select(*u, label.cast("double").alias("y")).na.drop()
    errors = []
    for i, alpha in enumerate(alphas):
        fitted = sum((float(gk / (v + alpha)) * F.col(f"u{k}") for k, (gk, v) in enumerate(zip(g, values, strict=True))), F.lit(float(middle)))
        h = sum((float(1 / (v + alpha)) * F.col(f"u{k}") * F.col(f"u{k}") for k, v in enumerate(values) if v + alpha > 0), F.lit(1 / m.n))
        errors.append(F.avg(F.pow((F.col("y") - fitted) / (1 - h), 2)).alias(f"a{i}"))
    row = rows.agg(*errors).first()
    best = alphas[min(range(len(alphas)), key=lambda i: row[i])]
    return ridge(m, best), best


def huber(df: DataFrame, cols: dict[str, Column], label: Column, epsilon: float = 1.35) -> Equation:
    """Huber regression; rows with a null are left out."""
    names = [f"x{i}" for i in range(len(cols))]
    data = df.select(*(c.cast("double").alias(n) for n, c in zip(names, cols.values(), strict=True)), label.cast("double").alias("y")).na.drop()
    fit = LinearRegression(featuresCol="f", labelCol="y", loss="huber", epsilon=epsilon, maxIter=200, tol=1e-8).fit(VectorAssembler(inputCols=names, outputCol="f").transform(data))
    return Equation(list(cols), np.array(fit.coefficients.toArray()), float(fit.intercept))


def irls_mad(df: DataFrame, cols: dict[str, Column], label: Column, rounds: int = 5, bound: float = 2.5) -> Equation:
    """Least squares with weights that fall as 1 / |residual| beyond ``bound`` deviations, these by the median absolute residual of each round."""
    fit = ols(gram(df, cols, label)[()])
    for _ in range(rounds):
        rest = F.abs(label.cast("double") - sum((float(b) * c for b, c in zip(fit.coef, cols.values(), strict=True)), F.lit(fit.intercept)))
        middle = df.agg(F.percentile_approx(rest, 0.5, 10_000)).first()[0]
        if not middle:
            break
        limit = bound * 1.4826 * middle
        new = ols(gram(df, cols, label, weight=F.when(rest <= limit, 1.0).otherwise(limit / rest))[()])
        moved = np.abs(new.coef - fit.coef).max(initial=0.0)
        fit = new
        if moved <= 1e-9 * max(1e-12, np.abs(fit.coef).max(initial=0.0)):
            break
    return fit


def averaged(fits: list[Equation], weights: list[float] | None = None) -> Equation:
    """One equation from several of the same columns."""
    w = np.array(weights if weights is not None else [1.0] * len(fits)) / (sum(weights) if weights is not None else len(fits))
    return Equation(fits[0].names, sum(a * f.coef for a, f in zip(w, fits, strict=True)), float(sum(a * f.intercept for a, f in zip(w, fits, strict=True))))


def ridge_gcv(m: Moments, alphas: list[float]) -> tuple[Equation, float]:
    """Ridge by generalised cross-validation on the eigenvalues of the moments."""
    _, s, c, yy, _ = m.centered()
    values, vectors = np.linalg.eigh(s)
    values, g = np.maximum(values, 0), vectors.T @ c

    def score(alpha):
        shrunk = g / (values + alpha)
        sse = yy - 2 * shrunk @ g + (shrunk**2) @ values
        return m.n * sse / (m.n - 1 - (values / (values + alpha)).sum()) ** 2

    alpha = min(alphas, key=score)
    return ridge(m, alpha), alpha


def bayesian_ridge(m: Moments, rounds: int = 300) -> tuple[Equation, float, float]:
    """Evidence-maximising ridge; also the precisions of noise and weights."""
    _, s, c, yy, _ = m.centered()
    values, vectors = np.linalg.eigh(s)
    values, g = np.maximum(values, 0), vectors.T @ c
    noise, weight = m.n / max(yy, 1e-300), 1.0
    for _ in range(rounds):
        w = g / (values + weight / noise)
        gamma = (noise * values / (weight + noise * values)).sum()
        sse = max(yy - 2 * w @ g + (w**2) @ values, 1e-300)
        new = (m.n - gamma) / sse, gamma / max(w @ w, 1e-300)
        done = abs(new[1] - weight) < 1e-9 * weight
        noise, weight = new
        if done:
            break
    return ridge(m, weight / noise), noise, weight


def forward(m: Moments, k: int) -> list[int]:
    """Greedy selection by squared error."""
    chosen: list[int] = []
    for _ in range(min(k, len(m.names))):
        rest = [j for j in range(len(m.names)) if j not in chosen]
        chosen.append(min(rest, key=lambda j: (m.sse(*(lambda e: (e.coef, e.intercept))(ols(m, [*chosen, j]))), j)))
    return chosen


def forward_cv(folds: dict[tuple, Moments], most: int | None = None, patience: int = 2) -> list[int]:
    """Greedy selection that goes on while the cross-validated error falls, ``patience`` steps beyond its least."""
    total = sum(list(folds.values())[1:], start=next(iter(folds.values())))
    order = forward(total, most or len(total.names))
    best = (cross_validated(folds, lambda t: ols(t, [])), 0)
    for k in range(1, len(order) + 1):
        error = cross_validated(folds, lambda t: ols(t, order[:k]))  # noqa: B023
        if error < best[0]:
            best = (error, k)
        elif k - best[1] >= patience:
            break
    return order[: best[1]]


def omp(m: Moments, k: int) -> list[int]:
    """Orthogonal matching pursuit: each time the column closest to what is left, then all refitted."""
    _, s, c, _, _ = m.centered()
    scale = np.sqrt(np.maximum(np.diag(s), 1e-300))
    chosen: list[int] = []
    for _ in range(min(k, len(c))):
        rest = np.abs(c - s @ ols(m, chosen).coef) / scale
        rest[chosen] = -1.0
        if rest.max() <= 1e-12 * np.abs(c / scale).max():
            break
        chosen.append(int(rest.argmax()))
    return chosen


def lars(m: Moments, k: int) -> list[int]:
    """The columns in the order in which least-angle regression takes them."""
    _, s, c, _, _ = m.centered()
    scale = np.sqrt(np.maximum(np.diag(s), 0))
    usable = scale > 1e-12
    safe = np.where(usable, scale, 1.0)
    q, rest = s / np.outer(safe, safe), np.where(usable, c / safe, 0.0)
    chosen: list[int] = []
    while len(chosen) < min(k, int(usable.sum())):
        out = [j for j in np.flatnonzero(usable) if j not in chosen]
        if not chosen:
            chosen.append(max(out, key=lambda j: abs(rest[j])))
            continue
        sign = np.sign(rest[chosen])
        solved = np.linalg.lstsq(q[np.ix_(chosen, chosen)], sign, rcond=1e-12)[0]
        size = 1 / np.sqrt(max(sign @ solved, 1e-300))
        angle = q[:, chosen] @ (solved * size)  # of each column with the equiangular direction
        top = np.abs(rest[chosen]).max()
        steps = [(x, j) for j in out for x in ((top - rest[j]) / max(size - angle[j], 1e-300), (top + rest[j]) / max(size + angle[j], 1e-300)) if x > 1e-15]
        if not steps:
            break
        step, j = min(steps)
        rest = rest - step * angle
        chosen.append(int(j))
    return chosen


def top_by_correlation(m: Moments, k: int) -> list[int]:
    _, s, c, _, _ = m.centered()
    size = np.abs(c) / np.sqrt(np.maximum(np.diag(s), 1e-300))
    return sorted(np.argsort(-size, kind="stable")[:k].tolist())


def prescreen(m: Moments, var_min: float = 1e-10, corr_max: float = 0.95) -> list[int]:
    """Columns that vary, without the later one of each closely correlated pair."""
    _, s, _, _, _ = m.centered()
    kept: list[int] = []
    for j in range(len(s)):
        if s[j, j] / m.n > var_min and all(abs(s[i, j]) <= corr_max * np.sqrt(s[i, i] * s[j, j]) for i in kept):
            kept.append(j)
    return kept


def prune(m: Moments, fit: Equation, relative: float = 0.05) -> Equation:
    """Least squares on the columns whose standardised effect is at least ``relative`` of the largest."""
    _, s, _, _, _ = m.centered()
    effect = np.abs(fit.coef) * np.sqrt(np.maximum(np.diag(s) / m.n, 0))
    return ols(m, np.flatnonzero(effect >= relative * effect.max()).tolist())


def prune_iterative(m: Moments, fit: Equation, relative: float = 0.05) -> Equation:
    """``prune`` until nothing goes."""
    while len((new := prune(m, fit, relative)).active()) < len(fit.active()):
        fit = new
    return fit


def prune_mass(m: Moments, fit: Equation, mass: float = 0.96, least: int = 1, most: int | None = None) -> Equation:
    """Least squares on the largest standardised effects that hold the share ``mass`` of their sum."""
    _, s, _, _, _ = m.centered()
    effect = np.abs(fit.coef) * np.sqrt(np.maximum(np.diag(s) / m.n, 0))
    order = np.argsort(-effect, kind="stable")
    k = int(np.searchsorted(np.cumsum(effect[order]), mass * effect.sum() * (1 - 1e-12))) + 1
    k = min(max(k, least), most or len(order), int((effect > 0).sum()) or 1)
    return ols(m, sorted(order[:k].tolist()))


def selected(folds: dict[tuple, Moments], k: int = 8, selector: str | list[float] = "lasso", refit: str = "ols", alpha: float = 1.0) -> Equation:
    """The ``k`` best columns by a selector, fitted anew by least squares or ridge on all rows.

    Selectors: ``lasso`` and ``enet`` (largest standardised coefficients of the cross-validated path), ``corr``,
    ``effect`` (of least squares), ``forward``, ``omp``, ``lars``; or a score of each column, as
    ``mutual_information`` and ``tree_importance`` give.
    """
    total = sum(list(folds.values())[1:], start=next(iter(folds.values())))
    _, s, _, _, _ = total.centered()
    scale = np.sqrt(np.maximum(np.diag(s) / total.n, 0))
    if selector in ("omp", "lars", "forward"):
        keep = {"omp": omp, "lars": lars, "forward": forward}[selector](total, k)
    else:
        if isinstance(selector, str):
            fit = {"lasso": lambda: lasso_cv(folds)[0].coef * scale, "enet": lambda: elastic_net_cv(folds)[0].coef * scale, "effect": lambda: ols(total).coef * scale, "corr": lambda: corr_with(total)}
            score = np.abs(fit[selector]())
        else:
            score = np.asarray(selector, dtype=float)
        keep = [j for j in np.argsort(-score, kind="stable")[:k].tolist() if score[j] > 0] or [int(score.argmax())]
    return ridge(total, alpha if refit == "ridge" else 0.0, keep=sorted(keep))


def tree_importance(df: DataFrame, cols: list[str], label: Column, rounds: int = 30, depth: int = 3, seed: int = 42) -> list[float]:
    """Each column's share of what the splits of boosted trees gain."""
    data = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)), label.cast("double").alias("y")).na.drop()
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(cols))], outputCol="f").transform(data)
    return GBTRegressor(featuresCol="f", labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed).fit(data).featureImportances.toArray().tolist()


def mutual_information(df: DataFrame, cols: list[str], label: str, bins: int = 16) -> list[float]:
    """Of each column with the label, both in quantile bins, from one binned moment job."""
    names = [*cols, label]
    b = binned(df, names, F.col(label), edges_of(df, names, bins))
    if not b:
        return [0.0] * len(cols)
    meet, out = b[0], []
    for at in meet.cells[:-1]:
        joint = meet.meet[at, meet.cells[-1]] / meet.n
        apart = np.outer(joint.sum(1), joint.sum(0))
        some = joint > 0
        out.append(float((joint[some] * np.log(joint[some] / apart[some])).sum()))
    return out


def stability_select(df: DataFrame, cols: dict[str, Column], label: Column, key: list[str], replicates: int = 20, frequency: float = 0.6, k: int = 8, seed: int = 42) -> tuple[Equation, dict[str, float]]:
    """Least squares on the columns that are among the first ``k`` of the lasso path in the share ``frequency`` of bootstrap replicates, whose moments one job sums; also the shares."""
    rows = df.select(*key, *(c.cast("double").alias(f"__c{i}") for i, c in enumerate(cols.values())), label.cast("double").alias("__y"))
    drawn = bootstrap(rows, key, replicates, seed)
    named = {n: F.col(f"__c{i}") for i, n in enumerate(cols)}
    parts = gram(drawn, named, F.col("__y"), ["replicate"], weight=F.col("weight"))
    seen = np.zeros(len(cols))
    for m in parts.values():
        path = [f for _, f in lasso_path(m) if np.count_nonzero(f.coef) <= k]
        seen += (path[-1].coef if path else np.zeros(len(cols))) != 0
    share = seen / max(len(parts), 1)
    keep = np.flatnonzero(share >= frequency).tolist() or [int(share.argmax())]
    return ols(gram(rows, named, F.col("__y"))[()], keep), dict(zip(cols, share.tolist(), strict=True))


def subspace_ridge(m: Moments, fits: int = 50, share: float = 0.6, alpha: float = 1.0, seed: int = 42) -> Equation:
    """The mean of ridge fits on random parts of the columns, solved from sub-blocks of the moments."""
    rng, p = np.random.default_rng(seed), len(m.names)
    size = max(1, round(share * p))
    return averaged([ridge(m, alpha, keep=sorted(rng.permutation(p)[:size].tolist())) for _ in range(fits)])


def boosted_ridge(m: Moments, rounds: int = 50, rate: float = 0.1, alpha: float = 1.0, share: float = 1.0, seed: int = 42) -> Equation:
    """Steps of ``rate`` towards ridge fits of what is left, on random parts of the columns; one equation in the end."""
    rng, (_, s, c, _, _) = np.random.default_rng(seed), m.centered()
    b, p = np.zeros(len(c)), len(c)
    size = max(1, round(share * p))
    for _ in range(rounds):
        keep = np.sort(rng.permutation(p)[:size])
        b[keep] += rate * np.linalg.lstsq(s[np.ix_(keep, keep)] + alpha * np.eye(size), (c - s @ b)[keep], rcond=1e-12)[0]
    return _finish(m, b)


def corr_matrix(m: Moments) -> np.ndarray:
    """Correlations of the columns and, last, the label; 0 where one is constant."""
    mean = m.matrix[0, 1:] / m.n
    s = m.matrix[1:, 1:] - m.n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(s), 0))
    safe = np.where(scale > 1e-12, scale, np.inf)
    return np.where(np.eye(len(s), dtype=bool), 1.0, s / np.outer(safe, safe))


def corr_with(m: Moments) -> np.ndarray:
    """Each column's correlation with the label."""
    return corr_matrix(m)[:-1, -1]


def top_correlations(m: Moments) -> list[tuple[str, float]]:
    """(column, correlation with the label), the largest by size first."""
    return sorted(zip(m.names, corr_with(m).tolist(), strict=True), key=lambda x: -abs(x[1]))


def screen(df: DataFrame, cols: list[str], label: Column, k: int, relative: float = 0.0, centers: dict[str, float] | None = None) -> list[str]:
    """At most ``k`` columns by the largest correlation of the label with the column, its distance from a center (the mean) or the square of that; those below the share ``relative`` of the best go, and so do constant ones."""
    centers = centers or {c: v or 0.0 for c, v in zip(cols, df.agg(*(F.avg(c) for c in cols)).first(), strict=True)}
    shapes = {f"{kind}{i}": f for i, c in enumerate(cols) for kind, f in (("x", F.col(c)), ("a", F.abs(F.col(c) - centers[c])), ("s", F.pow(F.col(c) - centers[c], 2)))}
    size = np.abs(corr_with(gram(df, shapes, label)[()])).reshape(-1, 3).max(axis=1)
    order = [i for i in np.argsort(-size, kind="stable")[:k] if size[i] > 0 and size[i] >= relative * size.max()]
    return [cols[i] for i in sorted(order)]


def sparse_bayes(m: Moments, relative: float = 0.05) -> Equation:
    """Evidence-maximising ridge without the columns of small standardised effect, those that stay fitted anew with the same precisions."""
    fit, noise, weight = bayesian_ridge(m)
    _, s, _, _, _ = m.centered()
    effect = np.abs(fit.coef) * np.sqrt(np.maximum(np.diag(s) / m.n, 0))
    return ridge(m, weight / noise, keep=np.flatnonzero(effect >= relative * effect.max()).tolist())


def priced_rounding(fit: Equation, validation: Moments, digits: tuple[int, ...] = (6, 5, 4, 3, 2), cost: float = 0.01) -> Equation:
    """The number of decimals with the least validation error times 1 + ``cost`` for each term that is left."""
    def priced(d: int) -> float:
        coef = np.round(fit.coef, d)
        return validation.sse(coef, round(fit.intercept, d)) ** 0.5 * (1 + cost * np.count_nonzero(coef))

    best = min(digits, key=lambda d: (priced(d), d))
    return Equation(fit.names, np.round(fit.coef, best), round(fit.intercept, best))


def quantised(fit: Equation, validation: Moments, steps: tuple[float, ...] = (0.2, 0.1, 0.05, 0.02, 0.01), tolerance: float = 0.005) -> Equation:
    """Coefficients as multiples of the coarsest step (a share of the largest, to one digit) that costs at most ``tolerance`` of the validation error; what is under half a step goes."""
    exact, top = validation.sse(fit.coef, fit.intercept), np.abs(fit.coef).max(initial=0.0)
    for share in steps if top else ():
        step = float(f"{share * top:.0e}")
        tried = Equation(fit.names, np.round(fit.coef / step) * step, fit.intercept)
        if validation.sse(tried.coef, tried.intercept) <= exact * (1 + tolerance):
            return tried
    return fit


def round_coefs(fit: Equation, validation: Moments, digits: tuple[int, ...] = (0, 1, 2, 3, 4), tolerance: float = 0.001) -> Equation:
    """The fewest decimals that cost at most ``tolerance`` of the validation error."""
    exact = validation.sse(fit.coef, fit.intercept)
    for d in digits:
        tried = Equation(fit.names, np.round(fit.coef, d), round(fit.intercept, d))
        if validation.sse(tried.coef, tried.intercept) <= exact * (1 + tolerance):
            return tried
    return fit
