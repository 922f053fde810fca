"""Readable regression trees: fitted by Spark, then reshaped as a small table of nodes and scored as a Column."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bins import binned, edges_of
from ..plans.gram import gram
from ..sources.scratch import materialise, shared_path
from .linear import corr_with, lasso_cv, ridge, ridge_gcv, top_by_correlation
from .model import Term, TermModel, linear_model, number


@dataclass(frozen=True)
class Node:
    """A leaf has no ``feature``; other nodes send values up to ``threshold`` to the left, all else and nulls to the right."""

    value: float
    n: int
    impurity: float
    gain: float = 0.0
    left: int = -1
    right: int = -1
    feature: str | None = None
    threshold: float = 0.0


@dataclass(frozen=True)
class Rule:
    """low < feature <= high for each condition, None for an open side."""

    conditions: dict[str, tuple[float | None, float | None]]
    value: float
    n: int

    def column(self) -> Column:
        out = F.lit(True)
        for c, (low, high) in self.conditions.items():
            out = out & (F.lit(True) if low is None else F.col(c) > low) & (F.lit(True) if high is None else F.col(c) <= high)
        return out

    def text(self) -> str:
        parts = [" ".join([*([f"{low:g} <"] if low is not None else []), c, *([f"<= {high:g}"] if high is not None else [])]) for c, (low, high) in self.conditions.items()]
        return f"{' and '.join(parts) or 'always'}: {self.value:.6g} ({self.n} rows)"


@dataclass
class Tree:
    nodes: dict[int, Node]

    def _fold(self, at: int, leaf) -> Column:
        n = self.nodes[at]
        if n.feature is None:
            return leaf(at, n)
        return F.when(F.col(n.feature) <= n.threshold, self._fold(n.left, leaf)).otherwise(self._fold(n.right, leaf))

    def column(self) -> Column:
        return self._fold(0, lambda at, n: F.lit(n.value))

    def sql(self) -> str:
        def of(at: int) -> str:
            n = self.nodes[at]
            return number(n.value) if n.feature is None else f'CASE WHEN "{n.feature}" <= {number(n.threshold)} THEN {of(n.left)} ELSE {of(n.right)} END'

        return of(0)

    def leaf(self) -> Column:
        """The number of the leaf a row ends in."""
        return self._fold(0, lambda at, n: F.lit(at))

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.column())

    def leaves(self, at: int = 0) -> list[int]:
        n = self.nodes[at]
        return [at] if n.feature is None else self.leaves(n.left) + self.leaves(n.right)

    def _without(self, at: int) -> Tree:
        """The node as a leaf."""
        return Tree({**self.nodes, at: replace(self.nodes[at], feature=None, left=-1, right=-1)})

    def _inner(self, at: int = 0) -> list[int]:
        n = self.nodes[at]
        return [] if n.feature is None else [at, *self._inner(n.left), *self._inner(n.right)]

    def rules(self) -> list[Rule]:
        """Every leaf's conditions, those on one column taken together; few conditions and many rows first."""

        def walk(at: int, bounds: dict) -> list[Rule]:
            n = self.nodes[at]
            if n.feature is None:
                return [Rule(bounds, n.value, n.n)]
            low, high = bounds.get(n.feature, (None, None))
            left = {**bounds, n.feature: (low, n.threshold)}
            return walk(n.left, left) + walk(n.right, {**bounds, n.feature: (n.threshold, high)})

        return sorted(walk(0, {}), key=lambda r: (len(r.conditions), -r.n))

    def card(self) -> str:
        return "\n".join(r.text() for r in self.rules())


def decision_list(rules: list[Rule], otherwise: float) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(float(otherwise))
    for r in reversed(rules):
        out = F.when(r.column(), r.value).otherwise(out)
    return out


def _from_rows(rows, cols: list[str]) -> Tree:
    """A tree of the rows of a saved model's node table."""
    tree = Tree({})
    for r in rows:
        split = r.split.featureIndex >= 0
        tree.nodes[r.id] = Node(r.prediction, r.rawCount, r.impurity, r.gain if split else 0.0, r.leftChild, r.rightChild, cols[r.split.featureIndex] if split else None, r.split.leftCategoriesOrThreshold[0] if split else 0.0)
    return tree


def _assembled(df: DataFrame, cols: list[str], label: Column) -> DataFrame:
    """Complete rows as __features and __y."""
    data = df.select(*(F.col(c).cast("double").alias(c) for c in cols), label.cast("double").alias("__y")).na.drop()
    return VectorAssembler(inputCols=cols, outputCol="__features").transform(data)


def fit_tree(df: DataFrame, cols: list[str], label: Column, max_depth: int = 4, max_leaves: int | None = None, min_leaf: int = 1, max_bins: int = 32) -> Tree:
    """A regression tree; rows with a null in a column or the label are left out, and without rows it is one leaf of 0."""
    data = _assembled(df, cols, label)
    if data.isEmpty():
        return Tree({0: Node(0.0, 0, 0.0)})
    fit = DecisionTreeRegressor(featuresCol="__features", labelCol="__y", maxDepth=max_depth, minInstancesPerNode=min_leaf, maxBins=max_bins, maxMemoryInMB=128).fit(data)
    path = shared_path(df.sparkSession, "tree")
    fit.save(path)
    tree = _from_rows(df.sparkSession.read.parquet(f"{path}/data").collect(), cols)  # as many rows as the tree has nodes
    return pruned_to(tree, max_leaves) if max_leaves else tree


def pruned_to(tree: Tree, max_leaves: int) -> Tree:
    """Takes away the splits of least gain until ``max_leaves`` are left; smaller budgets give trees within those of larger ones."""
    while len(tree.leaves()) > max_leaves:
        ends = [i for i in tree._inner() if all(tree.nodes[c].feature is None for c in (tree.nodes[i].left, tree.nodes[i].right))]
        tree = tree._without(min(ends, key=lambda i: (tree.nodes[i].gain * tree.nodes[i].n, i)))
    return tree


def ensemble(df: DataFrame, cols: list[str], label: Column, kind: str = "gbt", trees: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 42) -> tuple[list[Tree], list[float]]:
    """The trees of a forest (``rf``) or of boosted trees (``gbt``) and their weights in the sum."""
    data = _assembled(df, cols, label)
    if data.isEmpty():
        return [Tree({0: Node(0.0, 0, 0.0)})], [1.0]
    common = {"featuresCol": "__features", "labelCol": "__y", "maxDepth": depth, "seed": seed, "maxMemoryInMB": 128}
    fit = (RandomForestRegressor(numTrees=trees, **common) if kind == "rf" else GBTRegressor(maxIter=trees, stepSize=rate, **common)).fit(data)
    path = shared_path(df.sparkSession, "trees")
    fit.save(path)
    rows = df.sparkSession.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # as many rows as the trees have nodes
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.treeID, []).append(r)
    weights = [1 / trees] * len(by) if kind == "rf" else list(fit.treeWeights)
    return [_from_rows(by[i], cols) for i in sorted(by)], weights


@dataclass
class TreeSum:
    """A weighted sum of trees, all of them shown."""

    trees: list[Tree]
    weights: list[float]
    base: object = None

    def column(self) -> Column:
        out = self.base.column() if self.base is not None else F.lit(0.0)
        for t, w in zip(self.trees, self.weights, strict=True):
            out = out + float(w) * t.column()
        return out

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.column())

    def sql(self) -> str:
        return " + ".join([*([self.base.sql()] if self.base is not None else []), *(f"{number(w)} * ({t.sql()})" for t, w in zip(self.trees, self.weights, strict=True))])

    def card(self) -> str:
        parts = [self.base.card()] if self.base is not None else []
        return "\n".join([*parts, *(f"{w:+.6g} times\n{t.card()}" for t, w in zip(self.trees, self.weights, strict=True))])


def mini_boost(df: DataFrame, cols: list[str], label: Column, trees: int = 5, depth: int = 3, rate: float = 0.5) -> TreeSum:
    """A few boosted trees, small enough to be shown in full."""
    return TreeSum(*ensemble(df, cols, label, "gbt", trees, depth, rate))


def distilled_tree(df: DataFrame, cols: list[str], label: Column, held_out: Column, alpha: float = 0.5, leaves: tuple[int, ...] = (4, 8, 12, 16, 20), strengths: tuple[float, ...] = (0.0, 1.0, 10.0, 50.0), depth: int = 6, trees: int = 50, fit_on_labels: bool = True) -> Tree:
    """A tree for ``alpha`` of a forest's and a booster's mean prediction and the rest of the label, its leaves and shrinkage by the held-out rows, fitted anew on all rows.

    Trees of all budgets come from one fit, and one pass over the held-out rows scores all of them.
    """
    names = [*cols, "__label"]

    def blended_rows(rows: DataFrame) -> DataFrame:
        said = [TreeSum(*ensemble(rows, cols, F.col("__label"), k, n, d)).column() for k, n, d in (("rf", trees, 5), ("gbt", 2 * trees, 3))]
        return rows.withColumn("__target", alpha * (said[0] + said[1]) / 2 + (1 - alpha) * F.col("__label"))

    data = df.select(*(F.col(c).cast("double").alias(c) for c in cols), label.cast("double").alias("__label"), held_out.alias("__held")).na.drop()
    train, test = data.filter("not __held").select(*names), data.filter("__held").select(*names)
    whole = fit_tree(blended_rows(train), cols, F.col("__target"), depth)
    tried = {(k, s): shrink(pruned_to(whole, k), s) for k in leaves for s in strengths}
    row = test.agg(*(F.avg(F.pow(F.col("__label") - t.column(), 2)).alias(f"e{i}") for i, t in enumerate(tried.values()))).first()
    best = min(enumerate(tried), key=lambda x: (row[x[0]] if row[x[0]] is not None else 0.0, x[1]))[1]
    every = data.select(*names)
    tree = pruned_to(fit_tree(blended_rows(every), cols, F.col("__target"), depth), best[0])
    return shrink(recalibrate(tree, every, F.col("__label")) if fit_on_labels else tree, best[1])


def noisy_copies(df: DataFrame, cols: list[str], key: list[str], copies: int, noise: float, seed: int = 42) -> DataFrame:
    """Each row and ``copies`` more with normal noise of ``noise`` deviations on ``cols``; ``__copy`` tells them apart, 0 is the row itself.

    The noise comes from a hash of key, copy and column, so it is the same however the rows are spread.
    """
    row = df.agg(*(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols))).first()
    out = df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))

    def uniform(i: int, which: int) -> Column:
        return (F.pmod(F.xxhash64(*key, "__copy", F.lit(i), F.lit(which), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    shaken = {c: F.col(c) + noise * float(row[f"s{i}"] or 0.0) * F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1)) for i, c in enumerate(cols)}
    return out.withColumns({c: F.when(F.col("__copy") == 0, F.col(c)).otherwise(x) for c, x in shaken.items()})


def distilled_by_folds(df: DataFrame, cols: list[str], label: Column, fold: Column, k: int, key: list[str], alpha: float = 0.5, leaves: tuple[int, ...] = (4, 8, 12, 16, 20), strengths: tuple[float, ...] = (0.0, 1.0, 10.0, 50.0), depth: int = 6, trees: int = 50, copies: int = 0, noise: float = 0.1, rounds: int = 1) -> tuple[Tree, DataFrame]:
    """A distilled tree whose leaves and shrinkage have the least error over ``fold``, and (leaves, strength, fold, n, rmse) of all that were tried.

    The teachers of a fold, a forest and a booster, see the other folds only.  A student learns ``alpha`` of their mean
    and the rest of the label; noisy copies of the rows, of which there are ``copies``, learn what the teachers say.  In
    each further round the next student learns the mean of the last target and what the last student says.  Trees of all
    budgets come from one fit a round, and one pass over the rows scores the trees of all folds.
    """
    data = df.select(*dict.fromkeys([*cols, *key]), label.cast("double").alias("__label"), fold.cast("int").alias("__fold"))
    data = data.withColumns({c: F.col(c).cast("double") for c in cols}).na.drop(subset=[*cols, "__label"])

    def student(rows: DataFrame) -> Tree:
        said = [TreeSum(*ensemble(rows, cols, F.col("__label"), kind, n, d)).column() for kind, n, d in (("rf", trees, 5), ("gbt", 2 * trees, 3))]
        rows = noisy_copies(rows, cols, key, copies, noise) if copies else rows.withColumn("__copy", F.lit(0))
        rows = rows.withColumn("__said", (said[0] + said[1]) / 2)
        target = F.when(F.col("__copy") == 0, alpha * F.col("__said") + (1 - alpha) * F.col("__label")).otherwise(F.col("__said"))
        rows = materialise(rows.withColumn("__target", target).select(*cols, "__target"), "distil")
        tree = fit_tree(rows, cols, F.col("__target"), depth)
        for _ in range(rounds - 1):
            rows = materialise(rows.withColumn("__target", (F.col("__target") + tree.column()) / 2), "distil")
            tree = fit_tree(rows, cols, F.col("__target"), depth)
        return tree

    grown = [student(data.filter(F.col("__fold") != i)) for i in range(k)]
    tried = [(n, s) for n in leaves for s in strengths]
    pred = [F.coalesce(*(F.when(F.col("__fold") == i, shrink(pruned_to(t, n), s).column()) for i, t in enumerate(grown))) for n, s in tried]
    found = data.groupBy("__fold").agg(F.count("__label").alias("n"), *(F.avg(F.pow(F.col("__label") - p, 2)).alias(f"e{j}") for j, p in enumerate(pred))).filter(F.col("__fold").between(0, k - 1)).collect()  # a row for each fold
    surface = [(n, s, r["__fold"], r.n, r[f"e{j}"] ** 0.5) for r in found for j, (n, s) in enumerate(tried)]
    total = {t: sum(r.n * r[f"e{j}"] for r in found) for j, t in enumerate(tried)}
    best = min(tried, key=lambda t: (total[t], t))
    tree = shrink(pruned_to(student(data), best[0]), best[1])
    return tree, df.sparkSession.createDataFrame(surface, "leaves int, strength double, fold int, n long, rmse double")


@dataclass
class ModelTree:
    """A tree with a linear equation in the leaves that have one."""

    tree: Tree
    equations: dict[int, TermModel]

    def column(self) -> Column:
        return self.tree._fold(0, lambda at, n: self.equations[at].column() if at in self.equations else F.lit(n.value))

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.column())

    def sql(self) -> str:
        def of(at: int) -> str:
            n = self.tree.nodes[at]
            if n.feature is None:
                return self.equations[at].sql() if at in self.equations else number(n.value)
            return f'CASE WHEN "{n.feature}" <= {number(n.threshold)} THEN {of(n.left)} ELSE {of(n.right)} END'

        return of(0)

    def card(self) -> str:
        rules = {r.value: r for r in self.tree.rules()}
        lines = []
        for at in self.tree.leaves():
            n = self.tree.nodes[at]
            said = self.equations[at].card().replace("\n", " ") if at in self.equations else f"y = {n.value:.6g}"
            lines.append(f"{rules[n.value].text().rpartition(': ')[0]}: {said} ({n.n} rows)")
        return "\n".join(lines)


def model_tree(df: DataFrame, cols: list[str], label: Column, max_depth: int = 2, max_leaves: int = 4, alpha: float = 1.0, gain: float = 0.1, k: int | None = None, min_leaf: int = 20) -> ModelTree:
    """A shallow tree with ridge in each leaf where that takes away the share ``gain`` of the constant's squared error; ``k`` keeps the most correlated columns of a leaf.

    The moments of all leaves come from one job.
    """
    tree = fit_tree(df, cols, label, max_depth, max_leaves, min_leaf)
    parts = gram(df.withColumn("__leaf", tree.leaf()), {c: F.col(c) for c in cols}, label, ["__leaf"])
    equations = {}
    for (leaf,), m in parts.items():
        fit = ridge(m, alpha, standardise=True, keep=top_by_correlation(m, k) if k else None)
        if m.rows > len(cols) + 1 and m.sse(fit.coef, fit.intercept) <= (1 - gain) * m.centered()[3]:
            model = linear_model(fit)
            equations[leaf] = TermModel([t for t in model.terms if t.coef], model.intercept)
    return ModelTree(tree, equations)


@dataclass
class RuleModel:
    """Linear terms and rules (1 where all conditions hold) with coefficients."""

    linear: TermModel
    rules: list[tuple[Rule, float]]
    support: list[float]

    def column(self) -> Column:
        out = self.linear.column()
        for r, c in self.rules:
            out = out + F.when(r.column(), float(c)).otherwise(0.0)
        return out

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.column())

    def table(self, most: int | None = 8) -> list[tuple[str, float, float, float]]:
        """(rule, coefficient, support, importance), the most important first; importance is |coef| sqrt(support (1 - support))."""
        out = [(r.text().rpartition(": ")[0], c, s, abs(c) * (s * (1 - s)) ** 0.5) for (r, c), s in zip(self.rules, self.support, strict=True)]
        return sorted(out, key=lambda x: (-x[3], x[0]))[:most]

    def card(self) -> str:
        return "\n".join([self.linear.card(), *(f"  {c:+.6g} if {rule} (share {s:.3g})" for rule, c, s, _ in self.table(None))])


def rule_lasso(df: DataFrame, cols: list[str], label: Column, fold: Column, trees: int = 20, depth: int = 3, most: int = 200) -> RuleModel:
    """Lasso over the columns and the rules on all paths of boosted trees, at most the ``most`` rules closest to the label (two rules that hold for the same rows are one)."""
    grown, _ = ensemble(df, cols, label, "gbt", trees, depth)
    rules = {tuple(sorted(r.conditions.items())): r for t in grown for r in _paths(t)}
    rules = [r for k, r in sorted(rules.items(), key=lambda x: repr(x[0])) if k]
    held = [F.when(r.column(), 1.0).otherwise(0.0) for r in rules]
    m = gram(df, {f"r{i}": c for i, c in enumerate(held)}, label)[()] if rules else None
    if rules:
        near = np.abs(corr_with(m))
        seen, keep = set(), []
        for i in np.argsort(-near, kind="stable").tolist():
            mark = (round(float(m.matrix[0, i + 1] + m.n * m.center[i])), round(float(near[i]), 12))
            if near[i] > 0 and mark not in seen and len(keep) < most:
                seen.add(mark)
                keep.append(i)
        rules, held = [rules[i] for i in keep], [held[i] for i in keep]
    named = {c: F.col(c) for c in cols} | {f"r{i}": c for i, c in enumerate(held)}
    folds = gram(df.withColumn("__part", fold.cast("int")), named, label, ["__part"])
    whole = sum(list(folds.values())[1:], start=next(iter(folds.values())))
    fit, _ = lasso_cv(folds)
    mean = whole.centered()[0]
    linear = TermModel([Term("linear", c, float(b)) for c, b in zip(cols, fit.coef, strict=False) if b], fit.intercept)
    on = [(r, float(b), float(s)) for r, b, s in zip(rules, fit.coef[len(cols) :], mean[len(cols) :], strict=True) if b]
    return RuleModel(linear, [(r, b) for r, b, _ in on], [s for *_, s in on])


def _paths(tree: Tree) -> list[Rule]:
    """The conditions of every node but the root."""
    out: list[Rule] = []

    def walk(at: int, bounds: dict) -> None:
        n = tree.nodes[at]
        if bounds:
            out.append(Rule(bounds, n.value, n.n))
        if n.feature is not None:
            low, high = bounds.get(n.feature, (None, None))
            walk(n.left, {**bounds, n.feature: (low, n.threshold)})
            walk(n.right, {**bounds, n.feature: (n.threshold, high)})

    walk(0, {})
    return out


def tree_guided_linear(df: DataFrame, cols: list[str], label: Column, fold: Column, max_depth: int = 4, max_leaves: int = 12, refit: str = "lasso") -> TermModel:
    """Lasso (or ridge) over the columns and steps at the bounds that a tree found."""
    tree = fit_tree(df, cols, label, max_depth, max_leaves)
    bounds = sorted({(n.feature, n.threshold) for i, n in tree.nodes.items() if i in tree._inner()})
    terms = [Term("linear", c, 1.0) for c in cols] + [Term("step", c, 1.0, knot=t) for c, t in bounds]
    folds = gram(df.withColumn("__part", fold.cast("int")), {f"t{i}": t.column() for i, t in enumerate(terms)}, label, ["__part"])
    whole = sum(list(folds.values())[1:], start=next(iter(folds.values())))
    fit = lasso_cv(folds)[0] if refit == "lasso" else ridge_gcv(whole, [0.01, 0.1, 1.0, 10.0, 100.0])[0]
    return TermModel([replace(t, coef=float(c)) for t, c in zip(terms, fit.coef, strict=True) if c], float(fit.intercept))


def folded_tree(df: DataFrame, cols: list[str], label: Column, max_depth: int = 4, max_leaves: int = 8) -> Tree:
    """A tree grown on what a linear model leaves, whose leaves then take the label's mean, so that it stands alone."""
    fit = ridge(gram(df, {c: F.col(c) for c in cols}, label)[()], 1e-6)
    return recalibrate(fit_tree(df, cols, label - linear_model(fit).column(), max_depth, max_leaves), df, label)


@dataclass
class AugmentedTree:
    """A tree that may also ask for a linear score of the row."""

    tree: Tree
    score: TermModel

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return self.tree.transform(df.withColumn("linear_score", self.score.column()), out).drop("linear_score")

    def card(self) -> str:
        return f"linear_score: {self.score.card()}\n{self.tree.card()}"


def augmented_tree(df: DataFrame, cols: list[str], label: Column, max_depth: int = 4, max_leaves: int = 8) -> AugmentedTree:
    fit = linear_model(ridge(gram(df, {c: F.col(c) for c in cols}, label)[()], 1e-6))
    return AugmentedTree(fit_tree(df.withColumn("linear_score", fit.column()), [*cols, "linear_score"], label, max_depth, max_leaves), fit)


def trunk_plus_stumps(df: DataFrame, cols: list[str], label: Column, k: int = 5, bins: int = 32, min_leaf: float = 5) -> TermModel:
    """A linear model and ``k`` steps, each the best split of what is left, found on one binned moment job of the residuals and fitted together with the lines in the end."""
    m = gram(df, {c: F.col(c) for c in cols}, label)
    if not m:
        return TermModel([], 0.0)
    trunk = linear_model(ridge(m[()], 1e-6))
    b = binned(df, cols, label - trunk.column(), edges_of(df, cols, bins))[0]
    counts, rest = np.diag(b.meet), b.labels - b.label_sum / b.n * np.diag(b.meet)
    steps: list[Term] = []
    for _ in range(k):
        found = []
        for name, edges, at in zip(b.names, b.edges, b.cells, strict=True):
            n, s = np.cumsum(counts[at])[:-1], np.cumsum(rest[at])[:-1]
            ok = (n >= min_leaf) & (b.n - n >= min_leaf)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(n, 1) + s**2 / np.maximum(b.n - n, 1), -1.0)  # the whole rest sums to 0
                j = int(gain.argmax())
                found.append((gain[j], name, edges[j], at, j, s[j] / n[j], -s[j] / (b.n - n[j])))
        if not found:
            break
        _, name, edge, at, j, left, right = max(found, key=lambda x: x[0])
        step = np.zeros(len(counts))
        step[at] = np.where(np.arange(at.stop - at.start) <= j, left, right)
        rest = rest - b.meet @ step
        if not any(t.a == name and t.knot == edge for t in steps):
            steps.append(Term("step", name, 1.0, knot=float(edge)))
    terms = [Term("linear", c, 1.0) for c in cols] + steps
    fit = ridge(gram(df, {f"t{i}": t.column() for i, t in enumerate(terms)}, label)[()], 1e-6)
    return TermModel([replace(t, coef=float(c)) for t, c in zip(terms, fit.coef, strict=True) if c], float(fit.intercept))


@dataclass
class Prototypes:
    """The mean label of the nearest of a few typical rows, by distance in units of each column's deviation."""

    cols: list[str]
    centers: np.ndarray
    values: list[float]
    scale: list[float]

    def column(self) -> Column:
        places = []
        for center, value in zip(self.centers, self.values, strict=True):
            far = sum((F.pow((F.col(c) - float(x)) / s, 2) for c, x, s in zip(self.cols, center, self.scale, strict=True)), F.lit(0.0))
            places.append(F.struct(far.alias("far"), F.lit(float(value)).alias("value")))
        known = F.lit(True)
        for c in self.cols:
            known = known & F.col(c).isNotNull()
        return F.when(known, F.array_min(F.array(*places))["value"])

    def transform(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.column())

    def card(self) -> str:
        return "\n".join("near " + ", ".join(f"{c} {x:.6g}" for c, x in zip(self.cols, center, strict=True)) + f": {v:.6g}" for center, v in zip(self.centers, self.values, strict=True))


def prototypes(df: DataFrame, cols: list[str], label: Column, k: int = 8, seed: int = 42) -> Prototypes:
    """Clusters of the standardised columns and the mean label of each."""
    data = df.select(*(F.col(c).cast("double").alias(c) for c in cols), label.cast("double").alias("__y")).na.drop()
    scale = [x or 1.0 for x in data.agg(*(F.stddev_pop(c) for c in cols)).first()]
    scaled = VectorAssembler(inputCols=[f"__s{i}" for i in range(len(cols))], outputCol="__features").transform(data.withColumns({f"__s{i}": F.col(c) / float(s) for i, (c, s) in enumerate(zip(cols, scale, strict=True))}))
    fit = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="__near").fit(scaled)
    centers = np.array(fit.clusterCenters()) * np.array(scale)
    means = {r["__near"]: r.m for r in fit.transform(scaled).groupBy("__near").agg(F.avg("__y").alias("m")).collect()}  # k rows
    keep = sorted(means)
    return Prototypes(cols, centers[keep], [means[i] for i in keep], [float(s) for s in scale])


def best_of_bagged(df: DataFrame, cols: list[str], label: Column, held_out: Column, trees: int = 20, depth: int = 3, teacher: Column | None = None) -> Tree:
    """The tree of a forest that comes closest, on the held-out rows, to the label or to a teacher's prediction; one pass scores all."""
    grown, _ = ensemble(df.filter(~held_out), cols, label, "rf", trees, depth)
    aim = label if teacher is None else teacher
    row = df.filter(held_out).agg(*(F.avg(F.pow(aim - t.column(), 2)).alias(f"e{i}") for i, t in enumerate(grown))).first()
    return grown[min(range(len(grown)), key=lambda i: (row[i] if row[i] is not None else 0.0, i))]


def shrink(tree: Tree, strength: float, deeper: float = 0.0) -> Tree:
    """Each node's step from its parent is divided by 1 + strength (1 + deeper depth) / the parent's rows."""
    out: dict[int, Node] = {}

    def walk(at: int, parent: Node | None, base: float, depth: int) -> None:
        n = tree.nodes[at]
        value = n.value if parent is None else base + (n.value - parent.value) / (1 + strength * (1 + deeper * (depth - 1)) / max(1, parent.n))
        out[at] = replace(n, value=value)
        if n.feature is not None:
            walk(n.left, n, value, depth + 1)
            walk(n.right, n, value, depth + 1)

    walk(0, None, 0.0, 0)
    return Tree(out)


def recalibrate(tree: Tree, df: DataFrame, label: Column) -> Tree:
    """Leaves take the mean label of their rows in ``df``; one without rows keeps its value."""
    means = {r.leaf: r.m for r in df.groupBy(tree.leaf().alias("leaf")).agg(F.avg(label).alias("m")).collect()}
    return Tree({i: replace(n, value=means[i]) if means.get(i) is not None else n for i, n in tree.nodes.items()})


def prune_ccp(tree: Tree, alpha: float) -> Tree:
    """Takes away the weakest branch while it lowers the mean squared error by ``alpha`` or less a leaf."""
    total = max(1, tree.nodes[0].n)
    cost = lambda i: tree.nodes[i].impurity * tree.nodes[i].n / total
    while inner := tree._inner():
        worth = {i: (cost(i) - sum(map(cost, tree.leaves(i)))) / (len(tree.leaves(i)) - 1) for i in inner}
        weakest = min(inner, key=lambda i: (worth[i], i))
        if worth[weakest] > alpha:
            break
        tree = tree._without(weakest)
    return tree
