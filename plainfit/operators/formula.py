"""Model formulas: ``y ~ a * C(b, Treatment('x')) + np.log1p(z) + I(a ** 2) - 1`` as Columns of a linear model.

Operators, from the tightest: ``**`` (all interactions up to a degree), ``:`` (interaction), ``*`` (both and their
interaction) and ``/`` (nesting), ``+`` and ``-``.  A one-column factor is a column name, ``Q('any name')``, a function
of columns or ``I(arithmetic)``; text and booleans are categories, and so is ``C(column)``, whose reference level and
contrast may be given.  ``center`` and ``standardize`` take their moments from the rows in one job.

A category gets as many columns as it takes to add what no term before it spans: indicators of all levels where
nothing holds their sum yet, else of all but the reference (or, for ``Sum``, the levels' distances from the last one).
Terms with the same numbers are taken together, those without numbers first, lower degrees first.  Levels are the values that aren't null, of
which at most ``MOST_LEVELS`` are collected; values outside the levels a design was made with make the row null, and
fits leave such rows out, as they do nulls anywhere in the formula.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import glm as M
from . import inference as H
from .inference import MOST_LEVELS

#: Formula operators outside of calls are written as Python operators that bind in the same order (fixed values).
BINDING = {"+": "<<", "-": ">>", "*": "+", "/": "-", ":": "*", "**": "**"}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "log": F.log, "log1p": F.log1p, "log2": F.log2, "log10": F.log10, "exp": F.exp, "expm1": F.expm1,
    "sqrt": F.sqrt, "square": lambda x: x * x, "sign": F.signum, "floor": F.floor, "ceil": F.ceil, "sin": F.sin,
    "cos": F.cos, "tanh": F.tanh, "power": F.pow, "minimum": F.least, "maximum": F.greatest,
}
ARITHMETIC = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b,
    ast.Mod: lambda a, b: a % b, ast.Pow: lambda a, b: F.pow(a, b), ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b,
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}

Factors = tuple[str, ...]


@dataclass(frozen=True)
class Design:
    """The label, the columns of a linear model without its intercept, whether it has one, and each term's columns."""

    label: Column
    label_name: str
    columns: dict[str, Column]
    intercept: bool
    terms: dict[str, list[str]]


@dataclass
class Category:
    """A factor's column, levels and contrast; ``reduced`` columns leave out the reference."""

    name: str
    column: Column
    levels: list
    reference: object
    contrast: str = "Treatment"

    def columns(self, full: bool) -> dict[str, Column]:
        known = self.column.isin(*self.levels)
        of = lambda v: F.when(known, (self.column == F.lit(v)).cast("double"))
        if full:
            return {f"{self.name}[{v}]": of(v) for v in self.levels}
        if self.contrast == "Sum":
            return {f"{self.name}[S.{v}]": of(v) - of(self.levels[-1]) for v in self.levels[:-1]}
        return {f"{self.name}[T.{v}]": of(v) for v in self.levels if v != self.reference}


def _rewritten(side: str) -> str:
    """A side of a formula with its own operators replaced by those of ``BINDING``, what is inside of calls left as it is."""
    out, calls, before = [], [], None
    for token in tokenize.generate_tokens(io.StringIO(side.strip()).readline):
        text = token.string
        if token.type in (tokenize.NEWLINE, tokenize.NL, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT):
            continue
        if text == "(":
            calls.append(before == "name" or any(calls))
        elif text == ")" and calls:
            calls.pop()
        out.append(BINDING.get(text, text) if not any(calls) else text)
        before = "name" if token.type == tokenize.NAME else text
    return " ".join(out)


def _joined(*some: Factors) -> Factors:
    return tuple(dict.fromkeys(f for x in some for f in x))


def _terms(node: ast.expr) -> list[Factors]:
    """The terms of a parsed side in order; () is the intercept, and a term's factors are their source text."""
    if isinstance(node, ast.BinOp):
        kind = type(node.op)
        if kind in (ast.LShift, ast.RShift):
            left, right = _terms(node.left), _terms(node.right)
            zero = isinstance(node.right, ast.Constant) and node.right.value == 0
            if zero:  # "+ 0" takes the intercept away, "- 0" puts it back
                right = [()]
            if (kind is ast.RShift) != zero:
                gone = set(map(frozenset, right))
                return [t for t in left if frozenset(t) not in gone]
            return _distinct([*left, *right])
        left = _terms(node.left)
        if kind is ast.Pow:
            if not (isinstance(node.right, ast.Constant) and isinstance(node.right.value, int) and node.right.value > 0):
                raise ValueError("a formula's power is a positive whole number")
            out = left
            for _ in range(node.right.value - 1):
                out = _distinct([*out, *(_joined(a, b) for a in out for b in left)])
            return out
        right = _terms(node.right)
        crossed = [_joined(a, b) for a in left for b in right]
        if kind is ast.Mult:
            return _distinct(crossed)
        if kind is ast.Add:
            return _distinct([*left, *right, *crossed])
        if kind is ast.Sub:
            return _distinct([*left, *(_joined(*left, b) for b in right)])
    if isinstance(node, ast.Constant) and node.value in (0, 1):
        return [()] if node.value == 1 else []
    if isinstance(node, (ast.Name, ast.Call)):
        return [(ast.unparse(node),)]
    raise ValueError(f"not part of a formula: {ast.unparse(node)}")


def _distinct(terms: list[Factors]) -> list[Factors]:
    found: dict[frozenset, Factors] = {}
    for t in terms:
        found.setdefault(frozenset(t), t)
    return list(found.values())


@dataclass
class _Reader:
    """Turns factors' source text into Columns and categories of ``df``."""

    df: DataFrame
    moments: dict[str, Column] = field(default_factory=dict)

    def name(self, node: ast.expr) -> str:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "Q":
            return ast.literal_eval(node.args[0])
        if isinstance(node, ast.Name):
            return node.id
        raise ValueError(f"a column is expected: {ast.unparse(node)}")

    def number(self, node: ast.expr) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return F.col(f"`{node.id}`")
        if isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
            return ARITHMETIC[type(node.op)](self.number(node.left), self.number(node.right))
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            return ARITHMETIC[type(node.ops[0])](self.number(node.left), self.number(node.comparators[0]))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.number(node.operand)
        if isinstance(node, ast.Call):
            called = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id
            if called == "Q":
                return F.col(f"`{self.name(node)}`")
            inner = [self.number(a) for a in node.args]
            if called == "I":
                return inner[0]
            if called in ("center", "standardize", "scale"):
                x, key = inner[0].cast("double"), ast.unparse(node.args[0])
                mean, spread = self.moment(f"mean {key}", F.avg(x)), self.moment(f"spread {key}", F.stddev_pop(x)) if called != "center" else 1.0
                return (x - mean) / spread
            if called in FUNCTIONS:
                return FUNCTIONS[called](*inner)
        raise ValueError(f"not known in formulas: {ast.unparse(node)}")

    def moment(self, key: str, aggregate: Column) -> float:
        if key not in self.moments:
            self.moments[key] = self.df.agg(aggregate).first()[0]
        return F.lit(float(self.moments[key] or 0.0))

    def factor(self, text: str) -> Column | Category:
        node = ast.parse(text, mode="eval").body
        called = node.func.id if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) else None
        if called == "C":
            return self.category(text, node.args[0], node.args[1:])
        if isinstance(node, ast.Name) or called == "Q":
            kind = self.df.schema[self.name(node)].dataType
            if isinstance(kind, (T.StringType, T.BooleanType)):
                return self.category(text, node, [])
        return self.number(node).cast("double")

    def category(self, text: str, node: ast.expr, how: list[ast.expr]) -> Category:
        column, contrast, reference = self.number(node), "Treatment", None
        for h in how:
            contrast = h.func.id if isinstance(h, ast.Call) else h.id
            if contrast not in ("Treatment", "Sum"):
                raise ValueError(f"Treatment or Sum is expected: {contrast}")
            for given in [*h.args, *(k.value for k in h.keywords)] if isinstance(h, ast.Call) else []:
                reference = ast.literal_eval(given)
        found = self.df.select(column.alias("v")).filter("v is not null").distinct().limit(MOST_LEVELS + 1).collect()
        levels = sorted(r.v for r in found)
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"{text} has more than {MOST_LEVELS} levels")
        if reference is not None and reference not in levels:
            raise ValueError(f"{reference!r} is no level of {text}")
        return Category(text, column, levels, levels[0] if reference is None and levels else reference, contrast)


def _codings(categories: Factors, used: set[frozenset]) -> list[dict[str, bool]]:
    """How a term's categories are coded, {factor: all its levels}, for one or more groups of columns.

    A term spans the products of the categories of each of its subsets.  Those that no term before it spans are left; a
    subset and the same with one more category are together that category with all its levels.
    """
    parts = [frozenset(c) for k in range(len(categories) + 1) for c in combinations(categories, k)]
    left = [p for p in parts if p not in used]
    used.update(parts)
    coded = [dict.fromkeys((c for c in categories if c in p), False) for p in left]
    merged = True
    while merged:
        merged = False
        for small in coded:
            for big in coded:
                more = [c for c in big if c not in small]  # small is the rest of big, coded as there
                if len(more) == 1 and not big[more[0]] and all(big.get(c) is small[c] for c in small):
                    big[more[0]], merged = True, True
                    coded.remove(small)
                    break
            if merged:
                break
    return coded


def design(df: DataFrame, formula: str) -> Design:
    """The columns that a formula stands for over ``df``."""
    left, tilde, right = formula.partition("~")
    if not tilde or not left.strip() or not right.strip():
        raise ValueError("a formula has a label, a tilde and terms")
    right = f"1 {right}" if right.strip().startswith("-") else f"1 + {right}"
    reader = _Reader(df)
    label = reader.number(ast.parse(left.strip(), mode="eval").body)
    terms = _terms(ast.parse(_rewritten(right), mode="eval").body)
    factors = {f: reader.factor(f) for t in terms for f in t}
    is_category = {f: isinstance(x, Category) for f, x in factors.items()}
    groups: dict[frozenset, list[Factors]] = {frozenset(): []}
    for t in terms:
        groups.setdefault(frozenset(f for f in t if not is_category[f]), []).append(t)
    columns, by_term = {}, {}
    for numbers, group in groups.items():
        used: set[frozenset] = set()
        for t in sorted(group, key=len):
            own = {}
            for coding in _codings(tuple(f for f in t if is_category[f]), used):
                made: dict[str, Column] = {"": F.lit(1.0)}
                for f in t:
                    if f in numbers:
                        more = {f: factors[f]}
                    elif f in coding:
                        more = factors[f].columns(coding[f])
                    else:
                        continue
                    made = {f"{a}:{b}" if a else b: x * y if a else y for a, x in made.items() for b, y in more.items()}
                own |= made
            if t:
                columns |= own
                by_term[":".join(t)] = list(own)
    return Design(label.cast("double"), left.strip(), columns, () in terms, by_term)


def ols(df: DataFrame, formula: str, cov: str = "plain", cluster: str | None = None, weight: Column | None = None) -> tuple[list[tuple], float, float]:
    """Rows (name, coef, se, t, p, low, high), R^2 and F of the least squares that a formula asks for."""
    d = design(df, formula)
    return H.ols_inference(df, d.label, d.columns, cov, cluster, weight, d.intercept)


def anova(df: DataFrame, formula: str) -> list[tuple[str, int, float, float, float]]:
    """The type II table of a formula with an intercept, from one moment job."""
    d = design(df, formula)
    if not d.intercept:
        raise ValueError("a type II table needs an intercept")
    return H.anova_lm(H.gram(df, d.columns, d.label)[()], d.terms)


def glm(df: DataFrame, formula: str, family: str = "binomial", offset: Column | None = None, weight: Column | None = None) -> list[M.Effect]:
    """Logistic or Poisson effects of a formula with an intercept."""
    d = design(df, formula)
    if not d.intercept:
        raise ValueError("these models have an intercept")
    return M.glm(df, d.label, d.columns, family, offset, weight)
