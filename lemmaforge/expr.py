"""Numeric expressions over a table's columns.

An expression is an immutable tree.  ``column()`` gives the Spark Column that
Catalyst optimises; ``label()`` the text that identifies it.  Identities are
folded when a tree is built, because labels, not values, are what duplicate
statements are told by.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction
from numbers import Number

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import numeric as nf


class Expr:
    def column(self) -> Column:
        raise NotImplementedError

    def label(self, unicode: bool = False) -> str:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def columns(self) -> set[str]:
        return set()

    # arithmetic with folding
    def __add__(self, o):
        o = expr(o)
        if isinstance(o, Const) and o.value == 0:
            return self
        if isinstance(self, Const) and self.value == 0:
            return o
        return Bin.ordered("+", self, o)

    def __radd__(self, o):
        return expr(o) + self

    def __sub__(self, o):
        o = expr(o)
        if isinstance(o, Const) and o.value == 0:
            return self
        if self == o:
            return Const(0)
        return Bin("-", self, o)

    def __rsub__(self, o):
        return expr(o) - self

    def __mul__(self, o):
        o = expr(o)
        for a, b in ((self, o), (o, self)):
            if isinstance(a, Const) and a.value == 1:
                return b
            if isinstance(a, Const) and a.value == 0:
                return Const(0)
        return Bin.ordered("*", self, o)

    def __rmul__(self, o):
        return expr(o) * self

    def __truediv__(self, o):
        o = expr(o)
        if isinstance(o, Const) and o.value == 1:
            return self
        if self == o:
            return Const(1)
        return Bin("/", self, o)

    def __rtruediv__(self, o):
        return expr(o) / self

    def __mod__(self, o):
        return Bin("%", self, expr(o))

    def __rmod__(self, o):
        return Bin("%", expr(o), self)

    def __pow__(self, o):
        o = expr(o)
        if isinstance(o, Const) and o.value == 1:
            return self
        if isinstance(o, Const) and o.value == 0:
            return Const(1)
        return Bin("**", self, o)

    def __rpow__(self, o):
        return expr(o) ** self

    def __neg__(self):
        return Un("neg", self)

    def __abs__(self):
        return Un("abs", self)

    # comparisons build statements; equality of trees is structural
    def le(self, o):
        from .pred import Compare

        return Compare("<=", self, expr(o))

    def ge(self, o):
        from .pred import Compare

        return Compare(">=", self, expr(o))

    def lt(self, o):
        from .pred import Compare

        return Compare("<", self, expr(o))

    def gt(self, o):
        from .pred import Compare

        return Compare(">", self, expr(o))

    def eq(self, o):
        from .pred import Compare

        return Compare("==", self, expr(o))

    def ne(self, o):
        from .pred import Compare

        return Compare("!=", self, expr(o))

    __le__, __ge__, __lt__, __gt__ = le, ge, lt, gt

    def pretty(self) -> str:
        """Unicode text with no more parentheses than needed."""
        from .export.unicode import pretty

        return pretty(self)

    def __str__(self):
        return self.label()


def fraction_text(value, most: int = 50) -> str:
    """A constant as a whole number or fraction; ``≈`` marks one that is not exactly that fraction."""
    if isinstance(value, Fraction):
        exact = value
    else:
        if not math.isfinite(value):
            return str(value)
        exact = Fraction(value).limit_denominator(most)
        if abs(float(exact) - value) > 1e-12 * max(1.0, abs(value)):
            return f"≈{value:.6g}"
    return str(exact.numerator) if exact.denominator == 1 else f"{exact.numerator}/{exact.denominator}"


@dataclass(frozen=True, eq=True)
class Const(Expr):
    value: Fraction | float | int

    def column(self):
        return F.lit(float(self.value))

    def label(self, unicode=False):
        return fraction_text(self.value)

    def sql(self):
        return f"CAST({float(self.value)!r} AS DOUBLE)"


_DIFFERENCE = re.compile(r"^abs_(.+)_minus_(.+)$|^\|\(?(.+?) - (.+?)\)?\|$")
_EXTREME = re.compile(r"^(min|max)\((.+), (.+)\)$")


@dataclass(frozen=True, eq=True)
class Col(Expr):
    """A column; with ``known`` (the table's columns) also the virtual names |x - y|, abs_x_minus_y, min(x, y), max(x, y)."""

    name: str

    def column(self):
        return nf.number(F.col(quoted(self.name)))

    def label(self, unicode=False):
        return self.name

    def sql(self):
        return f"TRY_CAST({quoted(self.name)} AS DOUBLE)"

    def columns(self):
        return {self.name}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(name: str, known: Iterable[str]) -> Expr:
    """The column ``name``, or the virtual one; KeyError if there is neither."""
    known = set(known)
    if name in known:
        return Col(name)
    if m := _DIFFERENCE.match(name):
        a, b = (m[1], m[2]) if m[1] else (m[3], m[4])
        if {a, b} <= known:
            return abs(Col(a) - Col(b))
    if (m := _EXTREME.match(name)) and {m[2], m[3]} <= known:
        return extreme(m[1], Col(m[2]), Col(m[3]))
    raise KeyError(name)


def expr(x) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, bool):
        return Const(int(x))
    if isinstance(x, (Number, Fraction)):
        return Const(x)
    if isinstance(x, str):
        return Col(x)
    raise TypeError(f"not an expression: {x!r}")


@dataclass(frozen=True, eq=True)
class Bin(Expr):
    op: str
    a: Expr
    b: Expr

    @classmethod
    def ordered(cls, op, a, b):
        """Operands of a commutative operator, in order of their labels."""
        if isinstance(a, Const) and isinstance(b, Const):
            return Const(a.value + b.value if op == "+" else a.value * b.value)
        return cls(op, *sorted((a, b), key=lambda e: e.label()))

    def column(self):
        a, b = self.a.column(), self.b.column()
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: nf.divide(a, b), "%": lambda: nf.floored_mod(a, b), "**": lambda: F.pow(a, b)}[self.op]()

    def sql(self):
        a, b = self.a.sql(), self.b.sql()
        if self.op == "/":
            return f"try_divide({a}, {b})"
        if self.op == "**":
            return f"power({a}, {b})"
        if self.op == "%":
            return f"({a} - floor(try_divide({a}, {b})) * {b})"
        return f"({a} {self.op} {b})"

    def label(self, unicode=False):
        a, b = self.a.label(unicode), self.b.label(unicode)
        if unicode:
            if self.op == "**" and isinstance(self.b, Const) and self.b.value in (2, 3):
                return f"{a if isinstance(self.a, (Col, Const)) else f'({a})'}{'²' if self.b.value == 2 else '³'}"
            if self.op == "*":
                return "·".join(f"({x.label(True)})" if isinstance(x, Bin) and x.op in "+-" else x.label(True) for x in (self.a, self.b))
            if self.op in "+-":
                return f"{a} {self.op} {f'({b})' if self.op == '-' and isinstance(self.b, Bin) and self.b.op in '+-' else b}"
        return f"({a} {self.op} {b})"

    def columns(self):
        return self.a.columns() | self.b.columns()


@dataclass(frozen=True, eq=True)
class Un(Expr):
    """floor, ceil, abs, exp, neg, sqrt, square."""

    op: str
    a: Expr

    def column(self):
        a = self.a.column()
        return {"floor": lambda: nf.rounded(a, False), "ceil": lambda: nf.rounded(a, True), "abs": lambda: F.abs(a), "exp": lambda: F.exp(a), "neg": lambda: -a, "sqrt": lambda: nf.root(a), "square": lambda: a * a}[self.op]()

    def sql(self):
        a = self.a.sql()
        return {"neg": f"(-{a})", "sqrt": f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)", "square": f"({a} * {a})"}.get(self.op, f"CAST({self.op}({a}) AS DOUBLE)")

    def label(self, unicode=False):
        a = self.a.label(unicode)
        if unicode:
            return {"floor": f"⌊{a}⌋", "ceil": f"⌈{a}⌉", "abs": f"|{a}|", "exp": f"e^({a})", "neg": f"-{a}", "sqrt": f"√{a}" if isinstance(self.a, Col) else f"√({a})", "square": f"{a}²" if isinstance(self.a, Col) else f"({a})²"}[self.op]
        return {"neg": f"(-{a})", "square": f"({a} ** 2)"}.get(self.op, f"{self.op}({a})")

    def columns(self):
        return self.a.columns()


@dataclass(frozen=True, eq=True)
class Log(Expr):
    a: Expr
    base: float | None = None
    least: float = 0.0

    def column(self):
        return nf.logarithm(self.a.column(), self.base, self.least)

    def sql(self):
        a = f"greatest({self.a.sql()}, {self.least!r}D)" if self.least > 0 else self.a.sql()
        one = f"(CASE WHEN {a} > 0 THEN ln({a}) END)"
        return one if self.base is None else f"({one} / ln({float(self.base)!r}D))"

    def label(self, unicode=False):
        name = {None: "ln", 2: "log₂" if unicode else "log2", 10: "log₁₀" if unicode else "log10"}.get(self.base, f"log_{self.base}")
        return f"{name}({self.a.label(unicode)})"

    def columns(self):
        return self.a.columns()


@dataclass(frozen=True, eq=True)
class Extreme(Expr):
    """Pointwise min or max; missing if either side is."""

    op: str
    a: Expr
    b: Expr

    def column(self):
        a, b = self.a.column(), self.b.column()
        return F.when(nf.finite(a) & nf.finite(b), (F.least if self.op == "min" else F.greatest)(a, b))

    def sql(self):
        a, b = self.a.sql(), self.b.sql()
        return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {'least' if self.op == 'min' else 'greatest'}({a}, {b}) END)"

    def label(self, unicode=False):
        return f"{self.op}({self.a.label(unicode)}, {self.b.label(unicode)})"

    def columns(self):
        return self.a.columns() | self.b.columns()


@dataclass(frozen=True, eq=True)
class SqlExpr(Expr):
    """A number written as SQL, as it is read back from a catalog: its text, how it is named, and the columns that it refers to."""

    text: str
    name: str
    of: frozenset[str] = frozenset()

    def column(self):
        return nf.number(F.expr(self.text))

    def label(self, unicode=False):
        return self.name

    def sql(self):
        return self.text

    def columns(self):
        return set(self.of)


def extreme(op: str, a, b) -> Expr:
    a, b = sorted((expr(a), expr(b)), key=lambda e: e.label())
    if a == b:
        return a
    if isinstance(a, Const) and isinstance(b, Const):
        return Const((min if op == "min" else max)(a.value, b.value))
    return Extreme(op, a, b)


def floor(x):
    return Un("floor", expr(x))


def ceil(x):
    return Un("ceil", expr(x))


def sqrt(x):
    return Un("sqrt", expr(x))


def exp(x):
    return Un("exp", expr(x))


def log(x, base=None, least=0.0):
    return Log(expr(x), base, least)


def min_(a, b):
    return extreme("min", a, b)


def max_(a, b):
    return extreme("max", a, b)


@dataclass(frozen=True, eq=True)
class Linear(Expr):
    """intercept + sum of coefficient * term.  ``lenient`` counts a missing term as 0."""

    intercept: Fraction | float
    terms: tuple[tuple[Fraction | float, Expr], ...]
    lenient: bool = False

    def column(self):
        out = F.lit(float(self.intercept))
        for c, t in self.terms:
            x = F.lit(float(c)) * t.column()
            out = out + (F.coalesce(nf.only_finite(x), F.lit(0.0)) if self.lenient else x)
        return out

    def sql(self):
        parts = [f"{float(c)!r}D * {t.sql()}" for c, t in self.terms]
        return "(" + " + ".join([f"{float(self.intercept)!r}D", *([f"coalesce({p}, 0D)" for p in parts] if self.lenient else parts)]) + ")"

    def label(self, unicode=False):
        out = ""
        for c, t in self.terms:
            size = fraction_text(abs(c))
            text = t.label(unicode)
            body = text if size == "1" else f"{size}·{text}"
            out += (("-" if c < 0 else "") + body) if not out else f" {'-' if c < 0 else '+'} {body}"
        if self.intercept != 0 or not out:
            size = fraction_text(abs(self.intercept))
            out += (("-" if self.intercept < 0 else "") + size) if not out else f" {'-' if self.intercept < 0 else '+'} {size}"
        return out

    def columns(self):
        return set().union(*(t.columns() for _, t in self.terms)) if self.terms else set()


def affine(coefs: Iterable[tuple[float, Expr]], intercept: float, den: int, most_coef: float, most_intercept: float, drop: float = 1e-8, exact: bool = False) -> Linear | None:
    """A fitted form with rational coefficients, or None if it is not nice.

    Small coefficients go; equal terms are merged; a coefficient or intercept
    beyond its limit, or a coefficient whose denominator is the largest
    allowed, rejects the form.  Terms stand in order of their labels.
    """
    merged: dict[str, tuple[float, Expr]] = {}
    for c, t in coefs:
        merged[t.label()] = (merged.get(t.label(), (0.0, t))[0] + c, t)
    terms = []
    for label in sorted(merged):
        c, t = merged[label]
        if abs(c) < drop:
            continue
        q = Fraction(c).limit_denominator(den)
        if abs(c) > most_coef or (not exact and q.denominator == den):
            return None
        if q:
            terms.append((q, t))
    q = Fraction(intercept).limit_denominator(den)
    if abs(intercept) > most_intercept or not math.isfinite(intercept):
        return None
    return Linear(q, tuple(terms))
