"""Boolean expressions: rows where something holds.  Missing values never hold, under Not as well as elsewhere."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Const, Expr, expr, quoted
from .functions import numeric as nf

COMPLEMENT = {"<=": ">", ">": "<=", ">=": "<", "<": ">=", "==": "!=", "!=": "=="}


class Pred:
    def column(self) -> Column:
        raise NotImplementedError

    def label(self) -> str:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def __and__(self, o):
        return conj([self, o])

    def __or__(self, o):
        return disj([self, o])

    def __xor__(self, o):
        if self == o:
            return FALSE
        if self == ~o:
            return TRUE
        for a, b in ((self, o), (o, self)):
            if b is FALSE or b == FALSE:
                return a
            if b == TRUE:
                return ~a
        return Xor(self, o)

    def __invert__(self):
        return Not(self)

    def implies(self, o):
        return ~self | o

    __rshift__ = implies

    def __str__(self):
        return self.label()


@dataclass(frozen=True)
class Fixed(Pred):
    value: bool

    def column(self):
        return F.lit(self.value)

    def label(self):
        return "TRUE" if self.value else "FALSE"

    sql = label

    def __invert__(self):
        return FALSE if self.value else TRUE


TRUE, FALSE = Fixed(True), Fixed(False)


@dataclass(frozen=True)
class Flag(Pred):
    """A column's truth: booleans as they are, numbers if not 0."""

    name: str
    kind: str = "boolean"

    def column(self):
        return nf.truthy(F.col(quoted(self.name)), self.kind)

    def label(self):
        return self.name

    def sql(self):
        return f"coalesce({quoted(self.name)}{'' if self.kind == 'boolean' else ' <> 0'}, FALSE)"


@dataclass(frozen=True)
class Not(Pred):
    a: Pred

    def column(self):
        return ~self.a.column()

    def label(self):
        return f"¬({self.a.label()})"

    def sql(self):
        return f"(NOT {self.a.sql()})"

    def __invert__(self):
        return self.a


class _Many(Pred):
    parts: tuple[Pred, ...]
    sign = word = ""

    def label(self):
        return "(" + f" {self.sign} ".join(p.label() for p in self.parts) + ")"

    def sql(self):
        return "(" + f" {self.word} ".join(p.sql() for p in self.parts) + ")"


@dataclass(frozen=True)
class And(_Many):
    parts: tuple[Pred, ...]
    sign, word = "∧", "AND"

    def column(self):
        out = self.parts[0].column()
        for p in self.parts[1:]:
            out = out & p.column()
        return out


@dataclass(frozen=True)
class Or(_Many):
    parts: tuple[Pred, ...]
    sign, word = "∨", "OR"

    def column(self):
        out = self.parts[0].column()
        for p in self.parts[1:]:
            out = out | p.column()
        return out


@dataclass(frozen=True)
class Xor(Pred):
    a: Pred
    b: Pred

    def column(self):
        return self.a.column() != self.b.column()

    def label(self):
        return f"({self.a.label()} ⊕ {self.b.label()})"

    def sql(self):
        return f"({self.a.sql()} <> {self.b.sql()})"


def _joined(items, kind, other, unit, zero):
    """Flatten, drop units and repeats, and apply annihilation, complement and absorption."""
    flat: list[Pred] = []
    for x in items:
        for y in x.parts if isinstance(x, kind) else (x,):
            if y == zero:
                return zero
            if y != unit and y not in flat:
                flat.append(y)
    if any(~x in flat for x in flat):
        return zero
    flat = [x for x in flat if not (isinstance(x, other) and any(y in x.parts for y in flat))]
    if not flat:
        return unit
    return flat[0] if len(flat) == 1 else kind(tuple(sorted(flat, key=lambda p: p.label())))


def conj(items) -> Pred:
    return _joined(items, And, Or, TRUE, FALSE)


def disj(items) -> Pred:
    return _joined(items, Or, And, FALSE, TRUE)


@dataclass(frozen=True)
class Compare(Pred):
    """A comparison; false where either side is missing.  ``tol`` loosens == and tightens < and >."""

    op: str
    a: Expr
    b: Expr
    tol: float = 0.0
    rtol: float = 0.0

    def column(self):
        a, b = self.a.column(), self.b.column()
        test = {
            "<=": lambda: a <= b,
            ">=": lambda: a >= b,
            "<": lambda: a < b - self.tol if self.tol else a < b,
            ">": lambda: a > b + self.tol if self.tol else a > b,
            "==": lambda: F.abs(a - b) <= self.tol + self.rtol * F.abs(b) if self.tol or self.rtol else a == b,
            "!=": lambda: F.abs(a - b) > self.tol if self.tol else a != b,
        }[self.op]()
        return F.coalesce(nf.finite(a) & nf.finite(b) & test, F.lit(False))

    def label(self):
        return f"{self.a.label()} {self.op} {self.b.label()}"

    def sql(self):
        a, b = self.a.sql(), self.b.sql()
        test = f"abs({a} - {b}) <= {self.tol!r}D" if self.op == "==" and self.tol else f"{a} {'=' if self.op == '==' else '<>' if self.op == '!=' else self.op} {b}"
        return f"coalesce({test}, FALSE)"

    def __invert__(self):
        return Compare(COMPLEMENT[self.op], self.a, self.b, self.tol, self.rtol)

    def slack(self) -> Column:
        """At least 0 where the comparison holds; null for !=."""
        a, b = self.a.column(), self.b.column()
        return {"<=": lambda: b - a, "<": lambda: b - self.tol - a, ">=": lambda: a - b, ">": lambda: a - self.tol - b, "==": lambda: F.lit(self.tol) - F.abs(a - b)}.get(self.op, lambda: F.lit(None).cast("double"))()

    def applicable(self) -> Column:
        return nf.finite(self.a.column()) & nf.finite(self.b.column())


@dataclass(frozen=True)
class SqlPred(Pred):
    """A truth value written as SQL, as it is read back from a catalog; missing is false."""

    text: str
    name: str

    def column(self):
        return nf.true(F.expr(self.text))

    def label(self):
        return self.name

    def sql(self):
        return self.text


@dataclass(frozen=True)
class In(Pred):
    a: str
    values: tuple[Any, ...]

    def column(self):
        return nf.true(F.col(quoted(self.a)).isin(list(self.values)))

    def label(self):
        return f"{self.a} ∈ {{{', '.join(map(str, self.values))}}}"

    def sql(self):
        return f"coalesce({quoted(self.a)} IN ({', '.join(repr(v) for v in self.values)}), FALSE)"


@dataclass(frozen=True)
class Between(Pred):
    a: Expr
    low: Expr
    high: Expr
    closed: tuple[bool, bool] = (True, True)

    def parts(self):
        return Compare(">=" if self.closed[0] else ">", self.a, self.low), Compare("<=" if self.closed[1] else "<", self.a, self.high)

    def column(self):
        x, y = self.parts()
        return x.column() & y.column()

    def label(self):
        return f"{self.a.label()} ∈ {'[' if self.closed[0] else '('}{self.low.label()}, {self.high.label()}{']' if self.closed[1] else ')'}"

    def sql(self):
        x, y = self.parts()
        return f"({x.sql()} AND {y.sql()})"


@dataclass(frozen=True)
class Check(Pred):
    """is_integer, is_nan (missing), is_finite of an expression."""

    kind: str
    a: Expr
    tol: float = 1e-9
    both_sides: bool = False

    def column(self):
        x = self.a.column()
        if self.kind == "is_finite":
            return nf.finite(x)
        if self.kind == "is_nan":
            return x.isNull() | F.isnan(x)
        off = x - nf.rounded(x, False)
        near = (off <= self.tol) | (off >= 1 - self.tol) if self.both_sides else off <= self.tol
        return nf.finite(x) & F.coalesce(near, F.lit(False))

    def label(self):
        return f"{self.kind}({self.a.label()})"

    def sql(self):
        x = self.a.sql()
        if self.kind == "is_finite":
            return f"coalesce(NOT isnan({x}) AND abs({x}) < double('inf'), FALSE)"
        if self.kind == "is_nan":
            return f"({x} IS NULL OR isnan({x}))"
        return f"coalesce({x} - floor({x}) <= {self.tol!r}D, FALSE)"


@dataclass(frozen=True)
class Where(Pred):
    """A mask of the user's: a Column, or a function of a struct of all columns, by pandas batches or by rows."""

    name: str
    make: Callable[[], Column]

    def column(self):
        return nf.true(self.make())

    def label(self):
        return self.name

    def sql(self):
        raise ValueError("a user mask has no SQL text")


def row_where(name: str, fn: Callable[[Any], bool], columns: list[str]) -> Where:
    """Row by row: the slow way, for masks that nothing else can say."""
    return Where(name, lambda: F.udf(lambda row: bool(fn(row)), "boolean")(F.struct(*[F.col(quoted(c)) for c in columns])))


def batch_where(name: str, fn: Callable[[Any], Any], columns: list[str]) -> Where:
    """By pandas batches: ``fn`` takes a frame of the columns and gives a boolean series."""
    import pandas as pd

    def run(frame):
        return pd.Series(fn(frame)).astype(bool)

    run.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}  # as types: Spark reads the kind of function from them
    return Where(name, lambda: F.pandas_udf(run, "boolean")(F.struct(*[F.col(quoted(c)) for c in columns])))


def is_int(x, tol=1e-9, both_sides=False):
    return Check("is_integer", expr(x), tol, both_sides)


def is_nan(x):
    return Check("is_nan", expr(x))


def is_finite(x):
    return Check("is_finite", expr(x))


@dataclass(frozen=True)
class AllFinite(Check):
    """Row by row as ``is_finite``; the label says it of all rows."""

    kind: str = field(default="is_finite", init=False)
    a: Expr = Const(0)

    def label(self):
        return f"∀ rows: {self.a.label()} is finite"

    def __invert__(self):
        return SomeDivergent(a=self.a)


@dataclass(frozen=True)
class SomeDivergent(Pred):
    """Row by row the negation of ``is_finite``; the label says it of some row."""

    a: Expr

    def column(self):
        return ~nf.finite(self.a.column())

    def label(self):
        return f"∃ row: {self.a.label()} is not finite"

    def sql(self):
        return f"NOT {Check('is_finite', self.a).sql()}"

    def __invert__(self):
        return AllFinite(a=self.a)


def all_finite(x):
    return AllFinite(a=expr(x))


def some_divergent(x):
    return SomeDivergent(expr(x))


def between(x, low, high, closed=(True, True)):
    return Between(expr(x), expr(low), expr(high), closed)


def one_of(name, values):
    return In(name, tuple(values))


def gt0(x):
    return Compare(">", expr(x), Const(0))


def eq0(x, tol=0.0):
    return Compare("==", expr(x), Const(0), tol)
