"""Columns that are constant under a hypothesis, as statements, and how far these equalities characterise its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import Const, Expr
from ..pred import Compare
from ..relation import All, Equivalence, Inclusion, Statement
from .bounds import constant_columns
from .lattice import Hypothesis, Lattice


def constant_equalities(df: DataFrame, lattice: Lattice, hyps: Sequence[Hypothesis], columns: Mapping[str, Expr], tol: float = 0.0) -> list[tuple[Hypothesis, Statement]]:
    """hypothesis ⇒ all equalities column = value that hold under it, one statement for each hypothesis that has some."""
    found: dict[str, list[tuple[str, float]]] = {}
    for r in constant_columns(df, lattice, hyps, columns, tol).collect():
        found.setdefault(r["hypothesis"], []).append((r["feature"], r["value"]))
    order = {n: i for i, n in enumerate(columns)}
    out = []
    for h in hyps:
        parts = sorted(found.get(h.label(), []), key=lambda x: order[x[0]])
        if parts:
            out.append((h, Statement(h.pred, All(tuple(Compare("==", columns[n], Const(int(v) if v == int(v) else v), tol) for n, v in parts)), stage="constant_equality")))
    return out


@dataclass(frozen=True)
class Characterisation:
    """Rows where the equalities hold, against the rows of the hypothesis."""

    statement: Statement
    only_equalities: int
    only_class: int

    @property
    def kind(self) -> str:
        """≡, ⊂ (equalities inside the class), ⊃ (class inside the equalities) or ≠."""
        return ("≠", "⊂", "⊃", "≡")[(self.only_equalities == 0) + 2 * (self.only_class == 0)]

    def relations(self) -> list[Equivalence | Inclusion]:
        """The class relations that hold."""
        a, b = self.statement.conclusion, self.statement.hypothesis
        return {"≡": [Equivalence(a, b)], "⊂": [Inclusion(a, b)], "⊃": [Inclusion(b, a)], "≠": []}[self.kind]

    def label(self) -> str:
        return f"{self.statement.conclusion.label()} {self.kind} {self.statement.hypothesis.label()}"


def characterise(df: DataFrame, lattice: Lattice, hyps: Sequence[Hypothesis], columns: Mapping[str, Expr], tol: float = 0.0) -> list[Characterisation]:
    """For each hypothesis with constant columns: rows in which only the equalities, or only the hypothesis, hold.  One pass for all."""
    made = [s for _, s in constant_equalities(df, lattice, hyps, columns, tol)]
    if not made:
        return []
    row = df.agg(*[c for i, s in enumerate(made) for c in (F.count_if(s.conclusion.column() & ~s.hypothesis.column()).alias(f"a{i}"), F.count_if(s.violated()).alias(f"b{i}"))]).first()
    return [Characterisation(s, row[f"a{i}"], row[f"b{i}"]) for i, s in enumerate(made)]
