"""Statements as SQL text, Lean 4 text and reports."""

from __future__ import annotations

import logging
import math
import re
import sys
from collections.abc import Mapping, Sequence
from fractions import Fraction

from ..expr import Bin, Col, Const, Expr, Extreme, Linear, Log, Un
from ..pred import And, Check, Compare, Fixed, Flag, Not, Or, Pred
from ..relation import Statement


def logger(name: str = "lemmaforge") -> logging.Logger:
    """A logger to standard output, set up once."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def select_sql(s: Statement, table: str, violations: bool = True) -> str:
    """Rows of the hypothesis where the conclusion fails (or holds), as Spark SQL."""
    c = s.conclusion.sql()
    return f"SELECT * FROM {table} WHERE {s.hypothesis.sql()} AND {f'NOT {c}' if violations else c}"


def slack_sql(s: Statement, table: str) -> str:
    """Mean, least and largest slack under the hypothesis; for bounds only."""
    c = s.conclusion
    if not isinstance(c, Compare) or c.op not in ("<=", ">=", "=="):
        raise ValueError("slack is defined for <=, >= and == only")
    a, b = c.a.sql(), c.b.sql()
    x = {"<=": f"{b} - {a}", ">=": f"{a} - {b}", "==": f"-abs({a} - {b})"}[c.op]
    return f"SELECT avg({x}) AS avg_slack, min({x}) AS min_slack, max({x}) AS max_slack FROM {table} WHERE {s.hypothesis.sql()}"


_ORDER = ["ℕ", "ℤ", "ℚ", "ℝ"]


def variable_map(columns: Sequence[str], subject: str = "G") -> dict[str, str]:
    return {c: f"{c} {subject}" for c in columns}


def _lean(e: Expr, names: Mapping[str, str]) -> str:
    if isinstance(e, Const):
        q = Fraction(e.value).limit_denominator(10**6)
        return str(q.numerator) if q.denominator == 1 else f"({q.numerator} / {q.denominator})"
    if isinstance(e, Col):
        return names.get(e.name, e.name)
    if isinstance(e, Bin):
        return f"({_lean(e.a, names)} {'^' if e.op == '**' else e.op} {_lean(e.b, names)})"
    if isinstance(e, Un):
        a = _lean(e.a, names)
        return {"floor": f"⌊{a}⌋", "ceil": f"⌈{a}⌉", "abs": f"|{a}|", "exp": f"Real.exp ({a})", "neg": f"(-{a})", "sqrt": f"Real.sqrt ({a})", "square": f"({a} ^ 2)"}[e.op]
    if isinstance(e, Log):
        return f"Real.log ({_lean(e.a, names)})" if e.base is None else f"Real.logb {e.base:g} ({_lean(e.a, names)})"
    if isinstance(e, Extreme):
        return f"{e.op} ({_lean(e.a, names)}) ({_lean(e.b, names)})"
    if isinstance(e, Linear):
        return " + ".join([*(f"{_lean(Const(c), names)} * {_lean(t, names)}" for c, t in e.terms), *([_lean(Const(e.intercept), names)] if e.intercept or not e.terms else [])])
    raise TypeError(type(e))


def _prop(p: Pred, names: Mapping[str, str]) -> str:
    if isinstance(p, Fixed):
        return str(p.value)
    if isinstance(p, Flag):
        return names.get(p.name, p.name)
    if isinstance(p, Not):
        return f"¬({_prop(p.a, names)})"
    if isinstance(p, (And, Or)):
        return "(" + (" ∧ " if isinstance(p, And) else " ∨ ").join(_prop(x, names) for x in p.parts) + ")"
    if isinstance(p, Compare):
        return f"{_lean(p.a, names)} {({'<=': '≤', '>=': '≥', '==': '=', '!=': '≠'}).get(p.op, p.op)} {_lean(p.b, names)}"
    if isinstance(p, Check):
        return f"{p.kind} ({_lean(p.a, names)})"
    raise TypeError(type(p))


def lean(s: Statement, name: str, columns: Sequence[str], subject: str = "G", kind: str = "SimpleGraph V") -> str:
    """A theorem stub with one assumption per part of the hypothesis."""
    names = variable_map(columns, subject)
    parts = s.hypothesis.parts if isinstance(s.hypothesis, And) else [] if s.hypothesis == Fixed(True) else [s.hypothesis]
    given = "".join(f"\n    (h{i + 1} : {_prop(p, names)})" for i, p in enumerate(parts))
    return f"theorem {name} ({subject} : {kind}){given} :\n    {_prop(s.conclusion, names)} := by\n  sorry"


def _linear(e: Expr, by: Fraction = Fraction(1)) -> list[tuple[Fraction, Expr | None]]:
    """Coefficients and what they stand before, None for the free number."""
    if isinstance(e, Const):
        return [(by * Fraction(e.value).limit_denominator(10**6), None)]
    if isinstance(e, Linear):
        return [x for c, t in e.terms for x in _linear(t, by * Fraction(c).limit_denominator(10**6))] + [(by * Fraction(e.intercept).limit_denominator(10**6), None)]
    if isinstance(e, Un) and e.op == "neg":
        return _linear(e.a, -by)
    if isinstance(e, Bin) and e.op in "+-":
        return [*_linear(e.a, by), *_linear(e.b, by if e.op == "+" else -by)]
    if isinstance(e, Bin) and e.op == "*":
        for c, x in ((e.a, e.b), (e.b, e.a)):
            if isinstance(c, Const):
                return _linear(x, by * Fraction(c.value).limit_denominator(10**6))
    if isinstance(e, Bin) and e.op == "/" and isinstance(e.b, Const) and e.b.value:
        return _linear(e.a, by / Fraction(e.b.value).limit_denominator(10**6))
    return [(by, e)]


def _set_of(e: Expr, numbers: Mapping[str, str]) -> str:
    """The least number set that holds an expression's values."""
    if isinstance(e, Const):
        q = Fraction(e.value).limit_denominator(10**6)
        return "ℚ" if q.denominator > 1 else "ℤ" if q < 0 else "ℕ"
    if isinstance(e, Col):
        return numbers.get(e.name, "ℕ")
    if isinstance(e, Log) or isinstance(e, Un) and e.op in ("sqrt", "exp"):
        return "ℝ"
    if isinstance(e, Un) and e.op in ("floor", "ceil"):
        return "ℤ"
    parts = [t for c, x in e.terms for t in (Const(c), x)] + [Const(e.intercept)] if isinstance(e, Linear) else [x for x in (getattr(e, "a", None), getattr(e, "b", None)) if isinstance(x, Expr)]
    least = "ℚ" if isinstance(e, Bin) and e.op == "/" else "ℤ" if isinstance(e, Bin) and e.op == "-" or isinstance(e, Un) and e.op == "neg" else "ℕ"
    return max([least, *(_set_of(x, numbers) for x in parts)], key=_ORDER.index)


def lean_relation(c: Compare, columns: Sequence[str], numbers: Mapping[str, str] | None = None, subject: str = "G") -> str:
    """Both sides over the least number set that holds all their terms, denominators cleared, negative terms moved across."""
    names, numbers = variable_map(columns, subject), dict(numbers or {})
    sides = [_linear(c.a), _linear(c.b)]
    den = math.lcm(*(q.denominator for side in sides for q, _ in side))
    kept: list[dict[Expr | None, int]] = [{}, {}]
    for k, side in enumerate(sides):
        for q, e in side:
            n = int(q * den)
            own = kept[k] if n > 0 else kept[1 - k]
            if n:
                own[e] = own.get(e, 0) + abs(n)
    top = max(["ℕ", *(_set_of(e, numbers) for side in kept for e in side if e is not None)], key=_ORDER.index)

    def term(n: int, e: Expr | None) -> str:
        if e is None:
            return str(n)
        text = _lean(e, names)
        if _set_of(e, numbers) != top or not isinstance(e, Col):
            text = f"({text} : {top})"
        return text if n == 1 else f"{n} * {text}"

    show = lambda side: " + ".join(term(n, e) for e, n in sorted(side.items(), key=lambda x: x[0] is None)) or "0"
    return f"{show(kept[0])} {({'<=': '≤', '>=': '≥', '==': '=', '!=': '≠'}).get(c.op, c.op)} {show(kept[1])}"


def lean_necessary(s: Statement, name: str, columns: Sequence[str], numbers: Mapping[str, str] | None = None, subject: str = "G", kind: str = "SimpleGraph V", extra: Sequence[str] = ("connected", "order ≥ 2")) -> str:
    """As ``lean``, its relation cleared as by ``lean_relation``.

    ``numbers`` gives the columns' own sets; ``extra`` are assumptions put first.
    """
    if not isinstance(s.conclusion, Compare):
        return lean(s, name, columns, subject, kind)
    names = variable_map(columns, subject)
    given = [f"{x} {subject}" if x.isidentifier() else re.sub(r"^(\w+)", rf"\1 {subject}", x) for x in extra]
    parts = s.hypothesis.parts if isinstance(s.hypothesis, And) else [] if s.hypothesis == Fixed(True) else [s.hypothesis]
    given += [p for p in (_prop(x, names) for x in parts) if p not in given]
    hyps = "".join(f"\n    (h{i + 1} : {g})" for i, g in enumerate(given))
    return f"theorem {name} ({subject} : {kind}){hyps} :\n    {lean_relation(s.conclusion, columns, numbers, subject)} := by\n  sorry"


def lean_all(statements: Sequence[Statement], columns: Sequence[str], numbers: Mapping[str, str] | None = None, prefix: str = "statement", subject: str = "G", kind: str = "SimpleGraph V") -> list[str]:
    """A cleared stub for each statement, with its own assumptions alone."""
    return [lean_necessary(s, f"{prefix}_{i}", columns, numbers, subject, kind, ()) for i, s in enumerate(statements, 1)]


def write_lean(statements: Sequence[Statement], path: str, columns: Sequence[str], prefix: str = "statement") -> int:
    """All stubs in one file; how many were written."""
    with open(path, "w") as f:
        for i, s in enumerate(statements, 1):
            f.write(lean(s, f"{prefix}_{i}", columns) + "\n\n")
    return len(statements)


def report(result, most: int = 20) -> str:
    """A result's statements and conditions as text."""
    lines = [f"target: {result.target}"]
    for i, (s, m) in enumerate(result.statements[:most], 1):
        lines.append(f"{i}. {s.pretty()}   [touch {m['touch']}, support {m['support']}]")
    for i, c in enumerate(result.conditions[:most], 1):
        lines.append(f"S{i}. {c.label()}   [covers {c.total_coverage} of {c.target_size}]")
    lines += [f"{k}: {v}" for k, v in result.breakdown.items()]
    return "\n".join(lines)


def condition_report(conditions: Sequence, most: int = 20) -> str:
    """Sufficient conditions under a heading for each property."""
    by: dict[str, list] = {}
    for c in conditions:
        by.setdefault(c.property.label(), []).append(c)
    lines = []
    for name, own in by.items():
        lines.append(f"{name}: {len(own)} conditions")
        lines += [f"  {i}. {c.label()}   [covers {c.total_coverage} of {c.target_size}, holds on {c.support_h}, new {c.coverage}]" for i, c in enumerate(own[:most], 1)]
    return "\n".join(lines)


def class_report(found: Sequence) -> str:
    """How the constant columns of each hypothesis stand to it."""
    heads = {"≡": "equivalent", "⊂": "equalities inside the class", "⊃": "class inside the equalities", "≠": "neither"}
    lines = []
    for kind, head in heads.items():
        own = [c for c in found if c.kind == kind]
        lines.append(f"{head}: {len(own)}")
        lines += [f"  {c.label()}   [equalities alone {c.only_equalities}, class alone {c.only_class}]" for c in own]
    return "\n".join(lines)


def table_report(session) -> dict:
    """What a session found at its start."""
    return {"rows": session.lattice.n, "flags": [f.name for f in session.flags], "invariants": list(session.invariants), "base": session.lattice.base.label(), "hypotheses": [(h.label(), session.lattice.support(h)) for h in session.hypotheses], "redundant": [(a.label(), b.label()) for a, b in session.lattice.redundant(session.lattice.conjunctions(session.max_arity))]}


def initial_report(session) -> tuple[str, dict]:
    """``table_report`` and the class report as text, and as a dict."""
    found = table_report(session)
    classes = session.characterise()
    found["classes"] = [(c.label(), c.only_equalities, c.only_class) for c in classes]
    lines = [f"{found['rows']} rows, {len(found['flags'])} flags, {len(found['invariants'])} invariants", f"base: {found['base']}"]
    lines += [f"hypothesis {label}: {n} rows" for label, n in found["hypotheses"]]
    lines += [f"redundant {a}: as {b}" for a, b in found["redundant"]]
    return "\n".join([*lines, class_report(classes)]), found
