"""Expressions, predicates and statements as Unicode text with no more parentheses than their meaning needs."""

from __future__ import annotations

from fractions import Fraction

from ..expr import Bin, Col, Const, Expr, Extreme, Linear, Log, Un, fraction_text
from ..pred import And, Between, Check, Compare, Fixed, In, Not, Or, Pred, Xor
from ..relation import All, Any_, Equivalence, Inclusion, Statement

#: How tightly a text binds: sums, products, signs, powers, everything else.
SUM, PRODUCT, SIGN, POWER, ATOM = range(5)
_POWERS = {2: "²", 3: "³"}
_RELATIONS = {"<=": "≤", ">=": "≥", "==": "=", "!=": "≠", "<": "<", ">": ">"}


def _within(text: tuple[str, int], least: int) -> str:
    return text[0] if text[1] >= least else f"({text[0]})"


def _number(value) -> tuple[str, int]:
    text = fraction_text(value)
    return text, SIGN if text.startswith("-") and "/" not in text else PRODUCT if "/" in text else ATOM


def _negative(e: Expr) -> Expr | None:
    """What stands behind the sign of a term that is printed with one."""
    if isinstance(e, Const) and e.value < 0:
        return Const(-e.value)
    if isinstance(e, Un) and e.op == "neg":
        return e.a
    if isinstance(e, Bin) and e.op == "*":
        for c, x in ((e.a, e.b), (e.b, e.a)):
            if isinstance(c, Const) and c.value < 0:
                return x if c.value == -1 else Bin("*", Const(-c.value), x)
    return None


def _sum(parts: list[tuple[int, Expr]]) -> tuple[str, int]:
    """Signed terms one after another; zeros are left out."""
    kept = []
    for sign, e in parts:
        if isinstance(e, Const) and e.value == 0:
            continue
        inner = _negative(e)
        kept.append((-sign, inner) if inner is not None else (sign, e))
    if not kept:
        return "0", ATOM
    if len(kept) == 1:
        text = _text(kept[0][1])
        return text if kept[0][0] > 0 else (f"-{_within(text, PRODUCT)}", SIGN)
    out = ""
    for sign, e in kept:
        text = _within(_text(e), PRODUCT if sign < 0 or out else SUM)
        out += f" {'+' if sign > 0 else '-'} {text}" if out else ("" if sign > 0 else "-") + text
    return out, SUM


def _terms(e: Expr, sign: int = 1) -> list[tuple[int, Expr]]:
    if isinstance(e, Bin) and e.op in "+-":
        return [*_terms(e.a, sign), *_terms(e.b, sign if e.op == "+" else -sign)]
    return [(sign, e)]


def _product(a: Expr, b: Expr) -> tuple[str, int]:
    for c, x in ((a, b), (b, a)):
        if isinstance(c, Const):
            if c.value == 1:
                return _text(x)
            if c.value == 0:
                return "0", ATOM
            if c.value < 0:
                text = _product(Const(-c.value), x)
                return f"-{_within(text, PRODUCT)}", SIGN
            number = _number(c.value)
            return f"{_within(number, ATOM if '/' in number[0] else PRODUCT)}·{_within(_text(x), SIGN + 1)}", PRODUCT
    return f"{_within(_text(a), PRODUCT)}·{_within(_text(b), SIGN + 1)}", PRODUCT


def _power(a: Expr, b: Expr) -> tuple[str, int]:
    base = _within(_text(a), ATOM)
    if isinstance(b, Const):
        if b.value in _POWERS:
            return base + _POWERS[b.value], POWER
        if b.value == 1:
            return _text(a)
        if b.value == Fraction(1, 2):
            return f"√{_within(_text(a), ATOM)}", POWER
    return f"{base}^{_within(_text(b), ATOM)}", POWER


def _text(e: Expr) -> tuple[str, int]:
    if isinstance(e, Const):
        return _number(e.value)
    if isinstance(e, Col):
        return e.name, ATOM
    if isinstance(e, Linear):
        return _sum([*((1, Bin("*", Const(c), t)) for c, t in e.terms), (1, Const(e.intercept))])
    if isinstance(e, Extreme):
        return f"{e.op}({pretty(e.a)}, {pretty(e.b)})", ATOM
    if isinstance(e, Log):
        name = {None: "ln", 2: "log₂", 10: "log₁₀"}.get(e.base, f"log_{e.base}")
        return f"{name}({pretty(e.a)})", ATOM
    if isinstance(e, Un):
        inner = _text(e.a)
        wrapped = {"floor": "⌊⌋", "ceil": "⌈⌉", "abs": "||"}.get(e.op)
        if wrapped:
            return f"{wrapped[0]}{inner[0]}{wrapped[1]}", ATOM
        if e.op == "neg":
            return _sum([(-1, e.a)])
        if e.op == "sqrt":
            return f"√{_within(inner, ATOM)}", POWER
        if e.op == "square":
            return _power(e.a, Const(2))
        return f"e^{_within(inner, ATOM)}", POWER
    if isinstance(e, Bin):
        if e.op in "+-":
            return _sum(_terms(e))
        if e.op == "*":
            return _product(e.a, e.b)
        if e.op == "**":
            return _power(e.a, e.b)
        if e.op == "/" and isinstance(e.b, Const) and e.b.value == 1:
            return _text(e.a)
        sign = {"/": " / ", "%": " mod "}[e.op]
        return f"{_within(_text(e.a), PRODUCT)}{sign}{_within(_text(e.b), SIGN + 1)}", PRODUCT
    return e.label(), ATOM


def pretty(e: Expr) -> str:
    return _text(e)[0]


def pretty_pred(p: Pred, inner: bool = False) -> str:
    """A predicate's text, in parentheses if it stands ``inner`` another that binds tighter."""
    if isinstance(p, Fixed):
        return str(p.value).upper()
    if isinstance(p, Compare):
        return f"{pretty(p.a)} {_RELATIONS[p.op]} {pretty(p.b)}"
    if isinstance(p, (And, All)):
        out = " ∧ ".join(pretty_pred(x, isinstance(x, (Or, Any_, Xor))) for x in p.parts)
    elif isinstance(p, (Or, Any_)):
        out = " ∨ ".join(pretty_pred(x, isinstance(x, (And, All, Xor))) for x in p.parts)
    elif isinstance(p, Xor):
        out = " ⊕ ".join(pretty_pred(x, isinstance(x, (And, All, Or, Any_, Xor))) for x in (p.a, p.b))
    elif isinstance(p, Not):
        return f"¬{pretty_pred(p.a, not isinstance(p.a, Fixed) and type(p.a).__name__ != 'Flag')}"
    elif isinstance(p, In):
        return f"{p.a} ∈ {{{', '.join(map(str, p.values))}}}"
    elif isinstance(p, Between):
        return f"{pretty(p.a)} ∈ {'[' if p.closed[0] else '('}{pretty(p.low)}, {pretty(p.high)}{']' if p.closed[1] else ')'}"
    elif isinstance(p, Check) and type(p) is Check:
        return f"{pretty(p.a)} {({'is_integer': '∈ ℤ', 'is_nan': 'is missing', 'is_finite': 'is finite'})[p.kind]}"
    else:
        return p.label()
    return f"({out})" if inner else out


def pretty_statement(s: Statement | Inclusion | Equivalence) -> str:
    if isinstance(s, Statement):
        return f"({pretty_pred(s.hypothesis)}) ⇒ {pretty_pred(s.conclusion)}"
    return f"{pretty_pred(s.a, not isinstance(s.a, (Compare, Fixed)) and bool(getattr(s.a, 'parts', ())))} {'⊆' if isinstance(s, Inclusion) else '≡'} {pretty_pred(s.b, bool(getattr(s.b, 'parts', ())))}"
