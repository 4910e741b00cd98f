"""Filters over statements: generality, significance, duplicates, order, equalities.

Generality (Morgan) compares the sets of rows that hypotheses select: one pass
finds, for every hypothesis, all those that hold wherever it does.
Significance (Dalmatian) asks whether a bound is somewhere sharper than all
bounds before it; each row carries its running envelope along the candidates,
so no row meets another and only one flag per candidate leaves a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nf
from ..pred import COMPLEMENT, Compare, Pred, conj, disj
from ..relation import All, Statement, evaluate
from .lattice import WORD, words


def conclusion_key(p: Pred) -> str:
    """One key for a ≤ b and b ≥ a."""
    if isinstance(p, Compare) and p.op in (">=", ">"):
        return f"{p.b.label()} {'<=' if p.op == '>=' else '<'} {p.a.label()}"
    return p.label()


def outside(df: DataFrame, pairs: Iterable[tuple[Pred, Pred]], chunk: int = 300) -> dict[tuple[Pred, Pred], int]:
    """For each pair the rows where the first predicate holds and the second does not; a pass for every ``chunk`` pairs."""
    todo = list(dict.fromkeys(pairs))
    out: dict[tuple[Pred, Pred], int] = {}
    for lo in range(0, len(todo), chunk):
        part = todo[lo : lo + chunk]
        row = df.agg(*[F.count_if(a.column() & ~b.column()).alias(f"c{i}") for i, (a, b) in enumerate(part)]).first()
        out |= {p: row[f"c{i}"] for i, p in enumerate(part)}
    return out


def containing(df: DataFrame, hyps: Sequence[Pred]) -> dict[Pred, set[Pred]]:
    """For each hypothesis those that hold on every row where it does, itself among them; all of them where it never does.

    A containment join without pairs: rows become signatures over the
    hypotheses, of which the different ones are listed under every hypothesis
    in them (an inverted index), and the bitwise and of a list is what all its
    signatures share.  One job, whose result is a row for each hypothesis.
    """
    every = list(dict.fromkeys(hyps))
    if not every:
        return {}
    names = [f"w{k}" for k in range(-(-len(every) // WORD))]
    sigs = df.select(*[w.alias(n) for n, w in zip(names, words(every), strict=True)]).distinct()
    # the bits that are set, by word
    of_word = lambda k: F.filter(F.sequence(F.lit(k * WORD), F.lit(min(len(every), (k + 1) * WORD) - 1)), lambda i: F.getbit(F.col(names[k]), i - k * WORD) == 1)
    listed = sigs.select(*names, F.explode(F.concat(*[of_word(k) for k in range(len(names))])).alias("i"))
    out = {h: set(every) for h in every}
    for r in listed.groupBy("i").agg(*[F.bit_and(n).alias(n) for n in names]).collect():
        out[every[r["i"]]] = {every[k * WORD + j] for k, n in enumerate(names) for j in range(WORD) if r[n] >> j & 1}
    return out


def morgan(df: DataFrame, statements: Sequence[Statement]) -> list[Statement]:
    """Per conclusion the statements whose hypothesis is not strictly inside another's; equal ones all stay."""
    same: dict[str, set[Pred]] = {}
    for s in statements:
        same.setdefault(conclusion_key(s.conclusion), set()).add(s.hypothesis)
    # hypotheses that are alone with their conclusion are compared with none
    inside = containing(df, [h for hyps in same.values() if len(hyps) > 1 for h in hyps])
    return [s for s in statements if not any(h in inside.get(s.hypothesis, ()) and s.hypothesis not in inside[h] for h in same[conclusion_key(s.conclusion)])]


def morgan_accept(df: DataFrame, new: Statement, existing: Sequence[Statement]) -> bool:
    """Whether no existing statement of the same conclusion has a strictly larger hypothesis."""
    others = [s.hypothesis for s in existing if conclusion_key(s.conclusion) == conclusion_key(new.conclusion) and s.hypothesis != new.hypothesis]
    inside = containing(df, [new.hypothesis, *others]) if others else {}
    return not any(h in inside[new.hypothesis] and new.hypothesis not in inside[h] for h in others)


def _envelope(df: DataFrame, groups: Sequence[Sequence[Statement]], tol: float, against_all: bool) -> list[list[bool]]:
    """For each group of bounds on one side, one hypothesis and target: whether each is sharper somewhere than those before it (or all others)."""
    cols, shape = [], []
    for g, group in enumerate(groups):
        upper = group[0].conclusion.op in ("<=", "<")
        sign = F.lit(1.0 if upper else -1.0)
        h = group[0].hypothesis.column()
        for s in group:
            cols.append(F.when(h, nf.only_finite(s.conclusion.b.column()) * sign).alias(f"c{len(shape)}"))
            shape.append(g)
    if not cols:
        return []

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        import numpy as np

        best = np.zeros(len(shape), bool)
        for frame in frames:
            m = np.where(np.isnan(x := frame.to_numpy(dtype=float)), np.inf, x)
            lo = 0
            while lo < len(shape):
                hi = lo + shape.count(shape[lo])
                part = m[:, lo:hi]
                if against_all:
                    order = np.sort(part, axis=1)
                    second = order[:, 1] if part.shape[1] > 1 else np.full(len(part), np.inf)
                    others = np.where(part == order[:, :1], second[:, None], order[:, :1])
                else:
                    others = np.full_like(part, np.inf)
                    others[:, 1:] = np.minimum.accumulate(part, axis=1)[:, :-1]
                best[lo:hi] |= ((part < others - tol) & np.isfinite(part)).any(axis=0)
                lo = hi
        yield pd.DataFrame({"i": np.arange(len(shape)), "ok": best})

    found = {r["i"]: r["ok"] for r in df.select(*cols).mapInPandas(run, "i long, ok boolean").groupBy("i").agg(F.bool_or("ok").alias("ok")).collect()}
    out: list[list[bool]] = [[] for _ in groups]
    for i, g in enumerate(shape):
        out[g].append(bool(found.get(i, False)))
    return out


def _sided(statements: Sequence[Statement]) -> tuple[dict[tuple, list[int]], list[int]]:
    groups: dict[tuple, list[int]] = {}
    rest = []
    for i, s in enumerate(statements):
        if isinstance(s.conclusion, Compare) and s.conclusion.op in ("<=", ">=", "<", ">"):
            groups.setdefault((s.conclusion.a.label(), s.conclusion.op[0], s.hypothesis), []).append(i)
        else:
            rest.append(i)
    return groups, rest


def dalmatian(df: DataFrame, statements: Sequence[Statement], tol: float = 1e-9) -> list[Statement]:
    """In order, per target, side and hypothesis: bounds that are somewhere sharper than all before them; others pass."""
    groups, keep = _sided(statements)
    ok = _envelope(df, [[statements[i] for i in g] for g in groups.values()], tol, False)
    keep = set(keep) | {i for g, flags in zip(groups.values(), ok, strict=True) for i, x in zip(g, flags, strict=True) if x}
    return [s for i, s in enumerate(statements) if i in keep]


def dalmatian_batch(df: DataFrame, statements: Sequence[Statement]) -> list[Statement]:
    """True bounds that are somewhere sharper than every other one of their group; of equal ones the first stays."""
    true = [s for s, m in zip(statements, evaluate(df, list(statements)).values(), strict=True) if m["violations"] == 0]
    seen: set[tuple] = set()
    once = [s for s in true if (k := (s.hypothesis, conclusion_key(s.conclusion))) not in seen and not seen.add(k)]
    groups, keep = _sided(once)
    ok = _envelope(df, [[once[i] for i in g] for g in groups.values()], 0.0, True)
    keep = set(keep) | {i for g, flags in zip(groups.values(), ok, strict=True) for i, x in zip(g, flags, strict=True) if x}
    return [s for i, s in enumerate(once) if i in keep]


def dalmatian_accept(df: DataFrame, new: Statement, existing: Sequence[Statement]) -> bool:
    """Whether the new statement is true and sharper somewhere than the prior bounds of its hypothesis, target and side."""
    if evaluate(df, [new])[0]["violations"]:
        return False
    c = new.conclusion
    prior = [s for s in existing if s.hypothesis == new.hypothesis and isinstance(s.conclusion, Compare) and s.conclusion.a == c.a and s.conclusion.op[0] == c.op[0]]
    return not prior or _envelope(df, [[*prior, new]], 0.0, False)[0][-1]


def sophie_accept(df: DataFrame, new: Statement, existing: Sequence[Statement]) -> bool:
    """Whether the new hypothesis covers a row that no accepted one of the same conclusion covers."""
    same = [s.hypothesis for s in existing if s.conclusion == new.conclusion]
    return outside(df, [(new.hypothesis, disj(same))])[new.hypothesis, disj(same)] > 0


def unique(statements: Sequence[Statement]) -> list[Statement]:
    """The first of each hypothesis and conclusion (structure, not only text)."""
    seen: set = set()
    return [s for s in statements if (s.hypothesis, s.conclusion) not in seen and not seen.add((s.hypothesis, s.conclusion))]


def ranked(df: DataFrame, statements: Sequence[Statement], by: str = "touch", least_touch: int = 0, known: Mapping[Statement, dict] | None = None) -> list[tuple[Statement, dict]]:
    """With metrics, by ``by`` (then support) descending, in order otherwise; statements of fewer touches go.  ``known`` metrics are not evaluated again."""
    found = dict(known or {})
    new = [s for s in dict.fromkeys(statements) if s not in found]
    found |= {s: m for s, m in zip(new, evaluate(df, new).values(), strict=True)}
    rows = [(s, found[s]) for s in statements if (found[s]["touch"] or 0) >= least_touch]
    return sorted(rows, key=lambda r: (-(r[1][by] or 0), -(r[1]["support"] or 0)))


def equalities(df: DataFrame, statements: Sequence[Statement]) -> tuple[list[Statement], list[Statement]]:
    """(equalities, the rest): bounds whose slack is 0 on every row of a non-empty hypothesis."""
    found = evaluate(df, list(statements))
    equal, rest = [], []
    for i, s in enumerate(statements):
        m = found[i]
        if isinstance(s.conclusion, Compare) and s.conclusion.op in ("<=", ">=") and m["support"] and m["min_slack"] == 0 and m["max_slack"] == 0 and m["violations"] == 0:
            equal.append(Statement(s.hypothesis, Compare("==", s.conclusion.a, s.conclusion.b), stage=s.stage))
        else:
            rest.append(s)
    return equal, rest


def strengthened(statements: Sequence[Statement]) -> list[Statement]:
    """H1 ⇒ t ≤ R and H2 ⇒ t ≥ R give (H1 ∧ H2) ⇒ t = R, for every such pair."""
    upper: dict[tuple, list[Statement]] = {}
    for s in statements:
        if isinstance(s.conclusion, Compare) and s.conclusion.op == "<=":
            upper.setdefault((s.conclusion.a, s.conclusion.b), []).append(s)
    out = [Statement(conj([u.hypothesis, s.hypothesis]), Compare("==", s.conclusion.a, s.conclusion.b), stage="strengthened") for s in statements if isinstance(s.conclusion, Compare) and s.conclusion.op == ">=" for u in upper.get((s.conclusion.a, s.conclusion.b), [])]
    return unique(out)


def contrapositives(statements: Sequence[Statement]) -> list[Statement]:
    return [s.contrapositive() for s in statements]


def merged_by_hypothesis(df: DataFrame, statements: Sequence[Statement]) -> list[tuple[Pred, list[Statement]]]:
    """Statements of hypotheses that select the same rows together, of equal conclusions the first; of two bounds with equal form the sharper."""
    hyps = list(dict.fromkeys(s.hypothesis for s in statements))
    inside = containing(df, hyps)
    alike: dict[frozenset, Pred] = {}
    # hypotheses of the same rows have the same ones around them
    first = {h: alike.setdefault(frozenset(inside[h]), h) for h in hyps}
    groups: dict[Pred, list[Statement]] = {}
    for s in statements:
        groups.setdefault(first[s.hypothesis], []).append(s)
    out = []
    for group in groups.values():
        kept: dict[tuple, Statement] = {}
        for s in group:
            c = s.conclusion
            form = (c.a, c.op, getattr(c.b, "terms", c.b)) if isinstance(c, Compare) else (c,)
            old = kept.get(form)
            if old is None or (hasattr(c, "b") and hasattr(c.b, "intercept") and (c.b.intercept < old.conclusion.b.intercept) == (c.op == "<=")):
                kept[form] = s
        out.append((group[0].hypothesis, list(kept.values())))
    return out


def compressed(statements: Sequence[Statement]) -> list[Statement]:
    """One statement for each hypothesis, its different relations joined; those that are no relations stay by themselves."""
    groups: dict[Pred, list[Compare]] = {}
    rest = []
    for s in statements:
        parts = s.conclusion.parts if isinstance(s.conclusion, All) else (s.conclusion,)
        if all(isinstance(p, Compare) for p in parts):
            own = groups.setdefault(s.hypothesis, [])
            own += [p for p in parts if p not in own]
        else:
            rest.append(s)
    return [Statement(h, parts[0] if len(parts) == 1 else All(tuple(parts))) for h, parts in groups.items()] + rest


#: Registries: generators, post-processors and pipelines by name.
GENERATORS: dict[str, Callable] = {}
POST: dict[str, Callable] = {}
PIPELINES: dict[str, Callable] = {}


def register(table: dict[str, Callable], name: str | None = None) -> Callable[[Callable], Callable]:
    def put(fn: Callable) -> Callable:
        table[name or fn.__name__] = fn
        return fn

    return put


register(POST, "remove_duplicates")(lambda statements, df: unique(statements))
register(POST, "sort_by_touch_count")(lambda statements, df: [s for s, _ in ranked(df, statements, "touch_all")])
register(POST, "sort_by_accuracy")(lambda statements, df: [s for s, _ in ranked(df, statements, "accuracy")])
register(POST, "filter_dalmatian")(lambda statements, df: dalmatian_batch(df, statements))
register(POST, "filter_morgan")(lambda statements, df: morgan(df, statements))
register(POST, "split_equalities")(lambda statements, df: [s for part in reversed(equalities(df, statements)) for s in part])

__all__ = ["COMPLEMENT", "GENERATORS", "PIPELINES", "POST"]
