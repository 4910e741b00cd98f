"""Sufficient conditions: which inequality events make a property hold (Sophie).

Every conjecture gives events on the base rows: its two sides equal, below,
above, at most, at least.  Properties are flags, their negations and pairs.  A
row's part in all of this is its signature over events and properties, so the
candidates' supports, violations and coverages come from one aggregation, and
the greedy cover runs on signatures, not rows; many signatures stay in Spark.
The cover is lazy: what an event newly covers only falls as others are chosen,
so a gain counted before is an upper bound, and few events are asked about
again before one stands at the head of the queue with its gain of now.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..pred import TRUE, Compare, Flag, Not, Pred, conj
from ..relation import Statement


@dataclass(frozen=True)
class Settings:
    eq_tol: float = 1e-4
    min_target_support: int = 5
    min_h_support: int = 3
    max_violations: int = 0
    min_new_coverage: int = 1


@dataclass(frozen=True)
class Condition:
    """hypothesis event ⇒ property."""

    property: Pred
    event: Pred
    core: Pred
    support_h: int
    coverage: int
    total_coverage: int
    target_size: int
    violations: int

    @property
    def both_ways(self) -> bool:
        return self.violations == 0 and self.total_coverage == self.target_size == self.support_h

    def label(self) -> str:
        return f"{self.event.label()} {'⇔' if self.both_ways else '⇒'} {self.property.label()}"


def events(s: Statement, tol: float) -> list[Pred]:
    """The five events of a bound, under its hypothesis."""
    c = s.conclusion
    if not isinstance(c, Compare):
        return []
    kinds = [Compare("==", c.a, c.b, tol, 1e-9), Compare("<", c.a, c.b, tol), Compare(">", c.a, c.b, tol), Compare("<=", c.a, c.b), Compare(">=", c.a, c.b)]
    return [conj([s.hypothesis, k]) for k in kinds]


def properties(flags: Sequence[Flag]) -> list[Pred]:
    pairs = [conj([a, b]) for a, b in combinations(flags, 2)]
    return [*flags, *(Not(f) for f in flags), *pairs]


def signatures(df: DataFrame, preds: Sequence[Pred], base: Pred = TRUE) -> DataFrame:
    """sig (a character for each predicate), n: the different rows of truth values and how often they occur."""
    sig = F.concat(F.lit(""), *[F.when(p.column(), "1").otherwise("0") for p in preds])
    return df.filter(base.column()).groupBy(sig.alias("sig")).agg(F.count("*").alias("n"))


def signature_counts(df: DataFrame, preds: Sequence[Pred], base: Pred = TRUE) -> dict[str, int]:
    return {r["sig"]: r["n"] for r in signatures(df, preds, base).collect()}


#: Signatures that come to the driver; more stay where they are and are summed there.
MOST_SIGNATURES = 50_000


class _Counts:
    """Sums over the signatures of some predicates: here if they are few, else in Spark, an aggregate for each question."""

    def __init__(self, df: DataFrame, preds: Sequence[Pred], base: Pred):
        self.table = signatures(df, preds, base).persist()
        rows = self.table.limit(MOST_SIGNATURES + 1).collect()
        self.few = len(rows) <= MOST_SIGNATURES
        if self.few:
            self.n = np.array([r["n"] for r in rows], np.int64)
            self.bits = np.array([[c == "1" for c in r["sig"]] for r in rows], bool).reshape(len(rows), len(preds))

    def sums(self, asked: Sequence[tuple[Sequence[int], Sequence[int]]], chunk: int = 300) -> list[int]:
        """Rows in which all predicates of the first list hold and none of the second, for each question."""
        if self.few:
            out = []
            for on, off in asked:
                rows = self.bits[:, list(on)].all(axis=1) & ~self.bits[:, list(off)].any(axis=1)
                out.append(int(self.n[rows].sum()))
            return out
        out = []
        for lo in range(0, len(asked), chunk):
            cols = []
            for i, (on, off) in enumerate(asked[lo : lo + chunk]):
                test = F.lit(True)
                for j, bit in [*((j, "1") for j in on), *((j, "0") for j in off)]:
                    test = test & (F.substring("sig", j + 1, 1) == bit)
                cols.append(F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"s{i}"))
            out += list(self.table.agg(*cols).first())
        return out


#: Candidates at the queue's head that are asked about together.
ASKED = 8


def lazy_cover(candidates: Sequence[tuple[int, int]], gains: Callable[[list[int], list[int]], list[int]], least: int = 1) -> list[tuple[int, int]]:
    """Greedy choices (candidate, gain): the largest gain first, then the larger size, then order, while it is ``least`` or more.

    ``candidates`` have a first gain and a size; ``gains(some, chosen)`` counts
    what some of them add to those chosen, which never grows.
    """
    queue = [(-gain, -size, k, 0) for k, (gain, size) in enumerate(candidates)]
    heapq.heapify(queue)
    out: list[tuple[int, int]] = []
    while queue and -queue[0][0] >= least:
        if queue[0][3] == len(out):
            gain, _, k, _ = heapq.heappop(queue)
            out.append((k, -gain))
            continue
        stale = [heapq.heappop(queue)]
        while queue and len(stale) < ASKED and queue[0][3] < len(out) and -queue[0][0] >= least:
            stale.append(heapq.heappop(queue))
        for (_, size, k, _), gain in zip(stale, gains([x[2] for x in stale], [c for c, _ in out]), strict=True):
            heapq.heappush(queue, (-gain, size, k, len(out)))
    return out


def discover(df: DataFrame, flags: Sequence[Flag], statements: Sequence[Statement], base: Pred = TRUE, settings: Settings = Settings()) -> list[Condition]:
    """Per property a greedy cover of its rows by events: most newly covered rows first, then support, then order."""
    event_of = [(e, s) for s in statements for e in events(s, settings.eq_tol)]
    targets = properties(flags)
    if not event_of or not targets:
        return []
    preds = list(dict.fromkeys([*targets, *(e for e, _ in event_of)]))
    at = {p: i for i, p in enumerate(preds)}
    counts = _Counts(df, preds, base)
    try:
        size = dict(zip(preds, counts.sums([([i], []) for i in range(len(preds))]), strict=True))
        # of several properties of the same rows the first
        pairs = [(t, u) for i, t in enumerate(targets) for u in targets[:i] if size[t] == size[u]]
        twin = {t for (t, _), n in zip(pairs, counts.sums([([at[t]], [at[u]]) for t, u in pairs]), strict=True) if n == 0}
        kept = [t for t in targets if size[t] >= settings.min_target_support and t not in twin]
        usable = [(e, s) for e, s in event_of if size[e] >= settings.min_h_support]
        both = counts.sums([([at[t], at[e]], []) for t in kept for e, _ in usable])
        out: list[Condition] = []
        for i, target in enumerate(kept):
            covered = both[i * len(usable) : (i + 1) * len(usable)]
            left = [(e, s, n) for (e, s), n in zip(usable, covered, strict=True) if n and size[e] - n <= settings.max_violations]
            for k, new in lazy_cover([(n, size[e]) for e, _, n in left], lambda some, chosen: counts.sums([([at[target], at[left[k][0]]], [at[left[c][0]] for c in chosen]) for k in some]), max(1, settings.min_new_coverage)):  # noqa: B023
                e, s, n = left[k]
                out.append(Condition(target, e, s.conclusion, size[e], new, n, size[target], size[e] - n))
        return rank(out)
    finally:
        counts.table.unpersist()


def rank(conditions: Sequence[Condition]) -> list[Condition]:
    """First of equal ones; by share covered, coverage, support and simplicity."""
    once = {(c.property, c.event): c for c in reversed(conditions)}
    rows = [c for c in conditions if once[c.property, c.event] is c]
    return sorted(rows, key=lambda c: (-c.total_coverage / max(1, c.target_size), -c.total_coverage, -c.support_h, len(c.event.label())))
