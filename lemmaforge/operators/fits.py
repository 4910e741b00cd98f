"""Fitted bounds: the least-slack linear form above (or below) the target, for many hypotheses and feature subsets.

Minimising the total slack under one-sided fit needs k + 1 variables only: the
objective is the features' sums.  Rows are never gathered: a candidate holds a
few, and every pass compares all rows with all forms in one matrix product and
exchanges the outermost violated ones, until there is none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import Const, Expr, Linear, Log, Un, affine
from ..functions import numeric as nf
from ..pred import Compare, Pred
from ..relation import Statement, evaluate
from . import hull, solve

FREE = 1e7
#: Groups in which the tasks' bases of one candidate are merged before the last merge.
FAN_IN = 64


@dataclass(frozen=True)
class Candidate:
    hyp: int
    features: tuple[int, ...]


@dataclass(frozen=True)
class Fit:
    candidate: Candidate
    upper: bool
    weights: tuple[float, ...]
    intercept: float
    rows: int


def _matrix(df: DataFrame, target: Expr, features: Sequence[Expr], hyps: Sequence[Pred]) -> DataFrame:
    return df.select(nf.only_finite(target.column()).alias("y"), *[nf.only_finite(e.column()).alias(f"f{i}") for i, e in enumerate(features)], *[h.column().alias(f"h{i}") for i, h in enumerate(hyps)])


def _of(frame: pd.DataFrame, n_features: int, n_hyps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = frame.iloc[:, : 1 + n_features].to_numpy(dtype=float)
    return x[:, 0], x[:, 1:], frame.iloc[:, 1 + n_features : 1 + n_features + n_hyps].to_numpy(dtype=bool)


def _points(y, f, h, c: Candidate) -> tuple[np.ndarray, np.ndarray]:
    x = f[:, list(c.features)]
    on = h[:, c.hyp] & np.isfinite(y) & np.isfinite(x).all(axis=1)
    return x[on], y[on]


#: Part of a mean by which a slope's cost is raised, the more the later the feature: of equally good forms one is least whatever the order of the rows.
TIE = 1e-9
#: Rows compared with all candidates at once.
CHUNK = 2_000


#: Rows that a candidate holds before those that its form does not rest on are let go.
HELD = 600


def _outermost(points: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Places of the rows that a form is to be fitted to next: the most violated one, the outermost ones in each feature, and of these directions' halves the most violated."""
    at = [gap.argmax()]
    for x in points[:, :-1].T:
        at += [x.argmin(), x.argmax()]
        middle = (x.min() + x.max()) / 2
        at += [np.where(x <= middle, gap, -np.inf).argmax(), np.where(x >= middle, gap, -np.inf).argmax()]
    return np.unique(at)


def best_form(pts: np.ndarray, cost: np.ndarray, upper: bool, box: float = FREE, nonneg: bool = False, solver: Callable = solve.lp) -> tuple[np.ndarray, np.ndarray] | None:
    """Slopes and intercept of the least-slack form over points (features, target), and the places of those that it rests on.

    ``cost`` has the features' means and 1.
    """
    sign = 1.0 if upper else -1.0
    limit = np.full(len(cost), float(box))
    limit[-1] = max(limit[-1], 1e9)
    rows, least = np.hstack([pts[:, :-1], np.ones((len(pts), 1))]), sign * pts[:, -1]
    if nonneg:
        extra = np.vstack([np.eye(len(cost))[:-1], cost])
        rows, least = np.vstack([rows, extra if upper else -extra]), np.append(least, np.zeros(len(extra)))
    raised = cost + TIE * np.abs(cost).max() * np.append(np.arange(1, len(cost)), 0)
    got = solver(rows, least, raised, limit)
    return None if got is None else (sign * got[0], got[1][got[1] < len(pts)])


def fit(df: DataFrame, target: Expr, features: Sequence[Expr], hyps: Sequence[Pred], candidates: Sequence[Candidate], box: float = FREE, least_rows: int = 1, nonneg: bool = False, solver: Callable = solve.lp) -> list[Fit]:
    """The optimal upper and lower form of each candidate with enough rows.

    ``nonneg`` restricts a single feature's slope, and its form's value at the
    feature's mean, to 0 and above.  ``solver`` takes what ``solve.lp`` takes and
    may stand in for it.

    Rows are exchanged: each candidate holds a few, its form is the optimum over
    them, and a pass over all rows adds the outermost violated ones.  Held rows
    are let go (beyond HELD) only when the optimum's value has grown, so either that grows or
    more rows are held: no set comes back, and passes end when no row that is
    not held is violated by more than rounding.  Where a form is not the only
    best one, raised costs (TIE) choose, hence the same in any partitioning.
    """
    m = _matrix(df, target, features, hyps).persist()
    n_features, n_hyps, cands = len(features), len(hyps), list(candidates)
    used = np.zeros((len(cands), n_features))
    for i, c in enumerate(cands):
        used[i, list(c.features)] = 1.0
    of_hyp = {h: [i for i, c in enumerate(cands) if c.hyp == h] for h in range(n_hyps)}

    def parts(frames: Iterable[pd.DataFrame]) -> Iterable[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates of a hypothesis, its rows' targets and features (0 where there is none), and which candidates a row lacks a feature for."""
        for frame in frames:
            for lo in range(0, len(frame), CHUNK):
                y, f, h = _of(frame.iloc[lo : lo + CHUNK], n_features, n_hyps)
                there = np.isfinite(f)
                for hyp, own in of_hyp.items():
                    on = h[:, hyp] & np.isfinite(y)
                    if own and on.any():
                        absent = (~there[on]).astype(float) @ used[own].T > 0
                        yield own, y[on], np.where(there[on], f[on], 0.0), absent

    def sums(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        total, n = np.zeros((len(cands), n_features)), np.zeros(len(cands))
        for own, _, x, absent in parts(frames):
            total[own] += (~absent).T.astype(float) @ x
            n[own] += (~absent).sum(axis=0)
        rows = [(i, -1, float(n[i])) for i in range(len(cands))] + [(i, j, float(total[i, j])) for i, c in enumerate(cands) for j in c.features]
        yield pd.DataFrame(rows, columns=["i", "j", "s"])

    try:
        found = {(r["i"], r["j"]): r["s"] for r in m.mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
        n_rows = [int(found.get((i, -1), 0)) for i in range(len(cands))]
        costs = {i: np.array([*(found[i, j] / n_rows[i] for j in c.features), 1.0]) for i, c in enumerate(cands) if n_rows[i] >= max(1, least_rows)}
        current: dict[tuple[int, bool], np.ndarray] = {}
        held: dict[tuple[int, bool], np.ndarray] = {}
        open_ = {(i, up) for i in costs for up in (True, False)}

        def optimum(key: tuple[int, bool], pts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
            return best_form(pts, costs[key[0]], key[1], box, nonneg, solver)

        while open_:
            todo, now, base = sorted(open_), dict(current), dict(held)
            keys_of = {h: [(i, up) for i, up in todo if cands[i].hyp == h] for h in range(n_hyps)}

            def violated(frames: Iterable[pd.DataFrame], now=now, keys_of=keys_of) -> Iterable[pd.DataFrame]:
                """The outermost violated rows of a task, by candidate and side."""
                best: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
                for own, y, x, absent in parts(frames):
                    keys = keys_of[cands[own[0]].hyp]
                    if not keys:
                        continue
                    forms = np.zeros((len(keys), n_features + 1))
                    for k, key in enumerate(keys):
                        if key in now:
                            forms[k, [*cands[key[0]].features, n_features]] = now[key]
                    sign = np.array([1.0 if up else -1.0 for _, up in keys])
                    gaps = (y[:, None] - x @ forms[:, :-1].T - forms[:, -1]) * sign
                    at = {i: k for k, i in enumerate(own)}
                    gaps[absent[:, [at[i] for i, _ in keys]]] = -np.inf
                    least = np.where([key in now for key in keys], 1e-9, -np.inf) * (1 + np.abs(y))[:, None]
                    bad = (gaps > least) & np.isfinite(gaps)
                    for k in np.flatnonzero(bad.any(axis=0)):
                        rows = bad[:, k]
                        pts, gap = np.hstack([x[rows][:, list(cands[keys[k][0]].features)], y[rows, None]]), gaps[rows, k]
                        if keys[k] in best:
                            pts, gap = np.vstack([best[keys[k]][0], pts]), np.append(best[keys[k]][1], gap)
                        some = _outermost(pts, gap)
                        best[keys[k]] = (pts[some], gap[some])
                yield pd.DataFrame([(*key, float(g), p.tolist()) for key, (pts, gap) in best.items() for p, g in zip(pts, gap, strict=True)], columns=["i", "up", "gap", "p"])

            def narrowed(group: pd.DataFrame) -> pd.DataFrame:
                return group.iloc[_outermost(np.array(group["p"].tolist()), group["gap"].to_numpy())][["i", "up", "gap", "p"]]

            def exchanged(group: pd.DataFrame) -> pd.DataFrame:  # noqa: B023  runs within this pass
                """A candidate's form over what it holds and the new rows, and what it holds now; no rows where nothing is new or the form stays."""
                key = (int(group["i"].iloc[0]), bool(group["up"].iloc[0]))
                before = base.get(key, np.empty((0, len(cands[key[0]].features) + 1)))
                pts = np.unique(np.vstack([before, np.array(group["p"].tolist())]), axis=0)
                got = optimum(key, pts)
                if got is None:
                    return pd.DataFrame([(*key, False, [], [])], columns=["i", "up", "ended", "x", "p"])
                grown = key in now and (1 if key[1] else -1) * float(costs[key[0]] @ (got[0] - now[key])) > 1e-12 * (1 + abs(float(costs[key[0]] @ now[key])))
                ended = key in now and len(pts) == len(before)
                return pd.DataFrame([(*key, ended, got[0].tolist(), (pts[got[1]] if grown and len(pts) > HELD else pts).ravel().tolist())], columns=["i", "up", "ended", "x", "p"])

            # violated rows come from every task: FAN_IN groups of a candidate each hand on the outermost ones
            rows = m.mapInPandas(violated, "i int, up boolean, gap double, p array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
            rows = rows.groupBy("i", "up", "part").applyInPandas(narrowed, "i int, up boolean, gap double, p array<double>")
            rows = rows.groupBy("i", "up").applyInPandas(exchanged, "i int, up boolean, ended boolean, x array<double>, p array<double>").collect()
            open_ = set()
            for r in rows:
                key = (r["i"], r["up"])
                if len(r["x"]):
                    current[key], held[key] = np.array(r["x"]), np.array(r["p"]).reshape(-1, len(cands[key[0]].features) + 1)
                    if not r["ended"]:
                        open_.add(key)
                else:
                    current.pop(key, None)
        return [Fit(cands[i], up, tuple(float(x) for x in v[:-1]), float(v[-1]), n_rows[i]) for (i, up), v in sorted(current.items())]
    finally:
        m.unpersist()


@dataclass(frozen=True)
class Family:
    """A kind of form: its features from one or two invariants, and the limits that the rounded form has to keep."""

    name: str
    arity: int
    make: Callable[..., list[Expr]]
    den: int
    box: float
    most_coef: float
    most_intercept: float
    least_rows: int = 8
    ordered: bool = False
    repeat: bool = False
    log_target: bool = False


def _sq(x):
    return Un("square", x)


def _rt(x):
    return Un("sqrt", x)


#: The families and their parameters, by stage name.
FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        Family("lp1", 1, lambda x: [x], 20, FREE, 4, 8),
        Family("poly_single", 1, lambda x: [x, _sq(x)], 20, 4, 4, 8),
        Family("sqrt", 2, lambda x, y: [x, _rt(y)], 30, 10, 4, 8, ordered=True, repeat=True),
        Family("quad_sqrt", 2, lambda x, y: [_sq(x), _rt(y)], 30, 10, 4, 8, ordered=True, repeat=True),
        Family("log", 2, lambda x, y: [x, Log(y, 2, 1e-6)], 30, 10, 4, 8, ordered=True, repeat=True),
        Family("quad_log", 2, lambda x, y: [_sq(x), Log(y, 2, 1e-6)], 30, 10, 4, 8, ordered=True, repeat=True),
        Family("sqrt_log", 1, lambda x: [x, _rt(x), Log(x, None, 1e-6)], 30, 4, 4, 8),
        Family("sqrt_pair", 2, lambda x, y: [_rt(x), _rt(y)], 30, 4, 4, 8),
        Family("geom_mean", 2, lambda x, y: [x, _rt(x * y)], 30, 4, 4, 8),
        Family("sqrt_sum", 2, lambda x, y: [x, _rt(x + y)], 30, 4, 4, 8),
        Family("log_sum", 2, lambda x, y: [x, Log(x + y, None, 1e-6)], 30, 4, 4, 8),
        Family("exp", 2, lambda x, y: [Log(x, None, 1e-6), y * Log(x, None, 1e-6)], 30, 4, 4, 4, ordered=True, log_target=True),
    )
}
#: Subsets up to k features: k, denominator, box, limits.
SUBSETS = {"lp2": (2, 20, 10.0, 2.5), "lp3": (3, 20, 10.0, 2.5), "lp4": (4, 30, 10.0, 2.5)}


def _statements(fits: Sequence[Fit], target: Expr, features: Sequence[Expr], hyps: Sequence[Pred], den: int, most_coef: float, most_intercept: float, stage: str, wrap: bool = False) -> list[Statement]:
    out = []
    for f in fits:
        form = affine([(w, features[j]) for w, j in zip(f.weights, f.candidate.features, strict=True)], f.intercept, den, most_coef, most_intercept)
        if form is not None and form.terms:
            rhs = Un("exp", form) if wrap else form
            out.append(Statement(hyps[f.candidate.hyp], Compare("<=" if f.upper else ">=", target, rhs), stage=stage))
    return out


@dataclass(frozen=True)
class Forms:
    """Fits with the features that their candidates refer to and the limits of their rounded forms."""

    fits: list[Fit]
    features: list[Expr]
    den: int
    most_coef: float
    most_intercept: float
    wrap: bool = False


def family_fits(df: DataFrame, name: str, target: Expr, pool: Mapping[str, Expr], hyps: Sequence[Pred], nonneg: bool = False, solver: Callable = solve.lp, symmetric: bool = True) -> Forms:
    """The optima of one family over the pool; unordered pairs of invariants once, unless ``symmetric`` is off."""
    family = FAMILIES[name]
    items = list(pool.values())
    if family.arity == 1:
        groups = [(x,) for x in items]
    elif family.ordered or not symmetric:
        groups = [(x, y) for x in items for y in items if family.repeat or x != y]
    else:
        groups = list(combinations(items, 2))
    features: list[Expr] = []
    subsets = []
    for g in groups:
        made = family.make(*g)
        for e in made:
            if e not in features:
                features.append(e)
        subsets.append(tuple(features.index(e) for e in made))
    cands = [Candidate(h, s) for h in range(len(hyps)) for s in dict.fromkeys(subsets)]
    goal = Log(target) if family.log_target else target
    return Forms(fit(df, goal, features, hyps, cands, family.box, family.least_rows, nonneg, solver), features, family.den, family.most_coef, family.most_intercept, family.log_target)


def subset_fits(df: DataFrame, name: str, target: Expr, pool: Mapping[str, Expr], hyps: Sequence[Pred], solver: Callable = solve.lp) -> Forms:
    """Linear forms over all subsets of up to k features; each subset is solved once."""
    k, den, box, most = SUBSETS[name]
    features = list(pool.values())
    cands = [Candidate(h, s) for h in range(len(hyps)) for j in range(1, k + 1) for s in combinations(range(len(features)), j)]
    return Forms(fit(df, target, features, hyps, cands, box, solver=solver), features, den, most, most)


def family_statements(df: DataFrame, name: str, target: Expr, pool: Mapping[str, Expr], hyps: Sequence[Pred], nonneg: bool = False, solver: Callable = solve.lp, symmetric: bool = True) -> list[Statement]:
    """All forms of one family over the pool, rounded; not yet verified."""
    f = family_fits(df, name, target, pool, hyps, nonneg, solver, symmetric)
    return _statements(f.fits, target, f.features, hyps, f.den, f.most_coef, f.most_intercept, name, f.wrap)


def subset_statements(df: DataFrame, name: str, target: Expr, pool: Mapping[str, Expr], hyps: Sequence[Pred], solver: Callable = solve.lp) -> list[Statement]:
    """Linear forms over all subsets of up to k features, rounded; not yet verified."""
    f = subset_fits(df, name, target, pool, hyps, solver)
    return _statements(f.fits, target, f.features, hyps, f.den, f.most_coef, f.most_intercept, name)


#: What a generator is asked for: target, features, hypothesis.
Job = tuple[Expr, Sequence[Expr], Pred]


def free_lp_many(df: DataFrame, jobs: Sequence[Job]) -> list[list[Statement]]:
    """``free_lp`` of many jobs: one fit for each target."""
    out: list[list[Statement]] = [[] for _ in jobs]
    for target in dict.fromkeys(t for t, _, _ in jobs):
        own = [i for i, j in enumerate(jobs) if j[0] == target]
        features = list(dict.fromkeys(x for i in own for x in jobs[i][1]))
        hyps = list(dict.fromkeys(jobs[i][2] for i in own))
        cand = {i: Candidate(hyps.index(jobs[i][2]), tuple(features.index(x) for x in jobs[i][1])) for i in own}
        fits = fit(df, target, features, hyps, list(dict.fromkeys(cand.values())))
        made = [(f.candidate, s) for f in fits for s in _statements([f], target, features, hyps, 10**6, math.inf, math.inf, "linear_programming")]
        true = repaired(df, [s for _, s in made], 10**6)
        for i in own:
            out[i] = [s for (c, _), s in zip(made, true, strict=True) if c == cand[i]]
    return out


def free_lp(df: DataFrame, target: Expr, features: Sequence[Expr], hyp: Pred) -> list[Statement]:
    """The classic fit: free coefficients, kept as close fractions."""
    return free_lp_many(df, [(target, features, hyp)])[0]


def ratios_many(df: DataFrame, jobs: Sequence[Job], chunk: int = 150) -> list[list[Statement]]:
    """``ratios`` of many jobs: a pass for every ``chunk`` ratios."""
    asked = list(dict.fromkeys((t, x, h) for t, xs, h in jobs for x in xs))
    ends: dict[Job, tuple] = {}
    for lo in range(0, len(asked), chunk):
        part = asked[lo : lo + chunk]
        cols = []
        for i, (t, e, h) in enumerate(part):
            x = nf.only_finite(e.column())
            r = F.when(h.column(), nf.divide(nf.only_finite(t.column()), F.when(x != 0, x)))
            cols += [F.min(r).alias(f"lo{i}"), F.max(r).alias(f"hi{i}")]
        row = df.agg(*cols).first()
        ends |= {k: (row[f"lo{i}"], row[f"hi{i}"]) for i, k in enumerate(part)}
    out = []
    for t, xs, h in jobs:
        sides = [(op, c, e) for e in xs for op, c in zip((">=", "<="), ends[t, e, h], strict=True) if c is not None]
        out.append([Statement(h, Compare(op, t, Linear(Fraction(0), ((Fraction(c).limit_denominator(10**6), e),))), stage="ratios") for op, c, e in sides])
    return out


def ratios(df: DataFrame, target: Expr, features: Sequence[Expr], hyp: Pred) -> list[Statement]:
    """The classic ratio bounds, rows where the feature is not 0."""
    return ratios_many(df, [(target, features, hyp)])[0]


ratios.many = ratios_many
free_lp.many = free_lp_many


def rounded_ratios(df: DataFrame, target: Expr, features: Sequence[Expr], hyp: Pred) -> list[Statement]:
    """For an integer target: t >= ⌈c·x⌉ and t <= ⌊c·x⌋ of the ratio bounds, where these hold on every row."""
    from ..expr import ceil, floor

    made = []
    for s in ratios(df, target, features, hyp):
        c = s.conclusion
        made.append(Statement(hyp, Compare(c.op, target, ceil(c.b) if c.op == ">=" else floor(c.b)), stage="rounded_ratios"))
    return verified(df, made)


def hull_points(df: DataFrame, target: Expr, features: Sequence[Expr], hyp: Pred) -> DataFrame:
    """The rows of a hypothesis where all values are there: features f0, f1, .. and the target y."""
    m = _matrix(df, target, features, [hyp])
    return m.filter("h0").select(*[f"f{i}" for i in range(len(features))], "y").dropna()


def hull_statements(corners: np.ndarray, target: Expr, features: Sequence[Expr], hyp: Pred, tol: float = 1e-8) -> list[Statement]:
    """Bounds of the facets of the corners' hull, without side facets."""
    out = []
    for w, b, upper in solve.facets(corners, tol):
        form = affine(list(zip(w.tolist(), features, strict=True)), b, 10**6, math.inf, math.inf, exact=True)
        out.append(Statement(hyp, Compare("<=" if upper else ">=", target, form), stage="convex_hull"))
    return out


def convex_hull(df: DataFrame, target: Expr, features: Sequence[Expr], hyp: Pred, tol: float = 1e-8) -> list[Statement]:
    """Bounds from the hull's facets, found pass by pass (``hull.corners``); needs k + 2 rows, drops side facets.

    A degenerate set (fewer independent points) has no facets in the full
    space and gives no statement.
    """
    points = hull_points(df, target, features, hyp).persist()
    try:
        if points.count() < len(features) + 2:
            return []
        return hull_statements(hull.corners(points), target, features, hyp, tol)
    finally:
        points.unpersist()


def mixed(df: DataFrame, target: Expr, pool: Mapping[str, Expr], hyps: Sequence[Pred], squares: bool = False, weight: Fraction = Fraction(1, 2), den: int = 20, most: float = 4.0, least_rows: int = 8) -> list[Statement]:
    """w(c·x + d·√y), or with y² : of the plain form and its roundings the valid one nearest to the target."""
    from ..expr import ceil, floor

    items = [e for e in pool.values()]
    second = [(_sq if squares else _rt)(e) for e in items]
    t = nf.only_finite(target.column())
    rows = df
    groups: list[list[Statement]] = []
    for h in hyps:
        cols = []
        for i, e in enumerate([*items, *second]):
            x = nf.only_finite(e.column())
            cols += [F.min(F.when(x > 0, t / x)).alias(f"lo{i}"), F.max(F.when(x > 0, t / x)).alias(f"hi{i}"), F.count(F.when((x > 0) & t.isNotNull(), 1)).alias(f"n{i}"), F.count_if(x <= 0).alias(f"z{i}")]
        row = rows.filter(h.column()).agg(*cols).first()
        for i, x in enumerate(items):
            for j, y in enumerate(second):
                jj = len(items) + j
                if min(row[f"n{i}"], row[f"n{jj}"]) < least_rows or row[f"z{i}"] or row[f"z{jj}"]:
                    continue
                for op, end in ((">=", "lo"), ("<=", "hi")):
                    c, d = (Fraction(row[f"{end}{k}"]).limit_denominator(den) for k in (i, jj))
                    if abs(c) > most or abs(d) > most:
                        continue
                    whole = affine([(float(weight * c), x), (float(weight * d), y)], 0.0, 2 * den, math.inf, math.inf, exact=True)
                    if not whole.terms:
                        continue
                    p, q = Const(weight * c) * x, Const(weight * d) * y
                    variants = [whole, ceil(whole), ceil(p) + ceil(q) - 1] if op == ">=" else [whole, floor(whole), floor(p) + floor(q)]
                    groups.append([Statement(h, Compare(op, target, v), stage="mixed") for v in variants])
    found = evaluate(df, [s for g in groups for s in g])
    out, at = [], 0
    for g in groups:
        valid = [(found[at + i]["avg_slack"], i) for i in range(len(g)) if found[at + i]["violations"] == 0 and found[at + i]["avg_slack"] is not None]
        at += len(g)
        if valid:
            out.append(g[min(valid)[1]])
    return out


#: Shifts of a ratio's parts.
SHIFTS = (-2, -1, 1, 2)


def ratio_lift(df: DataFrame, target: Expr, x: Expr, slope: float, special: Pred, parent: Pred, pool: Mapping[str, Expr], const_tol: float = 1e-3, coeff_tol: float = 1e-3) -> list[Statement]:
    """Replace the slope of t <= c·x, found under ``special``, by a ratio of invariants that is about c there and bounds t under ``parent``.

    A ratio that is about c on all special rows is so on two of them: all
    ratios are looked at on two witness rows, as grids of numbers, and only
    those that pass are measured on the table.
    """
    items = list(pool.values())
    if not items:
        return []
    inner = df.filter(special.column()).select(*[nf.only_finite(e.column()).alias(f"v{i}") for i, e in enumerate(items)])
    key = F.struct(*[f"v{i}" for i in range(len(items))])
    ends = inner.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    witness = np.array([[np.nan if v is None else v for v in r] for r in (ends["a"], ends["b"]) if r is not None], float)
    if not len(witness):
        return []
    n, keep = len(items), []
    f, g = witness[:, :, None] + np.zeros((1, 1, n)), witness[:, None, :] + np.zeros((1, n, 1))
    off, one = ~np.eye(n, dtype=bool), np.eye(n, dtype=bool)
    with np.errstate(all="ignore"):
        grids = [((lambda p, q, a=a, b=b: (p + a) / (q + b)), (f + a) / (g + b), off) for a in (0, *SHIFTS) for b in (0, *SHIFTS)]
        grids += [((lambda p, q, a=a: Const(1) / (p + a)), 1 / (f + a), one) for a in (0, *SHIFTS)]
        grids += [(lambda p, q: Const(1) / (p + q), 1 / (f + g), off), (lambda p, q: p / (p + q), f / (f + g), off), (lambda p, q: (p + q) / q, (f + g) / g, off)]
    for make, grid, wanted in grids:
        # a value that is missing on a witness says nothing
        near = np.isnan(grid) | np.isinf(grid) | (np.abs(grid - slope) <= const_tol + coeff_tol)
        keep += [make(items[i], items[j]) for i, j in np.argwhere(near.all(axis=0) & wanted)]
    keep = list(dict.fromkeys(keep))
    passed = []
    for lo in range(0, len(keep), 150):
        part = keep[lo : lo + 150]
        cols = [c for i, e in enumerate(part) for c in (F.min(nf.only_finite(e.column())).alias(f"lo{i}"), F.max(nf.only_finite(e.column())).alias(f"hi{i}"))]
        row = df.filter(special.column()).agg(*cols).first()
        passed += [e for i, e in enumerate(part) if row[f"lo{i}"] is not None and row[f"hi{i}"] - row[f"lo{i}"] <= const_tol and abs((row[f"hi{i}"] + row[f"lo{i}"]) / 2 - slope) <= coeff_tol]
    lifted = [Statement(parent, Compare("<=", target, e * x), stage="ratio_lift") for e in passed]
    found = evaluate(df, lifted)
    return [s for i, s in enumerate(lifted) if found[i]["min_slack"] is not None and found[i]["min_slack"] >= -1e-8]


def holds(metrics: Mapping, tol: float = 1e-9) -> bool:
    """Whether a statement of these metrics holds, up to rounding, on every row of its hypothesis where it can be evaluated."""
    return metrics["min_slack"] is not None and metrics["min_slack"] >= -tol


def verified(df: DataFrame, statements: Sequence[Statement], tol: float = 1e-9) -> list[Statement]:
    """The statements that hold."""
    found = evaluate(df, list(statements))
    return [s for i, s in enumerate(statements) if holds(found[i], tol)]


def repaired(df: DataFrame, statements: Sequence[Statement], den: int = 20, most_intercept: float = math.inf, chunk: int = 100) -> list[Statement]:
    """Linear bounds with the intercept moved to the nearest fraction, outwards, that makes them true for their rounded slopes."""
    out = list(statements)
    linear = [i for i, s in enumerate(statements) if isinstance(s.conclusion, Compare) and isinstance(s.conclusion.b, Linear) and s.conclusion.op in ("<=", ">=")]
    for lo in range(0, len(linear), chunk):
        part = linear[lo : lo + chunk]
        cols = []
        for i in part:
            s = statements[i]
            rest = nf.only_finite(s.conclusion.a.column() - Linear(0, s.conclusion.b.terms).column())
            cols.append((F.max if s.conclusion.op == "<=" else F.min)(F.when(s.hypothesis.column(), rest)).alias(f"r{i}"))
        row = df.agg(*cols).first()
        for i in part:
            s, r = statements[i], row[f"r{i}"]
            if r is None:
                continue
            near = Fraction(r).limit_denominator(den)
            b = near if abs(float(near) - r) <= 1e-9 else Fraction(math.ceil(r * den) if s.conclusion.op == "<=" else math.floor(r * den), den)
            if abs(b) <= most_intercept:
                out[i] = Statement(s.hypothesis, Compare(s.conclusion.op, s.conclusion.a, Linear(b, s.conclusion.b.terms, s.conclusion.b.lenient)), s.name, s.stage)
    return out
