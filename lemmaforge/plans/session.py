"""Sessions: from a table to ranked statements."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import Col, Expr, Log, expr, resolve
from ..functions import numeric as nf
from ..operators import bounds, characterise, filters, fits, lattice, solve, statistics, sufficient
from ..pred import TRUE, Compare, Flag, Not, Pred, conj
from ..relation import Statement, evaluate, metrics_frame

log = logging.getLogger("lemmaforge")


class Stage(str, Enum):
    CONSTANT = "constant"
    RATIO = "ratio"
    LP1 = "lp1"
    SQRT = "sqrt"
    LOG = "log"
    SQRT_LOG = "sqrt_log"
    SQRT_PAIR = "sqrt_pair"
    GEOM_MEAN = "geom_mean"
    SQRT_SUM = "sqrt_sum"
    LOG_SUM = "log_sum"
    EXP = "exp"
    LP2 = "lp2"
    LP3 = "lp3"
    LP4 = "lp4"
    POLY = "poly_single"
    MIXED = "mixed"

    @classmethod
    def _missing_(cls, value):
        return _OTHER_NAMES.get(value) and cls(_OTHER_NAMES[value])


#: Names that a stage goes by as well.
_OTHER_NAMES = {"exp_exponent": "exp"}
#: Stages are run in the order of the enumeration, whatever order is asked for.
_BY_COMPLEXITY = [
    {Stage.CONSTANT},
    {Stage.RATIO, Stage.LP1},
    {Stage.LP2, Stage.POLY, Stage.SQRT, Stage.LOG},
    {Stage.LP3, Stage.SQRT_LOG},
    {Stage.MIXED, Stage.SQRT_PAIR, Stage.GEOM_MEAN, Stage.SQRT_SUM, Stage.LOG_SUM},
]
#: mode: complexity, pools (products, abs, min/max, log), quick.
MODES = {"fast": (1, (False, False, False, False), True), "standard": (2, (False, True, True, True), False), "deep": (3, (True, True, True, True), False)}


def stages_of(complexity: int) -> list[Stage]:
    wanted = set().union(*_BY_COMPLEXITY[: complexity + 1])
    return [s for s in Stage if s in wanted]


def known_stages(asked: Sequence[Stage | str], what: str = "stages") -> list[Stage]:
    """The stages of these names, each once, in the order in which they run; ValueError for a name that no stage has."""
    found = set()
    for x in asked:
        try:
            found.add(Stage(x))
        except ValueError:
            raise ValueError(f"no stage {x!r} in {what}; there are {', '.join(s.value for s in Stage)}") from None
    return [s for s in Stage if s in found]


@dataclass
class Result:
    target: str
    statements: list[tuple[Statement, dict]]
    conditions: list[sufficient.Condition]
    breakdown: dict[str, dict] = field(default_factory=dict)

    def frame(self, df: DataFrame) -> DataFrame:
        return metrics_frame(df, [s for s, _ in self.statements])

    def text(self, most: int | None = 20) -> str:
        """The first statements with their touches and supports, and the first conditions."""
        lines = [f"{i}. {s.label()}  [touches {m['touch']}, support {m['support']}]" for i, (s, m) in enumerate(self.statements[:most], 1)]
        return "\n".join([f"target: {self.target}", *lines, *(c.label() for c in self.conditions[:most])])


#: A table and statements to those that are kept.
Filter = Callable[[DataFrame, Sequence[Statement]], list[Statement]]
#: What a generator or stage may stop with: its own input does not suit it.  Errors of Spark or of the program pass.
OWN_ERRORS = (ValueError, ArithmeticError, KeyError, np.linalg.LinAlgError)


def safely(name: str, fn: Callable[[], list], into: dict) -> list:
    """Run one generator or stage; where its input does not suit it, that is logged and recorded in ``into``, and what came before stays."""
    try:
        return fn()
    except OWN_ERRORS as e:
        log.warning("%s stopped: %s", name, e)
        into.setdefault(name, {})["error"] = f"{type(e).__name__}: {e}"
        return []


def generated(name: str, df: DataFrame, jobs: Sequence[fits.Job], errors: dict) -> list[Statement]:
    """Statements of a registered generator for each job; at once where it can do many (``many``), else one after another."""
    fn = filters.GENERATORS[name]
    if hasattr(fn, "many"):
        return safely(name, lambda: [s for part in fn.many(df, jobs) for s in part], errors)
    out: list[Statement] = []
    for target, features, h in jobs:
        out += safely(f"{name}/{h.label()}/{', '.join(x.label() for x in features)}", lambda t=target, f=features, h=h: fn(df, t, f, h), errors)
    return out


class Session:
    """A table of objects with its flags, invariants, hypotheses and feature pools."""

    def __init__(self, df: DataFrame, max_arity: int = 2, exclude: Sequence[str] = ("name", "Unnamed: 0"), min_touches: int = 3, settings: sufficient.Settings = sufficient.Settings(), use_morgan: bool = False, use_dalmatian: bool = False, classic_dalmatian: bool = False, lp1_nonneg: bool = False, symmetric: bool = True, solver: Callable = solve.lp, generality: Filter | None = None, significance: Filter | None = None):
        """``generality`` and ``significance`` are callables (table, statements) -> statements that stand in for
        ``filters.morgan`` and ``filters.dalmatian``, and switch that step on.
        ``classic_dalmatian`` compares a bound with all others of its group instead of those before it; ``lp1_nonneg``
        and ``symmetric`` are options of the fits, ``solver`` stands in for their linear programs.
        """
        self._original = self.df = df
        self.lp1_nonneg, self.symmetric, self.solver = lp1_nonneg, symmetric, solver
        self.errors: dict[str, dict] = {}
        self.max_arity, self.exclude, self.min_touches, self.settings = max_arity, exclude, min_touches, settings
        sharpest = filters.dalmatian_batch if classic_dalmatian else filters.dalmatian
        self.generality = generality or (filters.morgan if use_morgan else None)
        self.significance = significance or (sharpest if use_dalmatian else None)
        self.refresh()

    def refresh(self) -> None:
        self.flags, _ = lattice.partition(self.df, self.exclude)
        numeric, _ = lattice.classify(self.df, self.exclude)
        self.invariants: dict[str, Expr] = {c: Col(c) for c in numeric}
        self.lattice = lattice.Lattice(self.df, self.flags)
        self.hypotheses = self.lattice.driver(self.max_arity)

    # what the session knows
    @property
    def expr_columns(self) -> list[str]:
        """The numeric columns that are invariants."""
        return list(self.invariants)

    @property
    def exprs(self) -> dict[str, Expr]:
        """Invariants by name, derived ones that were registered among them."""
        return dict(self.invariants)

    @property
    def base_predicates(self) -> dict[str, Pred]:
        """The flags by name."""
        return {f.label(): f for f in self.flags}

    def register(self, preds: Sequence[Pred] = ()) -> list[lattice.Hypothesis]:
        """Further predicates as flags; the hypotheses are then one of each group of equal selections that lies in no other but the base."""
        known = {f.label() for f in self.flags}
        self.lattice = lattice.Lattice(self.df, [*self.flags, *(p for p in preds if p.label() not in known)])
        found = self.lattice.conjunctions(self.max_arity)
        self.hypotheses = [found[0], *self.lattice.register([h for h in found[1:] if self.lattice.cover(h) and self.lattice.cover(h) != self.lattice.cover(found[0])])]
        return self.hypotheses

    def equality_classes(self, top: int = 20, least_rate: float = 0.10, least_support: float = 0.05) -> list[tuple[str, Pred]]:
        """Predicates invariant = c · invariant that many rows of the base meet, most often met first."""
        table = statistics.ratio_table(self.df, self.invariants, self.lattice.base.pred, least_support)
        return statistics.equality_classes(table, self.invariants, top, least_rate)

    def meaningful_features(self, top: int = 20) -> dict[str, Expr]:
        """|a - b|, min and max of the pairs whose incomparability means something; they become invariants."""
        report = statistics.meaningful(statistics.incomparability(self.df, self.invariants, self.lattice.base.pred))
        made = statistics.pair_features(report, self.invariants, top)
        self.invariants |= made
        return made

    def characterise(self, tol: float = 0.0) -> list[characterise.Characterisation]:
        """Constant columns of each hypothesis that is no redundant conjunction, and whether they characterise it."""
        hyps = self.lattice.conjunctions(self.max_arity)
        gone = {h.seq for h, _ in self.lattice.redundant(hyps)}
        return characterise.characterise(self.df, self.lattice, [h for h in hyps if h.seq not in gone and self.lattice.cover(h)], {n: e for n, e in self.invariants.items()}, tol)

    def prune(self, statements: Sequence[Statement]) -> list[tuple[Pred, list[Statement]]]:
        """Statements by what their hypotheses select, without weaker ones of one form."""
        return filters.merged_by_hypothesis(self.df, statements)

    # columns by name
    def expr(self, name: str) -> Expr:
        return resolve(name, self.df.columns)

    def pred(self, name: str) -> Flag:
        for f in self.flags:
            if f.name == name:
                return f
        raise KeyError(name)

    def __getattr__(self, name: str):
        if name.startswith("_") or "df" not in self.__dict__ or name not in self.df.columns:
            raise AttributeError(name)
        kind = dict(self.df.dtypes)[name]
        return Flag(name) if kind == "boolean" else Col(name)

    # mutations make new tables
    def append_row(self, row: Mapping) -> None:
        new = self.df.sparkSession.createDataFrame([tuple(row.get(c) for c in self.df.columns)], self.df.schema)
        self.df = self.df.unionByName(new)
        self.refresh()

    def reset(self, df: DataFrame | None = None) -> None:
        self.df = self._original if df is None else df
        self.refresh()

    def convert_columns(self, how: Mapping[str, Callable]) -> None:
        self.df = self.df.withColumns({c: fn(F.col(f"`{c}`")) for c, fn in how.items()})
        self.refresh()

    def pool(self, target: str, products: bool = False, absolute: bool = False, extremes: bool = False, logs: bool = False, quick: bool = False) -> dict[str, Expr]:
        """Features for a target: invariants and derived ones, none that refers to the target itself."""
        base = {n: e for n, e in self.invariants.items() if n != target}
        out = dict(base)
        if products:
            for a, b in [*combinations(base.values(), 2), *((e, e) for e in base.values())]:
                e = a * b if a != b else a**2
                out[e.label()] = e
        if absolute or extremes:
            report = statistics.noncomparable(self.df, base, self.lattice.base.pred)
            for e in statistics.pair_features(report, base, most=None).values():
                if (e.label().startswith("abs") and absolute) or (not e.label().startswith("abs") and extremes):
                    out[e.label()] = e
        if logs and base:
            row = self.df.agg(*[F.min(nf.only_finite(e.column())).alias(f"m{i}") for i, e in enumerate(base.values())]).first()
            for i, e in enumerate(base.values()):
                if row[i] is not None and row[i] > 1:
                    out[Log(e).label()] = Log(e)
        out = {n: e for n, e in out.items() if target not in e.columns()}
        if quick:
            kept = [r["feature"] for r in statistics.correlations(self.df, self.expr(target), out).collect()]
            out = {n: out[n] for n in kept}
        return out

    def run_stage(self, stage: Stage, target: Expr, pool: Mapping[str, Expr]) -> list[Statement]:
        hyps = [h.pred for h in self.hypotheses]
        if stage is Stage.CONSTANT:
            return bounds.constant_statements(self.df, self.lattice, self.hypotheses, target)
        if stage is Stage.RATIO:
            return bounds.ratio_statements(self.df, self.lattice, self.hypotheses, target, pool)
        if stage is Stage.MIXED:
            plain = {n: e for n, e in self.invariants.items() if e != target}
            return [*fits.mixed(self.df, target, plain, hyps), *fits.mixed(self.df, target, plain, hyps, squares=True)]
        if stage.value in fits.SUBSETS:
            return fits.subset_statements(self.df, stage.value, target, pool, hyps, self.solver)
        out = fits.family_statements(self.df, stage.value, target, pool, hyps, self.lp1_nonneg and stage is Stage.LP1, self.solver, self.symmetric)
        if stage in (Stage.SQRT, Stage.LOG):
            out += fits.family_statements(self.df, f"quad_{stage.value}", target, pool, hyps, solver=self.solver)
        return out

    def conjecture(self, targets: str | Sequence[str], mode: str | None = None, complexity: int | None = None, stages: Sequence[Stage] | None = None, quick: bool | None = None, with_conditions: bool = True, verify: bool = True, condition_stages: Sequence[Stage | str] | None = None, show: int | None = None, **pools) -> Result:
        """Ranked statements about each target, and sufficient conditions for the flags.

        Within a stage: generate, verify, touch filter, generality,
        significance, order; across stages only duplicates go.  Conditions come
        from the statements of ``condition_stages``, of all stages where that is
        not given; ``show`` prints so many statements.  The table is kept for
        the passes over it, unless the caller keeps it already.
        """
        wanted = known_stages(stages) if stages is not None else None
        of_conditions = set(Stage) if condition_stages is None else set(known_stages(condition_stages, "condition_stages"))
        if mode is not None and mode not in MODES:
            raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
        own = not (self.df.storageLevel.useMemory or self.df.storageLevel.useDisk)
        if own:
            self.df.persist()
        try:
            out = self._conjecture(targets, mode, complexity, wanted, quick, of_conditions if with_conditions else set(), verify, pools)
        finally:
            if own:
                self.df.unpersist()
        if show is not None:
            print(out.text(show))
        return out

    def _conjecture(self, targets, mode, complexity, wanted, quick, of_conditions, verify, pools) -> Result:
        level, default_pools, default_quick = MODES[mode or "standard"]
        level = level if complexity is None else complexity
        wanted = wanted or stages_of(level)
        names = [targets] if isinstance(targets, str) else list(targets)
        every: list[Statement] = []
        conditions: list[sufficient.Condition] = []
        breakdown: dict[str, dict] = {}
        known: dict[Statement, dict] = {}
        for name in names:
            target = self.expr(name)
            use = dict(zip(("products", "absolute", "extremes", "logs"), default_pools, strict=True)) | pools
            pool = self.pool(name, quick=default_quick if quick is None else quick, **use)
            for stage in wanted:
                made = filters.unique(safely(f"{name}/{stage.value}", lambda s=stage, t=target, p=pool: self.run_stage(s, t, p), breakdown))
                kept = filters.unique(fits.repaired(self.df, made)) if verify and stage is not Stage.RATIO else made
                # one pass measures a stage's statements; what follows reads its figures
                known |= {s: m for s, m in zip(kept, evaluate(self.df, kept).values(), strict=True)}
                if verify:
                    kept = [s for s in kept if fits.holds(known[s])]
                if stage not in (Stage.POLY, Stage.MIXED):
                    kept = [s for s, _ in filters.ranked(self.df, kept, "touch", self.min_touches, known)]
                for step in filter(None, (self.generality, self.significance)):
                    kept = step(self.df, kept)
                breakdown.setdefault(f"{name}/{stage.value}", {}).update(made=len(made), kept=len(kept))
                if stage in of_conditions and kept:
                    conditions += sufficient.discover(self.df, self.flags, kept, self.lattice.base.pred, self.settings)
                every += kept
        every = filters.unique(every)
        return Result(",".join(names), filters.ranked(self.df, every, known=known), sufficient.rank(conditions), breakdown)

    # interactive discovery
    def generate(self, methods: Sequence[str] | None = None, features: Sequence = (), target=None, hypotheses: Sequence[Pred | str] = (), heuristics: Sequence[Callable] = (), post: Sequence[str | Callable] = (), base: Pred = TRUE) -> list[Statement]:
        """Statements of the named generators under base ∧ each hypothesis; heuristics accept one after another, post-processors follow."""
        methods = list(filters.GENERATORS) if methods is None else methods
        unknown = [m for m in methods if m not in filters.GENERATORS]
        if unknown:
            raise KeyError(f"no such generator: {unknown}")
        feats = [self.expr(f) if isinstance(f, str) else expr(f) for f in features]
        goal = self.expr(target) if isinstance(target, str) else expr(target)
        hyps = [conj([base, self.pred(h) if isinstance(h, str) else h]) for h in (hypotheses or [TRUE])]
        kept: list[Statement] = []
        for m in methods:
            for s in generated(m, self.df, [(goal, feats, h) for h in hyps], self.errors):
                if all(accept(self.df, s, kept) for accept in heuristics):
                    kept.append(s)
        for p in post:
            kept = (filters.POST[p] if isinstance(p, str) else p)(kept, self.df)
        return kept

    def discover(self, **options) -> list[Statement]:
        """Generated statements, preceded by the equalities that pairs of them give."""
        found = self.generate(**options)
        return [*filters.strengthened(found), *found]

    def discover_equalities(self, methods: Sequence[str] | None = None, min_fraction: float = 0.15) -> list[Pred]:
        """L == R for generated bounds that are reached on at least that share of all rows; largest support first."""
        pairs = [(a, b) for a in self.invariants.values() for b in self.invariants.values() if a != b]
        made = []
        for m in methods or ["ratios"]:
            made += generated(m, self.df, [(a, [b], TRUE) for a, b in pairs], self.errors)
        found = evaluate(self.df, made)
        n = max(1, self.lattice.n)
        rows = sorted(((found[i]["touch_all"] or 0, i) for i in range(len(made)) if (found[i]["touch_all"] or 0) / n >= min_fraction), key=lambda r: (-r[0], r[1]))
        return [Compare("==", made[i].conclusion.a, made[i].conclusion.b) for _, i in rows]


for _name, _fn in (("ratios", fits.ratios), ("rounded_ratios", fits.rounded_ratios), ("convex_hull", fits.convex_hull), ("linear_programming", fits.free_lp)):
    filters.register(filters.GENERATORS, _name)(_fn)


@filters.register(filters.PIPELINES)
def necessary_bounds(df: DataFrame, target: str, methods: Sequence[str] = ("ratios", "linear_programming"), feature_size: int = 1, include_true: bool = False, errors: dict | None = None) -> list[Statement]:
    """All feature combinations under each boolean column: duplicates, significance, generality and order, equalities last.

    Generators whose input does not suit them are logged, and recorded in ``errors``.
    """
    numeric, boolean = lattice.classify(df)
    hyps: list[Pred] = [*(TRUE,) * include_true, *(Flag(b) for b in boolean)]
    return _packaged(df, target, methods, feature_size, numeric, hyps, True, errors)


@filters.register(filters.PIPELINES)
def sufficient_conditions(df: DataFrame, target: str, methods: Sequence[str] = ("ratios",), feature_size: int = 1, errors: dict | None = None) -> list[Statement]:
    """Bounds under negated columns, turned round: whenever the bound fails the column holds; each has to cover something new."""
    numeric, boolean = lattice.classify(df)
    found = _packaged(df, target, methods, feature_size, numeric, [Not(Flag(b)) for b in boolean], False, errors)
    kept: list[Statement] = []
    for s in filters.contrapositives(found):
        if filters.sophie_accept(df, s, kept):
            kept.append(s)
    return kept


def _packaged(df, target, methods, feature_size, numeric, hyps, finish, errors):
    made: list[Statement] = []
    errors = {} if errors is None else errors
    jobs = [(Col(target), [Col(c) for c in combo], h) for combo in combinations([c for c in numeric if c != target], feature_size) for h in hyps]
    for m in methods:
        made += generated(m, df, jobs, errors)
    kept = filters.morgan(df, filters.dalmatian_batch(df, filters.unique(made)))
    kept = [s for s, _ in filters.ranked(df, kept, "touch_all")]
    if not finish:
        return kept
    equal, rest = filters.equalities(df, kept)
    return [s for s, _ in filters.ranked(df, [*rest, *equal], "touch_all")]
