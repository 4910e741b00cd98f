"""Bounds from extrema: constants and ratios, once per (signature, feature) and rolled up to all hypotheses."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import Const, Expr, Linear
from ..functions import numeric as nf
from ..pred import Compare
from ..relation import Statement
from .lattice import Hypothesis, Lattice, signature


def long_form(df: DataFrame, lattice: Lattice, features: Mapping[str, Expr], target: Expr | None = None) -> DataFrame:
    """sig, feature, x, t for finite values."""
    listed = F.array(*[F.struct(F.lit(n).alias("feature"), nf.only_finite(e.column()).alias("x")) for n, e in features.items()]).cast("array<struct<feature:string,x:double>>")
    t = nf.only_finite(target.column()) if target is not None else F.lit(0.0)
    rows = df.select(signature(lattice.flags).alias("sig"), t.alias("t"), F.explode(listed).alias("f"))
    return rows.select("sig", "t", "f.feature", "f.x").filter("x IS NOT NULL AND t IS NOT NULL")


def constant_bounds(df: DataFrame, lattice: Lattice, hyps: Sequence[Hypothesis], targets: Mapping[str, Expr]) -> DataFrame:
    """hypothesis, feature, support, low (floor of the least), high (ceiling of the largest)."""
    cube = long_form(df, lattice, targets).groupBy("sig", "feature").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    out = lattice.roll_up(cube, hyps).groupBy("hypothesis", "feature").agg(F.sum("n").alias("support"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.select("hypothesis", "feature", "support", F.floor("low").alias("low"), F.ceil("high").alias("high"))


def ratio_bounds(df: DataFrame, lattice: Lattice, hyps: Sequence[Hypothesis], target: Expr, features: Mapping[str, Expr], positive: bool = False) -> DataFrame:
    """hypothesis, feature, support, cmin, cmax of target / feature where the feature is not 0 (or is positive)."""
    rows = long_form(df, lattice, features, target).filter("x > 0" if positive else "x <> 0").withColumn("r", F.col("t") / F.col("x"))
    cube = rows.groupBy("sig", "feature").agg(F.count("*").alias("n"), F.min("r").alias("cmin"), F.max("r").alias("cmax"))
    return lattice.roll_up(cube, hyps).groupBy("hypothesis", "feature").agg(F.sum("n").alias("support"), F.min("cmin").alias("cmin"), F.max("cmax").alias("cmax"))


def ratio_touches(df: DataFrame, lattice: Lattice, hyps: Sequence[Hypothesis], target: Expr, features: Mapping[str, Expr], positive: bool = False) -> DataFrame:
    """Ratio bounds with how often each end is reached.

    The reaching rows are counted per (sig, feature, ratio) only where the
    ratio is an end of some hypothesis: the ends go to the rows by a join with
    the catalog of bounds, which has hypotheses x features rows.  ``df`` is
    computed for both, so its values have to be the same each time: sums of
    doubles by ``numeric.steady_sum``.
    """
    bounds = ratio_bounds(df, lattice, hyps, target, features, positive)
    ends = bounds.select("feature", F.explode(F.array("cmin", "cmax")).alias("r")).distinct()
    rows = long_form(df, lattice, features, target).filter("x > 0" if positive else "x <> 0").withColumn("r", F.col("t") / F.col("x"))
    # hypotheses x features rows, both from the caller's lists
    at = rows.join(F.broadcast(ends), ["feature", "r"]).groupBy("sig", "feature", "r").agg(F.count("*").alias("n"))
    at = lattice.roll_up(at, hyps).groupBy("hypothesis", "feature", "r").agg(F.sum("n").alias("n"))
    both = bounds.join(at, ["hypothesis", "feature"], "left").groupBy("hypothesis", "feature", "support", "cmin", "cmax")
    return both.agg(F.coalesce(F.sum(F.when(F.col("r") == F.col("cmin"), F.col("n"))), F.lit(0)).alias("touch_lower"), F.coalesce(F.sum(F.when(F.col("r") == F.col("cmax"), F.col("n"))), F.lit(0)).alias("touch_upper"))


def constant_columns(df: DataFrame, lattice: Lattice, hyps: Sequence[Hypothesis], columns: Mapping[str, Expr], tol: float = 0.0) -> DataFrame:
    """hypothesis, feature, value: columns of one value (or a range up to tol: its middle) under a hypothesis."""
    cube = long_form(df, lattice, columns).groupBy("sig", "feature").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    out = lattice.roll_up(cube, hyps).groupBy("hypothesis", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return out.filter(F.col("high") - F.col("low") <= tol).select("hypothesis", "feature", ((F.col("low") + F.col("high")) / 2).alias("value"))


def constant_statements(df: DataFrame, lattice: Lattice, hyps: Sequence[Hypothesis], target: Expr) -> list[Statement]:
    by = {h.label(): h for h in hyps}
    out = []
    for r in sorted(constant_bounds(df, lattice, hyps, {"t": target}).collect(), key=lambda r: by[r["hypothesis"]].seq):
        h = by[r["hypothesis"]].pred
        out += [Statement(h, Compare(">=", target, Const(int(r["low"]))), stage="constant"), Statement(h, Compare("<=", target, Const(int(r["high"]))), stage="constant")]
    return out


def ratio_statements(df: DataFrame, lattice: Lattice, hyps: Sequence[Hypothesis], target: Expr, features: Mapping[str, Expr], den: int = 20, most: float = 4.0, least_support: int = 5) -> list[Statement]:
    """target >= c·x and target <= C·x with rational c, C: the nearest fraction with a denominator up to ``den``, or where that cuts into the bound the nearest outward one."""
    by = {h.label(): h for h in hyps}
    order = {n: i for i, n in enumerate(features)}
    out = []
    for r in sorted(ratio_bounds(df, lattice, hyps, target, features, positive=True).collect(), key=lambda r: (by[r["hypothesis"]].seq, order[r["feature"]])):
        if r["support"] < least_support:
            continue
        x = features[r["feature"]]
        for op, c in ((">=", r["cmin"]), ("<=", r["cmax"])):
            q = outward(c, op == "<=", den)
            if abs(c) <= most and q:
                out.append(Statement(by[r["hypothesis"]].pred, Compare(op, target, Linear(Fraction(0), ((q, x),))), stage="ratio"))
    return out


def rational(value: float, den: int = 20) -> Fraction:
    """The nearest fraction of a denominator up to ``den``."""
    return Fraction(value).limit_denominator(den) if math.isfinite(value) else Fraction(0)


def outward(value: float, up: bool, den: int = 20) -> Fraction:
    """The nearest fraction of a denominator up to ``den`` if it is not below (above) the value by more than rounding, else the least above (largest below)."""
    near = rational(value, den)
    if not math.isfinite(value) or (near >= Fraction(value) - Fraction(1, 10**9) if up else near <= Fraction(value) + Fraction(1, 10**9)):
        return near
    if up:
        return min(Fraction(math.ceil(Fraction(value) * q), q) for q in range(1, den + 1))
    return max(Fraction(math.floor(Fraction(value) * q), q) for q in range(1, den + 1))
