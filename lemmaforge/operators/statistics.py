"""Statistics over columns and pairs of columns: each operator is one aggregation over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expr import Expr, extreme
from ..functions import numeric as nf
from ..pred import TRUE, Pred


def _unpivot(agg: DataFrame, keys: Sequence[tuple], names: Sequence[str], head: Sequence[str]) -> DataFrame:
    """A one-row aggregate of columns name_i as a row per key."""
    items = [F.struct(*[F.lit(k).alias(h) for k, h in zip(key, head, strict=True)], *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, key in enumerate(keys)]
    return agg.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def correlations(df: DataFrame, target: Expr, features: Mapping[str, Expr], least: float = 0.1, least_rows: int = 5, most: int | None = 200, base: Pred = TRUE) -> DataFrame:
    """feature, n, corr of the features whose correlation with the target is ``least`` or more in size, largest first.

    Sums of products centred at the columns' means, over rows where both are
    finite; constant columns have no correlation and go.
    """
    t = nf.only_finite(target.column())
    rows = df.filter(base.column()).select(t.alias("t"), F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), nf.only_finite(e.column()).alias("x")) for n, e in features.items()])).alias("f")).select("t", "f.*").filter("t IS NOT NULL AND x IS NOT NULL")
    # Spark's corr is a mergeable one-pass aggregate; features without spread are left out before it could divide by zero
    stats = rows.groupBy("feature").agg(F.count("*").alias("n"), F.covar_pop("x", "t").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("t").alias("st"))
    found = stats.select("feature", "n", F.try_divide(F.col("c"), F.col("sx") * F.col("st")).alias("corr")).filter((F.col("n") >= least_rows) & (F.abs("corr") >= least))
    found = found.orderBy(F.desc(F.abs("corr")), "feature")
    return found.limit(most) if most else found


def noncomparable(df: DataFrame, features: Mapping[str, Expr], base: Pred = TRUE) -> DataFrame:
    """a, b: pairs where some row has a < b and some a > b."""
    pairs = list(combinations(features, 2))
    cols = []
    for i, (a, b) in enumerate(pairs):
        x, y = nf.only_finite(features[a].column()), nf.only_finite(features[b].column())
        cols += [F.coalesce(F.bool_or(x < y), F.lit(False)).alias(f"below_{i}"), F.coalesce(F.bool_or(x > y), F.lit(False)).alias(f"above_{i}")]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string")
    return _unpivot(df.filter(base.column()).agg(*cols), pairs, ["below", "above"], ["a", "b"]).filter("below AND above").select("a", "b")


def medians(df: DataFrame, columns: Mapping[int, Column], accuracy: int = 10_000, most: int = 50_000) -> dict[int, float | None]:
    """The exact median of each column, by brackets from quantile sketches.

    A sketch gives two values around a middle rank, and one pass counts the
    rows before, at, between and behind them: either the rank's value is found,
    or some thousandth of the rows is left, without the two values.  So it goes
    on until no more than ``most`` rows are left in all; these are sorted.
    """
    named = {i: f"x{i}" for i in columns}
    if not named:
        return {}
    df = df.select(*[nf.only_finite(c.cast("double")).alias(named[i]) for i, c in columns.items()])
    size = df.agg(*[F.count(n).alias(n) for n in named.values()]).first()
    #: By column and rank (from 0): the rows of interest lie strictly between two values; rows up to the first of them, and rows between.
    open_ = {(i, r): (-float("inf"), float("inf"), 0, size[n]) for i, n in named.items() if size[n] for r in {(size[n] - 1) // 2, size[n] // 2}}
    found: dict[tuple[int, int], float] = {}
    while sum(x[3] for x in open_.values()) > most:
        keys = list(open_)
        inner = [F.when((F.col(named[i]) > open_[i, r][0]) & (F.col(named[i]) < open_[i, r][1]), F.col(named[i])) for i, r in keys]
        share = [(r - open_[i, r][2] + 0.5) / open_[i, r][3] for i, r in keys]
        ends = df.agg(*[F.percentile_approx(x, [max(0.0, f - 2 / accuracy), min(1.0, f + 2 / accuracy)], accuracy).alias(f"q{j}") for j, (x, f) in enumerate(zip(inner, share, strict=True))]).first()
        counts = [c.alias(f"{name}{j}") for j, x in enumerate(inner) for a, b in [ends[f"q{j}"]] for name, c in (("a", F.count_if(x < a)), ("b", F.count_if(x == a)), ("c", F.count_if((x > a) & (x < b))), ("d", F.count_if((x == b) & (x > a))))]
        row = df.agg(*counts).first()
        for j, (i, r) in enumerate(keys):
            (a, b), (lo, hi, below, inside) = ends[f"q{j}"], open_.pop((i, r))
            parts = [(lo, a, row[f"a{j}"]), (a, None, row[f"b{j}"]), (a, b, row[f"c{j}"]), (b, None, row[f"d{j}"])]
            parts.append((b, hi, inside - sum(x[2] for x in parts)))
            for low, high, n in parts:
                if r < below + n:
                    if high is None:
                        found[i, r] = low
                    else:
                        open_[i, r] = (low, high, below, n)
                    break
                below += n
    if open_:
        keys = list(open_)
        rows = df.select(F.explode(F.filter(F.array(*[F.when((F.col(named[i]) > open_[i, r][0]) & (F.col(named[i]) < open_[i, r][1]), F.struct(F.lit(j).alias("j"), F.col(named[i]).alias("x"))) for j, (i, r) in enumerate(keys)]), lambda v: v.isNotNull())).alias("v")).select("v.*")
        for x in rows.groupBy("j", "x").agg(F.count("*").alias("n")).orderBy("j", "x").collect():
            key = keys[x["j"]]
            if key in open_:
                lo, hi, below, n = open_[key]
                if key[1] < below + x["n"]:
                    found[key] = x["x"]
                    del open_[key]
                else:
                    open_[key] = (lo, hi, below + x["n"], n)
    return {i: (found[i, (size[n] - 1) // 2] + found[i, size[n] // 2]) / 2 if size[n] else None for i, n in named.items()}


def incomparability(df: DataFrame, features: Mapping[str, Expr], base: Pred = TRUE, exact_median: bool = True) -> DataFrame:
    """Per pair: support, below, above, equal, their rates, balance, median and mean gap; most balanced first."""
    pairs = list(combinations(features, 2))
    names = {n: f"v{i}" for i, n in enumerate(features)}
    value = lambda n: F.col(names[n])
    # the features alone, kept for the passes over them
    rows = df.filter(base.column()).select(*[nf.only_finite(e.column()).alias(names[n]) for n, e in features.items()])
    rows = rows.persist() if exact_median and pairs else rows
    cols = []
    for i, (a, b) in enumerate(pairs):
        x, y = value(a), value(b)
        gap = F.abs(x - y)
        mid = F.lit(None).cast("double") if exact_median else F.percentile_approx(gap, 0.5, 10_000)
        cols += [F.count(gap).alias(f"support_{i}"), F.count_if(x < y).alias(f"below_{i}"), F.count_if(x > y).alias(f"above_{i}"), F.count("*").alias(f"n_{i}"), mid.alias(f"median_gap_{i}"), F.avg(gap).alias(f"mean_gap_{i}")]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, support long, below long, above long, n long, median_gap double, mean_gap double, rate_below double, rate_above double, balance double")
    counted = rows.agg(*cols)
    if exact_median:  # one row, taken while the features are kept
        counted = df.sparkSession.createDataFrame([counted.first()], counted.schema)
    out = _unpivot(counted, pairs, ["support", "below", "above", "n", "median_gap", "mean_gap"], ["a", "b"])
    out = out.withColumns({"rate_below": F.coalesce(F.try_divide(F.col("below"), F.col("support")), F.lit(0.0)), "rate_above": F.coalesce(F.try_divide(F.col("above"), F.col("support")), F.lit(0.0))})
    out = out.withColumn("balance", F.least("rate_below", "rate_above"))
    if exact_median:
        exact = medians(rows, {i: F.abs(value(a) - value(b)) for i, (a, b) in enumerate(pairs)})
        rows.unpersist()
        known = df.sparkSession.createDataFrame([(a, b, exact[i]) for i, (a, b) in enumerate(pairs)], "a string, b string, exact double")
        out = out.join(F.broadcast(known), ["a", "b"]).withColumn("median_gap", F.col("exact")).drop("exact")  # a row per pair of the caller's features
    return out.orderBy(F.desc("balance"), F.desc(F.least("below", "above")), F.desc("support"), "a", "b")


def meaningful(report: DataFrame, least_rate: float = 0.10, least_side: int = 5, least_support: float = 0.10, least_gap: float = 0.5) -> DataFrame:
    """Pairs of an incomparability report whose two sides both count for something."""
    return report.filter((F.col("balance") >= least_rate) & (F.least("below", "above") >= least_side) & (F.col("support") >= least_support * F.col("n")) & ((F.col("median_gap") >= least_gap) | (F.col("mean_gap") >= least_gap)))


def pair_features(report: DataFrame, features: Mapping[str, Expr], most: int | None = 20) -> dict[str, Expr]:
    """|a - b|, min and max of the pairs, of the first ``most`` where it is given."""
    out: dict[str, Expr] = {}
    for r in (report if most is None else report.limit(most)).collect():
        a, b = features[r["a"]], features[r["b"]]
        for e in (abs(a - b), extreme("min", a, b), extreme("max", a, b)):
            out[e.label()] = e
    return out


def ratio_table(df: DataFrame, features: Mapping[str, Expr], where: Pred = TRUE, least_support: float = 0.01, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """num, den, support, cmin, cmax, touch_min, touch_max and rates of all ordered pairs with a positive denominator.

    Two passes: bounds, then counts of the rows that reach them.
    """
    pairs = list(permutations(features, 2))
    rows = df.filter(where.column())
    ratio = {}
    for a, b in pairs:
        x, y = nf.only_finite(features[a].column()), nf.only_finite(features[b].column())
        ratio[a, b] = F.when(y > 0, x / y)
    cols = [c for i, p in enumerate(pairs) for c in (F.count(ratio[p]).alias(f"support_{i}"), F.min(ratio[p]).alias(f"cmin_{i}"), F.max(ratio[p]).alias(f"cmax_{i}"))]
    first = rows.agg(F.count("*").alias("n"), *cols).first()
    kept = [(i, p) for i, p in enumerate(pairs) if first[f"support_{i}"] and first[f"support_{i}"] >= least_support * first["n"]]
    schema = "num string, den string, support long, cmin double, cmax double, touch_min long, touch_max long, rate_min double, rate_max double"
    if not kept:
        return df.sparkSession.createDataFrame([], schema)
    near = lambda c, v: F.count_if(F.abs(c - v) <= atol + rtol * abs(v))
    second = rows.agg(*[c for i, p in kept for c in (near(ratio[p], first[f"cmin_{i}"]).alias(f"a{i}"), near(ratio[p], first[f"cmax_{i}"]).alias(f"b{i}"))]).first()
    return df.sparkSession.createDataFrame([(a, b, n := first[f"support_{i}"], first[f"cmin_{i}"], first[f"cmax_{i}"], second[f"a{i}"], second[f"b{i}"], second[f"a{i}"] / n, second[f"b{i}"] / n) for i, (a, b) in kept], schema)


def equality_classes(table: DataFrame, features: Mapping[str, Expr], top: int = 20, least_rate: float = 0.10) -> list[tuple[str, Pred]]:
    """Predicates num = c·den where a ratio table's better side is reached often."""
    from ..expr import Const
    from ..pred import Compare

    better = F.col("rate_min") >= F.col("rate_max")
    best = table.select("num", "den", F.when(better, F.col("cmin")).otherwise(F.col("cmax")).alias("c"), F.greatest("rate_min", "rate_max").alias("rate"))
    rows = best.filter(F.col("rate") >= least_rate).orderBy(F.desc("rate"), "num", "den").limit(top).collect()
    out = []
    for r in rows:
        p = Compare("==", features[r["num"]], Const(r["c"]) * features[r["den"]] if r["c"] != 1 else features[r["den"]], 1e-9)
        out.append((p.label(), p))
    return out


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by ``order`` of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
