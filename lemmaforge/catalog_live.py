"""Queries over streams and table functions."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_fits import ORD, _optimum, orders
from .catalog_more import scratch
from .expr import Col
from .functions import table_functions
from .operators import fits, solve
from .pred import TRUE, Flag
from .streaming import maintain


def stream_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """All orders come in four batches: extrema and least-slack forms, as kept after the last one, at the features' means."""
    place = scratch(spark)
    orders(spark, sf).select("even", "x1", "x3", "y").write.parquet(f"{place}/source")
    stream = spark.readStream.schema("even boolean, x1 double, x3 double, y double").option("maxFilesPerTrigger", 1).parquet(f"{place}/source")
    watched = maintain.Watched(Col("y"), (Col("x1"), Col("x3")), (TRUE, Flag("even")), ((0,), (1,), (0, 1)), f"{place}/state")
    query = maintain.maintain(stream, watched, f"{place}/checkpoint")
    query.awaitTermination()
    rows = []
    for r in watched.extrema(spark).collect():
        rows += [(r["hypothesis"], "rows", "", float(r["n"])), (r["hypothesis"], "y", ">=", r["lo_y"]), (r["hypothesis"], "y", "<=", r["hi_y"])]
        rows += [(r["hypothesis"], f"y / {x}", side, r[f"{end}_{j}"]) for j, x in enumerate(("x1", "x3")) for side, end in ((">=", "lo"), ("<=", "hi"))]
    means = {r["hypothesis"]: r for r in watched.extrema(spark).collect()}
    for f in watched.forms(spark):
        h, c = watched.hyps[f.candidate.hyp].label(), watched.subsets.index(f.candidate.features)
        at = f.intercept + sum(w * means[h][f"s_{c}_{j}"] / f.rows for w, j in zip(f.weights, f.candidate.features, strict=True))
        rows.append((h, "; ".join(watched.features[j].label() for j in f.candidate.features), "<=" if f.upper else ">=", at))
    return spark.createDataFrame(rows, "hypothesis string, form string, side string, value double").withColumn("value", F.round("value", 4))


def _stream_sql() -> str:
    hyps = (("TRUE", "TRUE"), ("even", "even"))
    parts = [_optimum(f"{'_'.join(xs)}_{h}_{int(up)}", h, "; ".join(xs), cond, xs, "y", fits.FREE, up) for h, cond in hyps for xs in (("x1",), ("x3",), ("x1", "x3")) for up in (True, False)]
    forms = " UNION ALL ".join(x for _, x in parts)
    ends = " UNION ALL ".join(f"SELECT '{h}' AS hypothesis, '{form}' AS form, '{side}' AS side, CAST({value} AS DOUBLE) AS value FROM nat WHERE {cond}" for h, cond in hyps for form, side, value in [("rows", "", "count(*)"), ("y", ">=", "min(y)"), ("y", "<=", "max(y)"), *((f"y / {x}", side, f"{fn}(y / {x})") for x in ("x1", "x3") for side, fn in ((">=", "min"), ("<=", "max")))])
    return f"WITH {ORD}, " + ", ".join(x for x, _ in parts) + f" SELECT hypothesis, form, side, round(value, 4) AS value FROM (SELECT hypothesis, form, side, at_mean AS value FROM ({forms}) UNION ALL {ends})"


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    """A row of orders for each hypothesis that it meets."""
    return orders(spark, sf).withColumn("hypothesis", F.explode(F.when(F.col("even"), F.array(F.lit("TRUE"), F.lit("even"))).otherwise(F.array(F.lit("TRUE"))))).select("hypothesis", "y", "x1", "x2", "x3", "x4")


def table_function_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Ratio bounds called from SQL: ends by task, merged, and turned into statements by a lateral join."""
    table_functions.register(spark)
    _objects(spark, sf).createOrReplaceTempView("lemmaforge_objects")
    return spark.sql("""
        SELECT e.hypothesis, e.feature, e.n, b.side, round(b.slope, 4) AS slope
        FROM (SELECT hypothesis, feature, sum(n) AS n, min(low) AS low, max(high) AS high FROM ratio_ends(TABLE(SELECT * FROM lemmaforge_objects)) GROUP BY hypothesis, feature) e,
             LATERAL bounds_of('y', e.feature, e.low, e.high) b""")


_TABLE_RATIOS_SQL = f"WITH {ORD} " + " UNION ALL ".join(f"SELECT '{h}' AS hypothesis, '{c}' AS feature, count(*) AS n, '{op}' AS side, round({fn}(y / {c}), 4) AS slope FROM nat WHERE {h}" for h in ("TRUE", "even") for c in ("x1", "x2", "x3", "x4") for op, fn in ((">=", "min"), ("<=", "max")))


def table_function_corners(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the planar hulls called from SQL: the corners of each task's corners, partitioned by hypothesis."""
    table_functions.register(spark)
    _objects(spark, sf).select("hypothesis", "x1", "y").createOrReplaceTempView("lemmaforge_points")
    corners = spark.sql("SELECT * FROM hull_corners(TABLE(SELECT * FROM hull_corners(TABLE(SELECT * FROM lemmaforge_points))) PARTITION BY hypothesis)")
    # a hypothesis has few corners: its edges are between neighbours of one side
    rows = []
    for h in ("TRUE", "even"):
        own = np.array([(r["x"], r["y"]) for r in corners.filter(F.col("hypothesis") == h).collect()])
        for side in ("<=", ">="):
            rows += [(h, side, float(p[0]), float(q[0]), round(float((q[1] - p[1]) / (q[0] - p[0])), 4)) for p, q in pairwise(solve.hull(own, side == "<="))]
    return spark.createDataFrame(rows, "hypothesis string, side string, x_from double, x_to double, slope double")


_CORNERS_SQL = f"WITH {ORD}, " + ", ".join(f"p{h} AS (SELECT x1 AS x, max(y) AS hi, min(y) AS lo FROM nat WHERE {h} GROUP BY x1)" for h in ("TRUE", "even")) + " " + " UNION ALL ".join(
    f"SELECT '{h}' AS hypothesis, '{side}' AS side, a.x AS x_from, b.x AS x_to, round((b.{v} - a.{v}) / (b.x - a.x), 4) AS slope FROM p{h} a JOIN p{h} b ON a.x < b.x WHERE NOT EXISTS (SELECT 1 FROM p{h} c WHERE c.x <> a.x AND c.x <> b.x AND (c.{v} - a.{v} - (b.{v} - a.{v}) / (b.x - a.x) * (c.x - a.x)) {'>=' if side == '<=' else '<='} 0)"
    for h in ("TRUE", "even") for side, v in (("<=", "hi"), (">=", "lo"))
)


QUERIES = {"stream_bounds": stream_bounds, "table_function_ratios": table_function_ratios, "table_function_corners": table_function_corners}
SQL = {"stream_bounds": _stream_sql(), "table_function_ratios": _TABLE_RATIOS_SQL, "table_function_corners": _CORNERS_SQL}
