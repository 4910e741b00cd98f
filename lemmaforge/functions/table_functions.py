"""Generators as table functions, to be called from SQL once ``register(spark)`` has named them.

    ratio_ends(TABLE(objects))                 -- hypothesis, target, feature columns ..
    ratio_ends(TABLE(objects) PARTITION BY hypothesis)
        hypothesis, feature, n, low, high: least and largest target / feature
    hull_corners(TABLE(points))                -- hypothesis, x, y
        hypothesis, x, y: corners of each planar hull
    bounds_of('target', feature, low, high[, denominator])
        side, numerator, denominator, slope, statement, condition: two rows of
        ratio bounds, the condition as SQL text

The first two take Arrow batches and keep a row for each feature, or the
corners, of each hypothesis.  Without PARTITION BY a task answers for its own
rows, so hot hypotheses are spread and the query merges: least of the low ends,
largest of the high ones, or the corners' corners.  The last is for a lateral
join with what the others found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, NumericType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import solve


class RatioEnds:
    def __init__(self) -> None:
        self.found: dict[tuple[str, str], list] = {}

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        names = rows.schema.names
        t = rows.column(1).cast(pa.float64())
        for name, column in zip(names[2:], rows.columns[2:], strict=True):
            x = column.cast(pa.float64())
            r = pc.divide(t, pc.if_else(pc.equal(x, 0.0), None, x))
            table = pa.table({"h": rows.column(0), "r": pc.if_else(pc.is_finite(r), r, None)})
            for x in table.group_by("h").aggregate([("r", "count"), ("r", "min"), ("r", "max")]).to_pylist():
                if x["r_count"]:
                    own = self.found.setdefault((x["h"], name), [0, math.inf, -math.inf])
                    own[:] = own[0] + x["r_count"], min(own[1], x["r_min"]), max(own[2], x["r_max"])
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        rows = [(*key, *value) for key, value in self.found.items()]
        yield pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate((("hypothesis", pa.string()), ("feature", pa.string()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64())))})


class HullCorners:
    def __init__(self) -> None:
        self.found: dict[str, np.ndarray] = {}

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        points = np.column_stack([rows.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (1, 2)])
        there = np.isfinite(points).all(axis=1)
        keys = np.array(rows.column(0).to_pylist(), object)
        for h in dict.fromkeys(keys):
            own = points[there & (keys == h)]
            own = np.vstack([own, self.found[h]]) if h in self.found else own
            self.found[h] = np.unique(np.vstack([solve.hull(own, True), solve.hull(own, False)]), axis=0) if len(own) else own
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        rows = [(h, *p) for h, points in self.found.items() for p in points.tolist()]
        yield pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate((("hypothesis", pa.string()), ("x", pa.float64()), ("y", pa.float64())))})


class BoundsOf:
    @staticmethod
    def analyze(target: AnalyzeArgument, feature: AnalyzeArgument, low: AnalyzeArgument, high: AnalyzeArgument, denominator: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not all(isinstance(x.dataType, StringType) for x in (target, feature)) or not all(isinstance(x.dataType, NumericType) for x in (low, high)):
            raise ValueError("bounds_of takes two names and two numbers")
        if denominator is not None and (not isinstance(denominator.dataType, IntegerType) or (denominator.isConstantExpression and not denominator.value)):
            raise ValueError("the largest denominator has to be a whole number above 0")
        return AnalyzeResult(StructType().add("side", StringType()).add("numerator", LongType()).add("denominator", LongType()).add("slope", DoubleType()).add("statement", StringType()).add("condition", StringType()))

    def eval(self, target: str, feature: str, low: float, high: float, denominator: int = 10**6) -> Iterator[tuple]:
        from ..expr import Col, Linear
        from ..pred import Compare

        for side, end in ((">=", low), ("<=", high)):
            if end is not None and math.isfinite(end):
                slope = Fraction(float(end)).limit_denominator(denominator)
                bound = Compare(side, Col(target), Linear(Fraction(0), ((slope, Col(feature)),)))
                yield side, slope.numerator, slope.denominator, float(slope), bound.label(), bound.sql()


#: Name in SQL: handler, and its columns where they are fixed.
FUNCTIONS = {
    "ratio_ends": (RatioEnds, "hypothesis string, feature string, n long, low double, high double"),
    "hull_corners": (HullCorners, "hypothesis string, x double, y double"),
    "bounds_of": (BoundsOf, None),
}


def register(spark: SparkSession) -> list[str]:
    """Name the table functions in the session."""
    for name, (handler, kind) in FUNCTIONS.items():
        spark.udtf.register(name, arrow_udtf(handler, returnType=kind) if kind else udtf(handler))
    return list(FUNCTIONS)
