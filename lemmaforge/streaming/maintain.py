"""Bounds kept up to date over a stream of rows.

State is a version for each micro-batch: extrema and sums of every signature
(which hypotheses a row meets), merged from the version before and the batch,
and the corners of the hull of each candidate.  A batch without a row beyond a
hull leaves its corners as they are; only hulls that some row lies beyond are
solved again, over the old corners and the new rows.  A least-slack form over
the corners with the sums' means is the one over all rows that ever came, since
a linear bound holds on a hull where it holds on the corners.

A batch that is run again after a failure reads the version before it and
writes its own anew, so every row counts once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..expr import Expr, Linear
from ..functions import numeric as nf
from ..operators import fits, hull
from ..pred import Compare, Pred
from ..relation import Statement


@dataclass(frozen=True)
class Watched:
    """What is kept: bounds of a target by subsets of the features, under each hypothesis; ``path`` is a folder that all executors share."""

    target: Expr
    features: tuple[Expr, ...]
    hyps: tuple[Pred, ...]
    subsets: tuple[tuple[int, ...], ...]
    path: str

    def matrix(self, rows: DataFrame) -> DataFrame:
        sig = F.concat(*[F.when(h.column(), "1").otherwise("0") for h in self.hyps])
        return rows.select(sig.alias("sig"), nf.only_finite(self.target.column()).alias("y"), *[nf.only_finite(e.column()).alias(f"f{j}") for j, e in enumerate(self.features)])

    def update(self, rows: DataFrame, batch: int) -> None:
        """Take one batch into account and write its version."""
        spark = rows.sparkSession
        m = self.matrix(rows).filter(F.col("y").isNotNull()).persist()
        ends = self._ends(m).persist()
        try:
            before = max((v for v in self.versions(spark) if v < batch), default=None)
            sums = self._sums(m)
            corners = {}
            if before is not None:
                sums = self._merged(spark.read.parquet(f"{self._place(before)}/sums").unionByName(sums))
                corners = self._corners(spark, before)
            broken = self._broken(ends, corners)
            solved = hull.corners_many(ends, self._points_of(), {k: len(self.subsets[k[1]]) + 1 for k in broken}, {k: corners[k][0] for k in broken if k in corners})
            corners |= {k: (points, batch) for k, points in solved.items() if len(points)}
            place = self._place(batch)
            sums.coalesce(1).write.mode("overwrite").parquet(f"{place}/sums")
            found = [(h, c, solved, p.tolist()) for (h, c), (ps, solved) in sorted(corners.items()) for p in ps]
            spark.createDataFrame(found, "hyp int, subset int, solved long, p array<double>").coalesce(1).write.mode("overwrite").parquet(f"{place}/corners")
            for v in self.versions(spark):
                if before is not None and v < before:
                    self._files(spark)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(self._place(v)), True)
        finally:
            ends.unpersist()
            m.unpersist()

    def _ends(self, m: DataFrame) -> DataFrame:
        """Of rows with the same features those with the least and largest target: the others are no corners.  In as many tasks as a shuffle has, however few files a batch comes in."""
        features = [f"f{j}" for j in range(len(self.features))]
        found = m.groupBy("sig", *features).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
        return found.select("sig", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"), *features)

    def _sums(self, m: DataFrame) -> DataFrame:
        """A row for each signature: rows, sums and extrema of the target, and per subset of the rows that have all its features."""
        cols = [F.count("y").alias("n"), F.min("y").alias("lo_y"), F.max("y").alias("hi_y")]
        for c, subset in enumerate(self.subsets):
            there = F.lit(True)
            for j in subset:
                there = there & F.col(f"f{j}").isNotNull()
            cols.append(F.count_if(there).alias(f"n_{c}"))
            cols += [F.sum(F.when(there, F.col(f"f{j}"))).alias(f"s_{c}_{j}") for j in subset]
        for j in range(len(self.features)):
            ratio = F.when(F.col(f"f{j}") > 0, F.col("y") / F.col(f"f{j}"))
            cols += [F.min(ratio).alias(f"lo_{j}"), F.max(ratio).alias(f"hi_{j}")]
        return m.groupBy("sig").agg(*cols)

    @staticmethod
    def _merged(parts: DataFrame) -> DataFrame:
        how = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}
        return parts.groupBy("sig").agg(*[how[c.split("_")[0]](c).alias(c) for c in parts.columns if c != "sig"])

    def _points_of(self):
        """Rows of the matrix as points (features, target) of a hypothesis and subset."""
        subsets = self.subsets

        def points(frame: pd.DataFrame, key: tuple[int, int]) -> np.ndarray:
            h, c = key
            x = frame.loc[frame["sig"].str[h] == "1", [*(f"f{j}" for j in subsets[c]), "y"]].to_numpy(dtype=float)
            return x[np.isfinite(x).all(axis=1)]

        return points

    def _broken(self, m: DataFrame, corners: dict) -> list[tuple[int, int]]:
        """Hypotheses and subsets with a row beyond their hull, or with rows and no hull yet: one pass for all."""
        known = {key: hull.planes(ps)[:2] for key, (ps, _) in corners.items()}
        keys = [(h, c) for h in range(len(self.hyps)) for c in range(len(self.subsets))]
        points_of = self._points_of()

        def beyond(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            found: set[int] = set()
            for frame in frames:
                for i, key in enumerate(keys):
                    if i in found:
                        continue
                    points = points_of(frame, key)
                    for lo in range(0, len(points), hull.CHUNK):
                        if key not in known or (points[lo : lo + hull.CHUNK] @ known[key][0].T > known[key][1]).any():
                            found.add(i)
                            break
            yield pd.DataFrame({"i": sorted(found)})

        return [keys[r["i"]] for r in m.mapInPandas(beyond, "i int").distinct().orderBy("i").collect()]

    # versions in the shared folder
    def _place(self, batch: int) -> str:
        return f"{self.path.rstrip('/')}/batch={batch}"

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path

    def versions(self, spark: SparkSession) -> list[int]:
        """The batches whose state is written to its end."""
        files, path = self._files(spark)
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        done = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
        return sorted(v for v in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self._place(v)}/corners/_SUCCESS")))

    def _corners(self, spark: SparkSession, batch: int) -> dict[tuple[int, int], tuple[np.ndarray, int]]:
        held: dict[tuple[int, int], list] = {}
        solved = {}
        for r in spark.read.parquet(f"{self._place(batch)}/corners").collect():
            held.setdefault((r["hyp"], r["subset"]), []).append(r["p"])
            solved[r["hyp"], r["subset"]] = r["solved"]
        return {k: (np.unique(np.array(v), axis=0), solved[k]) for k, v in held.items()}

    # what the latest version says
    def extrema(self, spark: SparkSession) -> DataFrame:
        """hypothesis, n, lo_y, hi_y, and lo_j, hi_j of target / feature j where that is positive: the signatures rolled up."""
        rows = spark.read.parquet(f"{self._place(self.versions(spark)[-1])}/sums")
        hyps = F.explode(F.filter(F.array(*[F.when(F.substring("sig", i + 1, 1) == "1", F.lit(h.label())) for i, h in enumerate(self.hyps)]), lambda x: x.isNotNull()))
        return self._merged(rows.withColumn("sig", hyps)).withColumnRenamed("sig", "hypothesis")

    def forms(self, spark: SparkSession, box: float = fits.FREE) -> list[fits.Fit]:
        """The least-slack form above and below under each hypothesis and subset, over all rows so far."""
        at = self.versions(spark)[-1]
        sums = {r["hypothesis"]: r for r in self.extrema(spark).collect()}
        out = []
        for (h, c), (corners, _) in sorted(self._corners(spark, at).items()):
            row = sums[self.hyps[h].label()]
            cost = np.array([*(row[f"s_{c}_{j}"] / row[f"n_{c}"] for j in self.subsets[c]), 1.0])
            for up in (False, True):
                got = fits.best_form(corners, cost, up, box)
                if got is not None:
                    out.append(fits.Fit(fits.Candidate(h, self.subsets[c]), up, tuple(float(x) for x in got[0][:-1]), float(got[0][-1]), row[f"n_{c}"]))
        return out

    def statements(self, spark: SparkSession) -> list[Statement]:
        """The forms as statements, coefficients as they are."""
        return [Statement(self.hyps[f.candidate.hyp], Compare("<=" if f.upper else ">=", self.target, Linear(f.intercept, tuple((w, self.features[j]) for w, j in zip(f.weights, f.candidate.features, strict=True)))), stage="stream") for f in self.forms(spark)]


def maintain(stream: DataFrame, watched: Watched, checkpoint: str) -> StreamingQuery:
    """Update the state for every micro-batch of what is there, then stop."""
    return stream.writeStream.foreachBatch(watched.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
