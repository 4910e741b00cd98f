"""Connected components of a link table, without bringing a link to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .memory import gathered, tidied


#: Links that a task holds before it passes their forest on.
FOREST_LINKS = 500_000
#: Forest links up to which one task finishes the work; beyond, rounds over all tasks do.
ONE_TASK_LINKS = 400_000


def forests(links: DataFrame) -> DataFrame:
    """A spanning forest of each run of links that a task reads: as connected as they are, and at most a link per node."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        seen = 0

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        def flush() -> pa.RecordBatch:
            rows = np.array([(x, root(x)) for x in list(parent) if root(x) != x], np.int64).reshape(-1, 2)
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])

        for batch in gathered(batches):
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= FOREST_LINKS:
                seen = 0
                yield flush()
        yield flush()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """node, component (its least node) for the nodes of ``links`` (columns a, b of longs).

    Tasks hand on spanning forests of the links that they read.  If these have
    ``one_task`` links at most, one task merges them.  Else come rounds of
    alternating large-star and small-star steps: each node hands its larger
    neighbours, then its smaller ones, to the least node that it knows; their
    number grows with the logarithm of the component's size.  Every round is
    written to the shared folder, so the lineage stays short.
    """
    edges = store.keep(forests(links.filter("a <> b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", small=True)
    if edges.count() <= one_task:
        found = forests(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component"))
        return store.keep(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "cc", small=True)
    seen = None
    while True:  # until nothing changes
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen is not None and tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        spent, edges = edges, store.keep(small.distinct(), "cc", small=True)
        store.drop(spent)
    # stars now: each node points to its component's least node
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
