"""Statements against a stream of new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..relation import Statement


def counterexamples(rows: DataFrame, statements: Sequence[Statement]) -> DataFrame:
    """Each row once for every statement that it violates, with the statement's number; batch or stream, no shuffle."""
    broken = F.filter(F.array(*[F.when(s.violated(), F.lit(i)) for i, s in enumerate(statements)]), lambda x: x.isNotNull())
    return rows.withColumn("statement", F.explode(broken))


def watch(stream: DataFrame, statements: Sequence[Statement], path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's counterexamples to Parquet files, exactly once by the checkpoint."""
    return counterexamples(stream, statements).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_extrema(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the count, least and largest value so far: mergeable state for constant and ratio bounds."""
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
