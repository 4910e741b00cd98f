"""Memory of Python workers: they live on between tasks, so what a task has freed should go back to the machine."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of text in an Arrow batch, and the setting that says so with its default: Spark keeps the buffers that it has filled once.
BATCH_ROWS = 250
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def tidy() -> None:
    """Give freed memory back; where the C library has no call for it, Arrow's pool alone does."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, tidying up when a task's rows are through."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return whole


def bounded_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows, as rows are texts; a session that has set a number of its own keeps it."""
    if spark.conf.get(_SETTING) == _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000, size: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together until they have ``rows`` rows or ``size`` bytes, for work that pays for each batch."""
    held: list[pa.RecordBatch] = []
    n = total = 0
    for batch in batches:
        held.append(batch)
        n, total = n + batch.num_rows, total + batch.nbytes
        if n >= rows or total >= size:
            yield _together(held)
            held, n, total = [], 0, 0
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    schema = held[0].schema
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in held]) for i in range(len(schema))], schema=schema)
