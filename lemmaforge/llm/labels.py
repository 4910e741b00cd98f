"""Bounded, reproducible samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def fitting_rows(docs: DataFrame, labels: DataFrame, label: str, eligible, most: int, name: str) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled rows of ``docs``, written to the shared folder.

    The rows are those of least hash of doc_id among the eligible labelled
    ones, so a rerun takes the same.  ``most`` bounds what is broadcast.  Null
    labels are left out; a document labelled twice counts with its larger
    label, and repeated documents once each.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & eligible)
    chosen = chosen.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "label_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return store.keep(rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"), name)
