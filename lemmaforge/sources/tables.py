"""Sources and sinks of tables, edge lists and statements."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expr import SqlExpr
from ..pred import TRUE, Compare, SqlPred
from ..relation import Statement, metrics_frame


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; give a schema where the types are known, else they are inferred by a pass over it."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def memory_table(spark: SparkSession, data: Mapping[str, Sequence] | Iterable) -> DataFrame:
    """From a dict of columns, a pandas frame or rows."""
    return spark.createDataFrame(pd.DataFrame(data) if isinstance(data, Mapping) else data)


def edge_lists(spark: SparkSession, folder: str) -> DataFrame:
    """graph, src, dst of every ``src dst`` line in the folder's graphs; blank lines are left out.

    A graph is a text file ``<graph>.txt``, or a folder of that name with the
    part files that Spark writes, so that a large one has many writers.
    """
    path = F.input_file_name()
    file, above = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.when(file.startswith("part-") & above.endswith(".txt"), above).otherwise(file)
    lines = spark.read.text(f"{folder}/*.txt").select(F.regexp_replace(name, r"\.txt$", "").alias("graph"), F.split(F.trim("value"), r"\s+").alias("p"))
    return lines.filter(F.size("p") >= 2).select("graph", F.col("p")[0].try_cast("int").alias("src"), F.col("p")[1].try_cast("int").alias("dst"))


def _collatz_steps(numbers: pd.Series) -> pd.Series:
    """Steps of n -> n / 2 or 3n + 1 down to 1, of numbers from 1."""
    x = numbers.to_numpy(np.int64)
    steps, at, done = np.zeros(len(x), np.int64), np.flatnonzero(x > 1), 0
    x = x[at]
    while len(at):
        x, done = np.where(x & 1, 3 * x + 1, x >> 1), done + 1
        going = x > 1
        if not going.all():
            steps[at[~going]] = done
            x, at = x[going], at[going]
    return pd.Series(steps)


@lru_cache(maxsize=4)
def _primes(most: int) -> list[int]:
    prime = np.ones(most + 1, bool)
    prime[:2] = False
    for i in range(2, isqrt(most) + 1):
        if prime[i]:
            prime[i * i :: i] = False
    return np.flatnonzero(prime).tolist()


FACTORS = "prime_factor_count long, distinct_primes long, largest long, divisor_count long, sum_divisors long, totient long"


def _factors(numbers: pd.Series) -> pd.DataFrame:
    """What the prime factors of numbers from 1 tell.  Of close numbers a prime meets its multiples only, as in a sieve; of others it tries each."""
    own, place = np.unique(numbers.to_numpy(np.int64), return_inverse=True)
    rest, totient, low = own.copy(), own.copy(), int(own[0]) if len(own) else 0
    powers, distinct, largest = (np.zeros(len(own), np.int64) for _ in range(3))
    count, total = np.ones(len(own), np.int64), np.ones(len(own), np.int64)

    def take(at: np.ndarray, p: int | np.ndarray, k: int | np.ndarray, sums: np.ndarray) -> None:
        powers[at] += k
        distinct[at] += 1
        largest[at] = p
        count[at] *= k + 1
        total[at] *= sums
        totient[at] -= totient[at] // p

    most = int(own[-1]) if len(own) else 0
    where = None
    if most - low < 8 * len(own):
        where = np.full(most - low + 1, -1)
        where[own - low] = np.arange(len(own))
    # the bound is a power of two, so that one list of primes serves many calls
    for p in _primes(1 << isqrt(most).bit_length()) if most > 1 else ():
        if p * p > most:
            break
        if where is not None:
            at = where[-low % p :: p]
            at = at[at >= 0]
        else:
            at = np.flatnonzero(rest % p == 0)
        if not len(at):
            continue
        left, sums, k = rest[at], np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
        while (hit := left % p == 0).any():
            left, sums, k = np.where(hit, left // p, left), np.where(hit, sums * p + 1, sums), k + hit
        rest[at] = left
        take(at, p, k, sums)
    at = np.flatnonzero(rest > 1)
    take(at, rest[at], 1, rest[at] + 1)
    return pd.DataFrame(np.stack([powers, distinct, largest, count, total, totient], 1)[place.ravel()], columns=[x.split()[0] for x in FACTORS.split(", ")])


def number_theory(numbers: DataFrame) -> DataFrame:
    """Number theory of a table's column ``n`` of whole numbers, those below 1 left out: ranges of them are factored together, by primes up to their root."""
    n = F.col("n")
    tasks = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = numbers.select(n.cast("long")).filter("n >= 1").repartitionByRange(tasks, "n").sortWithinPartitions("n")
    df = df.withColumn("f", F.pandas_udf(_factors, FACTORS)("n")).withColumn("collatz_steps", F.pandas_udf(_collatz_steps, "long")("n")).select("n", "f.*", "collatz_steps")
    text, total = n.cast("string"), F.col("sum_divisors")
    square = lambda x: F.round(F.sqrt(x)).cast("long") * F.round(F.sqrt(x)).cast("long") == x
    return df.select(
        "n",
        F.sqrt("n").alias("sqrt_n"),
        F.ln("n").alias("log_n"),
        "prime_factor_count",
        "distinct_primes",
        F.when(n > 1, F.col("largest").cast("double")).alias("largest_prime_factor"),
        "divisor_count",
        "sum_divisors",
        "totient",
        "collatz_steps",
        (n % 2 == 0).alias("is_even"),
        (F.col("divisor_count") == 2).alias("is_prime"),
        square(n).alias("is_square"),
        (square(5 * n * n + 4) | square(5 * n * n - 4)).alias("is_fibonacci"),
        ((total - n == n)).alias("is_perfect"),
        (text == F.reverse(text)).alias("is_palindrome"),
        (F.bit_count("n") == 1).alias("is_power_of_two"),
    )


def integer_table(spark: SparkSession, n: int) -> DataFrame:
    """``number_theory`` of 1..n."""
    return number_theory(spark.range(1, n + 1).withColumnRenamed("id", "n"))


def statement_rows(df: DataFrame, statements: Sequence[Statement]) -> DataFrame:
    return metrics_frame(df, statements).select("hypothesis", "conclusion", "accuracy")


def write_statements(df: DataFrame, statements: Sequence[Statement], path: str, kind: str = "json") -> None:
    """(hypothesis, conclusion, accuracy) as JSON lines or CSV, in one file: a catalog is small."""
    if kind not in ("json", "csv"):
        raise ValueError(f"no such kind: {kind}")
    writer = statement_rows(df, statements).coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


CATALOG = "seq long, name string, stage string, hypothesis string, hypothesis_sql string, op string, tol double, rtol double, left string, left_sql string, left_columns array<string>, right string, right_sql string, right_columns array<string>, conclusion string, conclusion_sql string"


def write_catalog(spark: SparkSession, statements: Sequence[Statement], path: str) -> None:
    """Statements with their SQL as JSON lines, to be read by ``read_catalog``."""
    rows = []
    for i, s in enumerate(statements):
        c = s.conclusion
        sides = [x for e in (c.a, c.b) for x in (e.label(), e.sql(), sorted(e.columns()))] if isinstance(c, Compare) else [None] * 6
        rows.append((i, s.name, s.stage, s.hypothesis.label(), s.hypothesis.sql(), *((c.op, c.tol, c.rtol) if isinstance(c, Compare) else (None,) * 3), *sides, c.label(), c.sql()))
    spark.createDataFrame(rows, CATALOG).coalesce(1).write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str) -> list[Statement]:
    """The statements of a catalog, in order: they can be evaluated, monitored, filtered and printed as those that were written.

    Spark reads their SQL; a conclusion of two sides is a comparison again.
    """
    out = []
    for r in spark.read.schema(CATALOG).json(path).orderBy("seq").collect():
        if r["op"] is not None:
            a, b = (SqlExpr(r[f"{x}_sql"], r[x], frozenset(r[f"{x}_columns"] or ())) for x in ("left", "right"))
            c = Compare(r["op"], a, b, r["tol"], r["rtol"])
        else:
            c = SqlPred(r["conclusion_sql"], r["conclusion"])
        out.append(Statement(TRUE if r["hypothesis"] == TRUE.label() else SqlPred(r["hypothesis_sql"], r["hypothesis"]), c, r["name"] or "", r["stage"] or ""))
    return out
