"""Numeric semantics as Columns: missing means null, NaN or infinite, and never compares as true."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Any column as a double: booleans 0/1, texts where they read as numbers, else null."""
    return c.try_cast("double")


def finite(c: Column) -> Column:
    """True where the value is a number, not NaN and not infinite; never null."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def only_finite(c: Column) -> Column:
    return F.when(finite(c), c)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def steady_sum(c: Column) -> Column:
    """Sum of a group's doubles, the same in any order of its rows where all have up to four decimals (prices): these are added as whole numbers.

    Other values are added as doubles, whose last digits depend on the order.
    """
    x = c.cast("double")
    tens = F.when(F.abs(x) < 2.0**49, F.rint(x * 10_000).cast("long"))
    whole = F.bool_and((tens / 10_000.0).eqNullSafe(x))
    return F.coalesce(F.when(whole, F.try_sum(tens) / 10_000.0), F.sum(x))


def floored_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return F.when(b != 0, a - F.floor(F.try_divide(a, b)).cast("double") * b)


def rounded(c: Column, up: bool) -> Column:
    """Floor or ceiling as a double; values beyond 2^53 are whole already."""
    whole = (F.ceil(c) if up else F.floor(c)).cast("double")
    return F.when(F.abs(c) < float(2**53), whole).otherwise(c)


def root(c: Column) -> Column:
    return F.when(finite(c) & (c >= 0), F.sqrt(c))


def logarithm(c: Column, base: float | None = None, least: float = 0.0) -> Column:
    if base is not None and (base <= 0 or base == 1):
        return F.lit(None).cast("double")
    x = F.when(finite(c), F.greatest(c, F.lit(float(least)))) if least > 0 else c
    out = F.when(x > 0, F.ln(x))
    return out if base is None else out / F.ln(F.lit(float(base)))


def true(c: Column) -> Column:
    """A boolean that counts null as false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def truthy(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return true(c)
    if kind == "string":
        return F.coalesce(F.length(c) > 0, F.lit(False))
    return F.coalesce(~F.isnan(c.cast("double")) & (c != 0), F.lit(False))


def close(a: Column, b: Column, atol: float = 0.0, rtol: float = 0.0) -> Column:
    return finite(a) & finite(b) & (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
