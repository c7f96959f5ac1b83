"""Null-safe numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even at ``digits`` decimals, on the binary value.

    ``round`` is half-up and ``bround`` works on the decimal text; ``rint`` keeps the
    result of the usual numeric libraries. Adding 0.0 turns -0.0 into 0.0.
    """
    if digits == 0:
        return F.rint(value) + F.lit(0.0)
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale + F.lit(0.0)


def safe_round(value: Column, digits: int = 3) -> Column:
    """``half_even`` that yields NULL for text that is not a number, NaN and infinities."""
    number = value.try_cast("double")
    return F.when(finite(number), half_even(number, digits))


def finite(value: Column) -> Column:
    """True for ordinary numbers; false for NULL, NaN and the infinities."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def null_if_zero(value: Column) -> Column:
    """NULL for zero, so that ``coalesce`` falls through it."""
    return F.nullif(value, F.lit(0.0))
