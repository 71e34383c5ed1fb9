"""Numeric coercion and finiteness guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_numeric_coerce(c: Column) -> Column:
    """Text/number to double; unparsable -> NULL (never raises under ANSI)."""
    return c.try_cast("double")


def is_finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    """NaN and +-inf become NULL (so sum/avg/count skip them)."""
    return F.when(is_finite(c), c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite_or_null(c).cast("double"), F.lit(0.0))
