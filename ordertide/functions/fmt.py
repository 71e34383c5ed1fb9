"""Display formats as Column expressions (JVM-side, no Python UDF).

``format_number`` rounds half-even on the exact binary value, like Python's
``format``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordertide.functions.numeric import finite_or_null


def currency0(x: Column) -> Column:
    """'$1,234' (negative: '$-1,234', as Python's f'${v:,.0f}')."""
    return F.concat(F.lit("$"), F.format_number(x.cast("double"), 0))


def currency2(x: Column) -> Column:
    """'$1,234.00'; NULL/NaN -> '$0.00'."""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(finite_or_null(x.cast("double")), F.lit(0.0)), 2))


def safe_int(x: Column) -> Column:
    """Truncated integer with thousands separators; NULL/NaN -> '0'."""
    v = F.coalesce(finite_or_null(x.cast("double")).cast("bigint"), F.lit(0))
    return F.format_number(v, 0)


def safe_pct(x: Column) -> Column:
    """x*100 with 2 decimals and '%'; NULL/NaN/inf -> '0.00%'."""
    v = F.coalesce(finite_or_null(x.cast("double")), F.lit(0.0))
    return F.concat(F.format_number(v * 100, 2), F.lit("%"))


def pct1_or_dash(x: Column) -> Column:
    """x*100 with 1 decimal and '%'; NULL -> em dash."""
    return F.coalesce(F.concat(F.format_number(x.cast("double") * 100, 1), F.lit("%")), F.lit("—"))


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def int_cast(x: Column) -> Column:
    """Measure as int, NULL -> 0."""
    return F.coalesce(x.cast("long"), F.lit(0))
