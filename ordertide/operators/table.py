"""Detail-row paging (the raw-data tab)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def display_columns(df: DataFrame) -> DataFrame:
    """Dates/timestamps as 'YYYY-MM-DD' text, NaN doubles as NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _behind(order: list[tuple[str, bool]], after: tuple) -> Column:
    """Rows that come after ``after`` in the order of (column, ascending)
    pairs; NULLs stand first when ascending, last when descending."""
    out = F.lit(False)
    for (c, asc), v in reversed(list(zip(order, after))):
        col, lit = F.col(c), F.lit(v)
        if v is None:
            further = col.isNotNull() if asc else F.lit(False)
        else:
            further = (col > lit) if asc else (col < lit) | col.isNull()
        out = F.coalesce(further, F.lit(False)) | (col.eqNullSafe(lit) & out)
    return out


def raw_data(df: DataFrame, sort: list[tuple[str, bool]] | None = None, key: list[str] | None = None,
             page_size: int = 100, after: tuple | None = None, where=None, display: bool = True) -> DataFrame:
    """One page of detail rows: optional user filter, user sort (column,
    ascending) with the row ``key`` as tie-break, the first ``page_size`` rows
    behind ``after`` (the sort and key values of the last row of the page
    before; None: the first page). Every page is a filter and a per-partition
    top-``page_size``, however far down it is."""
    if not key:
        raise ValueError("paging needs the row key: without a total order pages overlap")
    if where is not None:
        df = df.where(where)
    order = [*(sort or []), *[(k, True) for k in key]]
    if after is not None:
        if len(after) != len(order):
            raise ValueError(f"after needs {len(order)} values: {[c for c, _ in order]}")
        df = df.where(_behind(order, after))
    out = df.orderBy(*[F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order])
    out = out.limit(page_size)
    return display_columns(out) if display else out
