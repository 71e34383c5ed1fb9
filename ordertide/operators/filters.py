"""Row filters, relative date presets and option lists.

Bounds such as "max order date" are fetched with one small aggregate and
turned into literals, so every date predicate reaches the parquet scan as a
``PushedFilter`` (a join against a bounds row would not push down).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.functions import dates as D

DIMENSIONS = ("region", "category", "segment")


# --- dimension lists ------------------------------------------------------

def filter_in_dims(df: DataFrame, regions: Iterable[str] | None = None,
                   categories: Iterable[str] | None = None,
                   segments: Iterable[str] | None = None) -> DataFrame:
    """AND of IN-lists; an empty or missing list means no filter. NULL never
    matches a list."""
    for col, values in zip(DIMENSIONS, (regions, categories, segments)):
        values = list(values or [])
        if values:
            df = df.where(F.col(col).isin(values))
    return df


# --- absolute ranges --------------------------------------------------------

PARTITION_YEAR = "order_year"


def _year_prune(df: DataFrame, lo: dt.datetime, hi: dt.datetime, col: str):
    """On a fact staged with ``partitionBy('order_year')``, the redundant
    year bound lets Spark skip whole directories (Catalyst does not derive
    it from a timestamp range by itself)."""
    if col == "order_date" and PARTITION_YEAR in df.columns:
        return (F.col(PARTITION_YEAR) >= F.lit(lo.year)) & (F.col(PARTITION_YEAR) <= F.lit(hi.year))
    return None


def _where(df: DataFrame, pred, prune):
    return df.where(pred if prune is None else pred & prune)


def filter_date_range(df: DataFrame, start, end, col: str = "order_date") -> DataFrame:
    """Inclusive on both ends by calendar date (time of day ignored), written
    as the half-open range [start 00:00, end+1 day 00:00) so it pushes down."""
    lo = D.midnight(start)
    hi = D.midnight(end) + dt.timedelta(days=1)
    pred = (F.col(col) >= D.ts_literal(lo)) & (F.col(col) < D.ts_literal(hi))
    return _where(df, pred, _year_prune(df, lo, D.midnight(end), col))


def filter_ts_between(df: DataFrame, start, end, col: str = "order_date") -> DataFrame:
    """Inclusive on both ends at timestamp precision."""
    lo, hi = D.to_datetime(start), D.to_datetime(end)
    pred = (F.col(col) >= D.ts_literal(lo)) & (F.col(col) <= D.ts_literal(hi))
    return _where(df, pred, _year_prune(df, lo, hi, col))


def date_bounds(df: DataFrame, col: str = "order_date") -> DataFrame:
    """One row: min_date, max_date and the anchor (midnight of max)."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"),
                  D.day_start(F.max(col)).alias("anchor_date"))


def bounds(df: DataFrame, col: str = "order_date") -> tuple:
    """(min, max) of ``col`` as Python datetimes (one-row action)."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return row["lo"], row["hi"]


# --- relative presets (one-page dashboards) -----------------------------

# The one-page dashboards' relative presets (anchor = last
# order day): today, last week = 6 days back, last month = 29 days back,
# last quarter = 3 months, last 6 months, last 1/2/3 years, all time.


def resolve_preset(preset: str, min_ts, max_ts, current: tuple | None = None):
    """(start, end) dates for a preset relative to the anchor (max date at
    midnight), both clamped into [min date, max date]. ``custom`` passes
    ``current`` through; an unknown preset returns None (no change)."""
    if preset == "custom":
        return current
    lo, hi = D.midnight(min_ts), D.midnight(max_ts)
    end = hi
    offsets = {
        "today": lambda e: e,
        "last_week": lambda e: e - dt.timedelta(days=6),
        "last_month": lambda e: e - dt.timedelta(days=29),
        "last_quarter": lambda e: D.add_months(e, -3),
        "last_6_months": lambda e: D.add_months(e, -6),
        "last_year": lambda e: D.add_years(e, -1),
        "last_2_years": lambda e: D.add_years(e, -2),
        "last_3_years": lambda e: D.add_years(e, -3),
        "all_time": lambda e: lo,
    }
    if preset not in offsets:
        return None
    start = offsets[preset](end)
    return D.clamp(start, lo, hi).date(), D.clamp(end, lo, hi).date()


def filter_preset(df: DataFrame, preset: str, current: tuple | None = None,
                  data_bounds: tuple | None = None) -> DataFrame:
    """Resolve ``preset`` against the data's bounds, then filter by date."""
    lo, hi = data_bounds or bounds(df)
    if hi is None:
        return df
    rng = resolve_preset(preset, lo, hi, current)
    if rng is None:
        rng = current
    if rng is None:
        return df
    return filter_date_range(df, rng[0], rng[1])


# --- trailing presets (six-tab dashboard) ---------------------------------

# The six-tab dashboard's trailing presets, [max - offset, max].
TRAILING_PRESETS = {
    "LAST_60D": ("days", 60), "LAST_90D": ("days", 90), "LAST_180D": ("days", 180),
    "LAST_1Y": ("years", 1), "LAST_2Y": ("years", 2), "LAST_3Y": ("years", 3),
    "LAST_5Y": ("years", 5),
}


def trailing_start(preset: str, max_ts: dt.datetime):
    unit, n = TRAILING_PRESETS[preset]
    return max_ts - dt.timedelta(days=n) if unit == "days" else D.add_years(max_ts, -n)


def filter_trailing_preset(df: DataFrame, preset: str | None, max_ts=None,
                           col: str = "order_date") -> DataFrame:
    """[max - offset, max] inclusive at timestamp precision, max taken on the
    unfiltered input. ALL_TIME, empty or unknown presets filter nothing."""
    if not preset or preset not in TRAILING_PRESETS:
        return df
    if max_ts is None:
        max_ts = bounds(df, col)[1]
    if max_ts is None:
        return df
    return filter_ts_between(df, trailing_start(preset, max_ts), max_ts, col)


# --- calendar selectors -----------------------------------------------------

def _off(v) -> bool:
    return v is None or v == "All"


def filter_calendar(df: DataFrame, year=None, quarter=None, month=None,
                    col: str = "order_date") -> DataFrame:
    """Year = int, Quarter = 'Qn', Month = int; None/'All' disables each.
    The year becomes a half-open date range so it reaches the scan."""
    c = F.col(col)
    if not _off(year):
        y = int(year)
        pred = (c >= D.ts_literal(dt.datetime(y, 1, 1))) & (c < D.ts_literal(dt.datetime(y + 1, 1, 1)))
        df = _where(df, pred, _year_prune(df, dt.datetime(y, 1, 1), dt.datetime(y, 12, 31), col))
    if not _off(quarter):
        df = df.where(D.quarter_label(c) == F.lit(str(quarter)))
    if not _off(month):
        df = df.where(F.month(c) == F.lit(int(month)))
    return df


def time_predicate(df: DataFrame, year=None, quarter=None, month=None, preset=None,
                   max_ts=None, col: str = "order_date"):
    """The preset + calendar part of ``apply_filters`` as one Column (or None
    when nothing filters). A preset needs ``max_ts``, the last date of the
    unfiltered table: ``df`` may be filtered already."""
    c = F.col(col)
    preds = []
    if preset in TRAILING_PRESETS:
        if max_ts is None:
            raise ValueError("a preset needs max_ts, the last date of the unfiltered table")
        start = trailing_start(preset, max_ts)
        preds.append((c >= D.ts_literal(start)) & (c <= D.ts_literal(max_ts)))
        prune = _year_prune(df, start, max_ts, col)
        if prune is not None:
            preds.append(prune)
    if not _off(year):
        y = int(year)
        preds.append((c >= D.ts_literal(dt.datetime(y, 1, 1)))
                     & (c < D.ts_literal(dt.datetime(y + 1, 1, 1))))
        prune = _year_prune(df, dt.datetime(y, 1, 1), dt.datetime(y, 12, 31), col)
        if prune is not None:
            preds.append(prune)
    if not _off(quarter):
        preds.append(D.quarter_label(c) == F.lit(str(quarter)))
    if not _off(month):
        preds.append(F.month(c) == F.lit(int(month)))
    if not preds:
        return None
    out = preds[0]
    for p in preds[1:]:
        out = out & p
    return out


def apply_filters(df: DataFrame, year=None, quarter=None, month=None, preset=None,
                  regions=None, categories=None, segments=None, max_ts=None) -> DataFrame:
    """Trailing preset (max over the unfiltered input) -> calendar -> dims."""
    if preset in TRAILING_PRESETS and max_ts is None:
        max_ts = bounds(df)[1]
        preset = preset if max_ts is not None else None  # no date at all
    pred = time_predicate(df, year, quarter, month, preset, max_ts)
    out = df if pred is None else df.where(pred)
    return filter_in_dims(out, regions, categories, segments)


def finite_rows(df: DataFrame, col: str = "sales") -> DataFrame:
    """Keep rows whose ``col`` is a finite number."""
    from ordertide.functions.numeric import is_finite
    return df.where(is_finite(F.col(col)))


def dropna_subset(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


# --- option lists -----------------------------------------------------------

def dim_options(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-NULL values of one column."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def year_options(df: DataFrame, col: str = "order_date") -> DataFrame:
    return (df.select(F.year(col).alias("year")).where(F.col("year").isNotNull())
            .distinct().orderBy("year"))


def quarter_options(df: DataFrame, year=None, col: str = "order_date") -> DataFrame:
    """Quarters present (for one year or all), in Q1..Q4 order."""
    d = filter_calendar(df, year=year, col=col)
    return (d.select(F.quarter(col).alias("q")).where(F.col("q").isNotNull()).distinct()
            .select(F.concat(F.lit("Q"), F.col("q").cast("string")).alias("quarter"), "q")
            .orderBy("q").drop("q"))


def month_options(df: DataFrame, year=None, quarter=None, col: str = "order_date") -> DataFrame:
    """Distinct (month_num, month) pairs present, ordered by month number."""
    d = filter_calendar(df, year=year, quarter=quarter, col=col)
    return (d.select(F.month(col).alias("month_num"), D.month_abbr(F.col(col)).alias("month"))
            .na.drop().dropDuplicates().orderBy("month_num"))


def first_usable_group(df: DataFrame, candidates=("category", "region", "segment")) -> str | None:
    """First candidate column holding any non-NULL value (one-row action)."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = df.agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in present]).first()
    for c in present:
        if row[c]:
            return c
    return None


def row_guard(n: int, minimum: int, what: str) -> str | None:
    """Reason text when ``n`` is below ``minimum``, else None."""
    if n < minimum:
        return f"Need at least {minimum} {what} (found {n})."
    return None
