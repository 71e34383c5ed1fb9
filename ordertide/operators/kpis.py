"""Headline KPIs: totals, distinct counts, year-to-date against last year.

Each KPI set is a single aggregate pass; the date windows are literals
computed on the driver from one-row bounds, so the scan prunes by date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import dates as D
from ordertide.operators.filters import bounds


def money_sum(c: Column | str) -> Column:
    """Exact decimal sum, 0 for no rows, returned as double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def distinct_count(c: Column | str, mode: str = "exact") -> Column:
    """Distinct non-NULL count. ``exact`` plans through a (value, group)
    pre-aggregation (several exact counts in one aggregate expand the rows
    once per count); ``approx`` is a HyperLogLog++ sketch (about 1 % error),
    mergeable map-side with no expansion -- the scale option."""
    c = F.col(c) if isinstance(c, str) else c
    if mode == "approx":
        return F.approx_count_distinct(c, 0.01)
    if mode != "exact":
        raise ValueError(mode)
    return F.count_distinct(c)


def kpi_totals(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """One row: total sales and profit, distinct orders and customers, rows.
    Distinct counts ignore NULL; sums over no rows are 0."""
    return df.agg(
        money_sum("sales").alias("total_sales"),
        money_sum("profit").alias("total_profit"),
        distinct_count("order_id", distinct).alias("order_count"),
        distinct_count("customer_id", distinct).alias("customer_count"),
        F.count(F.lit(1)).alias("row_count"),
    )


def _yoy(ytd: Column, lytd: Column) -> Column:
    return F.when(lytd != 0, (ytd - lytd) / lytd)


def year_windows(end: dt.datetime, bound=lambda d: d):
    """(ytd_start, ytd_end, ly_start, ly_end): the year up to ``end`` and the
    same stretch a year before, each limit passed through ``bound``."""
    end = bound(end)
    ly_end = bound(D.add_years(end, -1))
    return bound(dt.datetime(end.year, 1, 1)), end, bound(dt.datetime(ly_end.year, 1, 1)), ly_end


def ytd_windows_clamped(end_date, min_ts, max_ts):
    """``year_windows`` with every limit clamped into the data's [first day,
    last day] -- so when last year precedes the data both last-year limits
    collapse onto the first day."""
    lo, hi = D.midnight(min_ts), D.midnight(max_ts)
    return year_windows(D.to_datetime(end_date), lambda d: D.clamp(d, lo, hi))


def _within(col: str, lo, hi) -> Column:
    return (F.col(col) >= D.ts_literal(lo)) & (F.col(col) <= D.ts_literal(hi))


def ytd_metrics_clamped(dims_df: DataFrame, end_date, data_bounds: tuple,
                        col: str = "order_date") -> DataFrame:
    """YTD / LYTD / YoY on dimension-filtered rows (the date filter is not
    applied). ``data_bounds`` are (min, max) of the *full* table. Bounds are
    inclusive at timestamp precision against midnight instants."""
    ytd_start, end, ly_start, ly_end = ytd_windows_clamped(end_date, *data_bounds)
    in_ytd, in_lytd = _within(col, ytd_start, end), _within(col, ly_start, ly_end)
    agg = (dims_df.where(_within(col, ly_start, end))
           .agg(money_sum(F.when(in_ytd, F.col("sales"))).alias("ytd_sales"),
                money_sum(F.when(in_lytd, F.col("sales"))).alias("lytd_sales")))
    return agg.select("ytd_sales", "lytd_sales",
                      _yoy(F.col("ytd_sales"), F.col("lytd_sales")).alias("yoy_pct"),
                      D.ts_literal(end).alias("through_date"))


def ytd_metrics_anchored(base_df: DataFrame, time_pred: Column | None = None,
                         col: str = "order_date", distinct: str = "exact") -> DataFrame:
    """KPIs of the six-tab dashboard over ``base_df`` (the dimension-filtered
    rows): one pass for the anchor date, one for the sums, which reads only
    dates that some sum uses. The filtered set is ``base_df`` where
    ``time_pred`` holds; totals and distinct counts come from it, YTD/LYTD
    come from all of ``base_df``, anchored at the filtered set's max date
    (else the base's max). No date at all -> zeros and NULL YoY."""
    pred = F.lit(True) if time_pred is None else time_pred
    c = F.col(col)
    first, anchor = bounds(base_df.where(pred), col)
    if anchor is None:
        anchor = bounds(base_df, col)[1]
    if anchor is None:
        return base_df.sparkSession.createDataFrame(
            [(0.0, 0, 0, 0.0, 0.0, None, None)],
            "total_sales double, customer_count long, order_count long, ytd_sales double, "
            "lytd_sales double, yoy_pct double, anchor_date timestamp_ntz")
    ytd_start, end, ly_start, ly_end = year_windows(anchor)
    in_ytd, in_lytd = _within(col, ytd_start, end), _within(col, ly_start, ly_end)
    # no sum reads beyond the anchor or before the earliest of the windows: a range that reaches the scan
    read = base_df if time_pred is None else base_df.where(_within(col, min(ly_start, first or ly_start), anchor))
    agg = read.agg(
        money_sum(F.when(pred, F.col("sales"))).alias("total_sales"),
        distinct_count(F.when(pred, F.col("customer_id")), distinct).alias("customer_count"),
        distinct_count(F.when(pred, F.col("order_id")), distinct).alias("order_count"),
        money_sum(F.when(in_ytd, F.col("sales"))).alias("ytd_sales"),
        money_sum(F.when(in_lytd, F.col("sales"))).alias("lytd_sales"))
    return agg.select("total_sales", "customer_count", "order_count", "ytd_sales", "lytd_sales",
                      _yoy(F.col("ytd_sales"), F.col("lytd_sales")).alias("yoy_pct"),
                      D.ts_literal(anchor).alias("anchor_date"))
