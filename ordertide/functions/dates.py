"""Calendar columns and driver-side date arithmetic for literal bounds."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_month(c: Column) -> Column:
    """First instant of the month, as timestamp_ntz. Computed through DATE
    values, which are time-zone free (``date_trunc`` works in the session
    time zone and can land off midnight where DST switches at midnight)."""
    return F.trunc(F.to_date(c), "month").cast("timestamp_ntz")


def day_start(c: Column) -> Column:
    """Midnight of the day, as timestamp_ntz (time-zone free)."""
    return F.to_date(c).cast("timestamp_ntz")


def year(c: Column) -> Column:
    return F.year(c)


def month_num(c: Column) -> Column:
    return F.month(c)


def quarter_label(c: Column) -> Column:
    """'Q1'..'Q4'; NULL date gives NULL."""
    return F.concat(F.lit("Q"), F.quarter(c).cast("string"))


def month_abbr(c: Column) -> Column:
    return F.date_format(c, "MMM")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def year_month_start(ym: Column) -> Column:
    """'YYYY-MM' text back to the month's first instant; bad text -> NULL."""
    return F.try_to_date(F.concat(ym, F.lit("-01")), "yyyy-MM-dd").cast("timestamp_ntz")


def day_ordinal(c: Column) -> Column:
    """Proleptic Gregorian ordinal (0001-01-01 is day 1)."""
    return F.datediff(F.to_date(c), F.lit("0001-01-01").cast("date")) + F.lit(1)


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def calendar_columns(c: Column) -> dict[str, Column]:
    return {
        "year": year(c),
        "quarter": quarter_label(c),
        "month_num": month_num(c),
        "month": month_abbr(c),
        "year_month": year_month(c),
    }


def ts_literal(value: dt.date | dt.datetime | str) -> Column:
    """A timestamp_ntz literal (time-zone free, foldable, pushes down)."""
    if isinstance(value, dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


# --- driver-side arithmetic on the one-row bounds -------------------------

def to_datetime(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def midnight(value) -> dt.datetime:
    d = to_datetime(value)
    return dt.datetime(d.year, d.month, d.day)


def add_months(value: dt.datetime, months: int) -> dt.datetime:
    """Calendar month offset, day clipped to the month's length (Jan 31 - 1
    month... Feb 28/29; Feb 29 - 12 months -> Feb 28); time of day kept."""
    total = value.year * 12 + (value.month - 1) + months
    y, m = divmod(total, 12)
    day = min(value.day, calendar.monthrange(y, m + 1)[1])
    return value.replace(year=y, month=m + 1, day=day)


def add_years(value: dt.datetime, years: int) -> dt.datetime:
    return add_months(value, 12 * years)


def clamp(value: dt.datetime, lo: dt.datetime, hi: dt.datetime) -> dt.datetime:
    """Midnight of ``value``, then into [lo, hi]."""
    return min(max(midnight(value), lo), hi)


def clamp_date(c: Column, lo: Column, hi: Column) -> Column:
    """Column form of ``clamp``."""
    return F.least(F.greatest(day_start(c), lo), hi)
