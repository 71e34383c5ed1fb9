"""Monthly trend lines and the seasonal ridge forecast.

These operate on the *monthly series* -- one row per calendar month present
-- which is bounded by the calendar span, not by the data volume. The
ordered index over that short series is a ``row_number`` window; all fitting
is done from aggregates of products of deviations, and the band comes from the
residuals themselves; everything stays JVM-side, with the 3x3 ridge solve
written as Column arithmetic (Cramer's rule): nothing is collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.functions import dates as D
from ordertide.operators.joins import computed_once
from ordertide.operators.kpis import money_sum


def _series_window(order_col: str) -> Window:
    # one row per month: the unpartitioned window sees a bounded series
    return Window.orderBy(order_col)


def trend_by_index(monthly: DataFrame, x: str = "order_month", y: str = "sales") -> DataFrame:
    """Least-squares line over the position 0..n-1 of the ordered series;
    adds ``month_index`` and the fitted ``trend`` (NULL when < 2 points)."""
    idx = monthly.withColumn("month_index", F.row_number().over(_series_window(x)) - 1)
    whole = Window.partitionBy()
    slope = F.regr_slope(F.col(y), F.col("month_index").cast("double")).over(whole)
    icpt = F.regr_intercept(F.col(y), F.col("month_index").cast("double")).over(whole)
    return idx.withColumn("trend", slope * F.col("month_index") + icpt)


def trend_by_date(series: DataFrame, x: str = "ds", y: str = "y") -> DataFrame:
    """Line over the ordinal day number; non-finite points are left out of
    the fit but still get a fitted value."""
    ordv = D.day_ordinal(F.col(x)).cast("double")
    yv = F.col(y).cast("double")
    ok = ~F.isnan(yv) & (F.abs(yv) != F.lit(float("inf")))
    whole = Window.partitionBy()
    slope = F.regr_slope(F.when(ok, yv), ordv).over(whole)
    icpt = F.regr_intercept(F.when(ok, yv), ordv).over(whole)
    return series.withColumn("trend", slope * ordv + icpt)


def monthly_series(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """(ds, y): sales per 'YYYY-MM' month, ds = the month's first day; rows
    with NULL dates are left out of the series."""
    ym = D.year_month(F.col(date_col))
    return (df.where(F.col(date_col).isNotNull()).groupBy(ym.alias("year_month"))
            .agg(money_sum("sales").alias("y"))
            .select(D.year_month_start(F.col("year_month")).alias("ds"), "y")
            .where(F.col("ds").isNotNull()))


# --- 3x3 linear algebra on Columns ------------------------------------------

def det3(m):
    return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))


def solve3(m, v):
    """Cramer's rule: returns (x0, x1, x2) with m x = v."""
    d = det3(m)
    out = []
    for j in range(3):
        mj = [[v[i] if k == j else m[i][k] for k in range(3)] for i in range(3)]
        out.append(det3(mj) / d)
    return out


# 12-month season, 6-month horizon, ridge alpha 5, at least
# 8 months to forecast, band of 1.96 residual standard deviations.
SEASON_MONTHS = 12
FORECAST_HORIZON = 6
FORECAST_ALPHA = 5.0
FORECAST_MIN_MONTHS = 8
BAND_Z = 1.96

OMEGA = 2.0 * math.pi / SEASON_MONTHS


def seasonal_terms(t: Column) -> list[Column]:
    return [t, F.sin(F.lit(OMEGA) * t), F.cos(F.lit(OMEGA) * t)]


def forecast_monthly(df: DataFrame, horizon: int = FORECAST_HORIZON, alpha: float = FORECAST_ALPHA,
                     min_months: int = FORECAST_MIN_MONTHS, date_col: str = "order_date") -> DataFrame:
    """Ridge (alpha, free intercept) of monthly sales on [t, sin, cos] with
    t the index of *observed* months (gaps closed up); ``horizon`` future
    month starts with a band of +-1.96 sigma (sigma = residual std, ddof 1;
    sigma 0 -> band equals the forecast). Fewer than ``min_months`` months
    -> history only.

    Output rows: kind='history' (ds, y, fitted) and kind='forecast'
    (ds, yhat, yhat_upper, yhat_lower).
    """
    hist = monthly_series(df, date_col)
    hist = hist.withColumn("t", (F.row_number().over(_series_window("ds")) - 1).cast("double"))
    # one row per month, read by the history rows, the fit and its residuals
    hist = computed_once(hist)
    names = ["x0", "x1", "x2"]
    hx = hist.select("ds", "y", "t", *[c.alias(n) for c, n in zip(seasonal_terms(F.col("t")), names)])
    # centred first: products of deviations keep their digits at any level of y
    every = Window.partitionBy()
    centred = hx.select((F.col("y") - F.avg("y").over(every)).alias("dy"), F.avg("y").over(every).alias("my"), "ds",
                        *[(F.col(n) - F.avg(n).over(every)).alias(f"d{i}") for i, n in enumerate(names)],
                        *[F.avg(n).over(every).alias(f"m{i}") for i, n in enumerate(names)])
    products = centred.agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("ds").alias("last_ds"),
                           *[F.max(c).alias(c) for c in ("my", "m0", "m1", "m2")],  # the same in every row
                           *[F.sum(F.col(f"d{i}") * F.col("dy")).alias(f"v{i}") for i in range(3)],
                           *[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"s{i}{j}")
                             for i in range(3) for j in range(i, 3)])
    m = [[F.col(f"s{min(i, j)}{max(i, j)}") + F.lit(alpha if i == j else 0.0) for j in range(3)] for i in range(3)]
    beta = solve3(m, [F.col(f"v{i}") for i in range(3)])
    coef = products.where(F.col("n") >= min_months).select(
        "n", "last_ds", "my", "m0", "m1", "m2", *[b.alias(f"b{i}") for i, b in enumerate(beta)])
    coef = computed_once(coef)

    def fitted(c, x: list[Column]) -> Column:
        return c("my") + sum((c(f"b{i}") * (x[i] - c(f"m{i}")) for i in range(3)), F.lit(0.0))

    one = coef.select(F.struct("*").alias("c")).scalar()
    residual = hx.select((F.col("y") - fitted(lambda k: one[k], [F.col(n) for n in names])).alias("e"))
    sigma = F.coalesce(residual.agg(F.stddev_samp("e")).scalar(), F.lit(0.0))
    steps = coef.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    yhat = fitted(F.col, seasonal_terms(F.col("n") - 1 + F.col("step")))
    band = F.lit(BAND_Z) * sigma
    fc = steps.select(
        F.lit("forecast").alias("kind"),
        F.add_months(F.col("last_ds").cast("date"), F.col("step")).cast("timestamp_ntz").alias("ds"),
        F.lit(None).cast("double").alias("y"), yhat.alias("yhat"), (yhat + band).alias("yhat_upper"),
        (yhat - band).alias("yhat_lower"))
    history = hist.select(F.lit("history").alias("kind"), "ds", "y",
                          *[F.lit(None).cast("double").alias(c)
                            for c in ("yhat", "yhat_upper", "yhat_lower")])
    return history.unionByName(fc)
