"""Registered queries: each runs a library operator over the whole sales
fact built from the test tables at ``sf_dir``, with fixed dashboard
parameters, and (where SQL can state it) a DuckDB twin."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.functions import dates as D
from ordertide.functions import fmt
from ordertide.operators import filters as FL
from ordertide.operators import groups as G
from ordertide.operators import kpis as K
from ordertide.operators import series as SE
from ordertide.operators.joins import computed_once
from ordertide.operators.table import raw_data
from ordertide.plans.oracle_sql import KEY, with_sales
from ordertide.session import ensure_checkpoint_dir
from ordertide.sources.files import read_sales_file, with_parsed_dates
from ordertide.sources.sinks import write_model_result, write_result
from ordertide.sources.sales import ROW_KEY, SALES_COLUMNS, sales_by_order, sales_view


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


# Fixed dashboard states used by the registered queries.
RANGE = ("1997-03-15", "1999-06-30")
REGIONS = ["ASIA", "EUROPE"]
CATEGORIES = ["STANDARD", "PROMO", "ECONOMY"]
SEGMENTS = ["BUILDING", "MACHINERY", "HOUSEHOLD"]


def _rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Computed doubles as shown: engines differ in the last bits."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _in(col: str, values) -> str:
    return f"{col} IN ({', '.join(repr(v) for v in values)})"


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(*ROW_KEY, "order_date", F.col("sales").cast("double").alias("sales"))


KEYED_SQL = f"{KEY}, order_date, CAST(sales AS DOUBLE) AS sales"
DOUBLE_COLS = ("sales", "profit")


# --- sources -----------------------------------------------------------------

@register("load_sales", with_sales(
    "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in DOUBLE_COLS else c
                          for c in SALES_COLUMNS) + " FROM sales"))
def q_load_sales(spark, d):
    """The whole order-line fact with its derived order month."""
    s = sales_view(spark, d)
    return s.select(*[F.col(c).cast("double").alias(c) if c in DOUBLE_COLS else F.col(c)
                      for c in SALES_COLUMNS])


@register("load_orders_coerced", with_sales(
    f"SELECT {KEY}, order_date, CAST(year(order_date) AS INTEGER) AS year, "
    "'Q' || CAST(quarter(order_date) AS VARCHAR) AS quarter, "
    "CAST(month(order_date) AS INTEGER) AS month_num, strftime(order_date, '%b') AS month, "
    "strftime(order_date, '%Y-%m') AS year_month, CAST(sales AS DOUBLE) AS sales FROM sales"))
def q_load_orders_coerced(spark, d):
    """Order lines whose dates arrive as text, parsed leniently, with the
    calendar columns (year, quarter, month number/name, year-month)."""
    s = sales_view(spark, d)
    text = s.select(*ROW_KEY, F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
                    "sales")
    out = with_parsed_dates(text, mode="lenient", columns=("order_date",))
    return out.select(*ROW_KEY, "order_date", "year", "quarter", "month_num", "month", "year_month",
                      F.col("sales").cast("double").alias("sales"))


@register("raw_data", with_sales(
    f"SELECT {KEY}, strftime(order_date, '%Y-%m-%d') AS order_date, "
    "strftime(ship_date, '%Y-%m-%d') AS ship_date, customer_name, region, category, product_name, "
    "CAST(sales AS DOUBLE) AS sales, quantity FROM sales "
    "ORDER BY sales DESC, order_id, line_number, product_id, supplier_id, extended_price "
    "LIMIT 100 OFFSET 100"))
def q_raw_data(spark, d):
    """Second page (rows 101-200) of detail rows sorted by sales descending."""
    s = sales_view(spark, d).select(*ROW_KEY, "order_date", "ship_date", "customer_name", "region",
                                    "category", "product_name",
                                    F.col("sales").cast("double").alias("sales"), "quantity")
    order = dict(sort=[("sales", False)], key=ROW_KEY, page_size=100)
    last = raw_data(s, **order, display=False).collect()[-1:]  # the first page's last row
    return raw_data(s, **order, after=tuple(last[0][c] for c in ["sales", *ROW_KEY]) if last else None)


@register("date_parts", with_sales(
    "SELECT order_date, order_month, CAST(year(order_date) AS INTEGER) AS year, "
    "'Q' || CAST(quarter(order_date) AS VARCHAR) AS quarter, "
    "CAST(month(order_date) AS INTEGER) AS month_num, strftime(order_date, '%b') AS month, "
    "strftime(order_date, '%Y-%m') AS year_month, "
    "CAST(date_diff('day', DATE '0001-01-01', CAST(order_date AS DATE)) + 1 AS INTEGER) AS day_ordinal, "
    "strftime(order_date, '%Y-%m-%d') AS date_text "
    "FROM (SELECT DISTINCT order_date, order_month FROM sales)"))
def q_date_parts(spark, d):
    """Every derived calendar column for each distinct order date."""
    s = sales_view(spark, d).select("order_date", "order_month").distinct()
    c = F.col("order_date")
    return s.select("order_date", "order_month", D.year(c).alias("year"),
                    D.quarter_label(c).alias("quarter"), D.month_num(c).alias("month_num"),
                    D.month_abbr(c).alias("month"), D.year_month(c).alias("year_month"),
                    D.day_ordinal(c).alias("day_ordinal"), D.date_text(c).alias("date_text"))


# --- filters -------------------------------------------------------------------

@register("filter_date_range", with_sales(
    f"SELECT {KEYED_SQL} FROM sales WHERE CAST(order_date AS DATE) BETWEEN DATE '{RANGE[0]}' "
    f"AND DATE '{RANGE[1]}'"))
def q_filter_date_range(spark, d):
    """Rows with order date in a calendar-date range, inclusive."""
    return _keyed(FL.filter_date_range(sales_view(spark, d), *RANGE))


@register("filter_in_dims", with_sales(
    f"SELECT {KEYED_SQL} FROM sales WHERE {_in('region', REGIONS)} AND "
    f"{_in('category', CATEGORIES)} AND {_in('segment', SEGMENTS)}"))
def q_filter_in_dims(spark, d):
    """Rows in the chosen regions, categories and segments."""
    return _keyed(FL.filter_in_dims(sales_view(spark, d), REGIONS, CATEGORIES, SEGMENTS))


_PRESET_SQL_CTE = """b AS (SELECT date_trunc('day', min(order_date)) AS lo,
                     date_trunc('day', max(order_date)) AS hi FROM sales)"""


@register("filter_preset", with_sales(
    f"SELECT {KEYED_SQL} FROM sales, b "
    "WHERE order_date >= greatest(least(b.hi - INTERVAL 3 MONTH, b.hi), b.lo) "
    "AND order_date < b.hi + INTERVAL 1 DAY", _PRESET_SQL_CTE))
def q_filter_preset(spark, d):
    """'last_quarter' preset: anchor (max date) minus 3 months .. anchor,
    clamped to the data's dates."""
    return _keyed(FL.filter_preset(sales_view(spark, d), "last_quarter"))


@register("filter_preset_last_year", with_sales(
    f"SELECT {KEYED_SQL} FROM sales, b "
    "WHERE order_date >= greatest(least(b.hi - INTERVAL 1 YEAR, b.hi), b.lo) "
    "AND order_date < b.hi + INTERVAL 1 DAY", _PRESET_SQL_CTE))
def q_filter_preset_last_year(spark, d):
    """'last_year' preset (the one-page dashboards' default state)."""
    return _keyed(FL.filter_preset(sales_view(spark, d), "last_year"))


@register("filter_trailing_preset", with_sales(
    f"SELECT {KEYED_SQL} FROM sales, (SELECT max(order_date) AS mx FROM sales) m "
    "WHERE order_date >= m.mx - INTERVAL 2 YEAR AND order_date <= m.mx"))
def q_filter_trailing_preset(spark, d):
    """LAST_2Y: [max - 2 years, max] at timestamp precision."""
    return _keyed(FL.filter_trailing_preset(sales_view(spark, d), "LAST_2Y"))


def _span_sql(name: str, start: str, end: str, cast: str) -> str:
    c = f"CAST(order_date AS {cast})"
    return (f"SELECT '{name}' AS preset, CAST({start} AS TIMESTAMP) AS start_ts, CAST({end} AS TIMESTAMP) AS end_ts, "
            f"count(*) AS rows, CAST(coalesce(sum(sales), 0) AS DOUBLE) AS sales FROM sales, b "
            f"WHERE {c} BETWEEN {start} AND {end} GROUP BY ALL")


_DAY_SPANS = {"today": "0 DAY", "last_week": "6 DAY", "last_month": "29 DAY", "last_quarter": "3 MONTH", "last_6_months": "6 MONTH",
              "last_year": "1 YEAR", "last_2_years": "2 YEAR", "last_3_years": "3 YEAR", "all_time": "200 YEAR"}
_TRAILING_SPANS = {"LAST_60D": "60 DAY", "LAST_90D": "90 DAY", "LAST_180D": "180 DAY", "LAST_1Y": "1 YEAR", "LAST_2Y": "2 YEAR",
                   "LAST_3Y": "3 YEAR", "LAST_5Y": "5 YEAR"}


@register("preset_table", with_sales(" UNION ALL ".join(
    [_span_sql(n, f"greatest(CAST(hi - INTERVAL {x} AS DATE), CAST(lo AS DATE))", "CAST(hi AS DATE)", "DATE")
     for n, x in _DAY_SPANS.items()]
    + [_span_sql(n, f"(hi - INTERVAL {x})", "hi", "TIMESTAMP") for n, x in _TRAILING_SPANS.items()]
    + [_span_sql("custom", f"DATE '{RANGE[0]}'", f"DATE '{RANGE[1]}'", "DATE")]),
    "b AS (SELECT min(order_date) AS lo, max(order_date) AS hi FROM sales)"))
def q_preset_table(spark, d):
    """Every preset's limits with the rows and sales within them."""
    s = sales_view(spark, d)
    lo, hi = FL.bounds(s)
    c, day = F.col("order_date"), dt.timedelta(days=1)
    spans = []
    for n in [*_DAY_SPANS, "custom"]:
        first, last = FL.resolve_preset(n, lo, hi, RANGE)
        end = D.to_datetime(last)
        spans.append((n, F.lit(str(first)).cast("timestamp_ntz"), F.lit(str(last)).cast("timestamp_ntz"),
                      (c >= D.ts_literal(D.midnight(D.to_datetime(first)))) & (c < D.ts_literal(D.midnight(end) + day))))
    for n in _TRAILING_SPANS:
        start = FL.trailing_start(n, hi)
        spans.append((n, D.ts_literal(start), D.ts_literal(hi), (c >= D.ts_literal(start)) & (c <= D.ts_literal(hi))))
    # one pass: a conditional count and sum for each preset
    sums = s.agg(*[x for i, (*_, within) in enumerate(spans) for x in (
        F.count(F.when(within, F.lit(1))).alias(f"n{i}"), K.money_sum(F.when(within, F.col("sales"))).alias(f"s{i}"))])
    return sums.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("preset"), a.alias("start_ts"), b.alias("end_ts"), F.col(f"n{i}").alias("rows"), F.col(f"s{i}").alias("sales"))
        for i, (n, a, b, _) in enumerate(spans)])).alias("p")).select("p.*")


# Text files below the session's checkpoint folder: written from the fact, read back.
_BAD_DATES = "CASE order_id % 50 WHEN 0 THEN NULL WHEN 7 THEN NULL ELSE date_trunc('second', order_date) END"


def _text_lines(spark, d):
    bad = F.when(F.col("order_id") % 50 == 0, F.lit("1998-13-45")).when(F.col("order_id") % 50 == 7, F.lit("soon"))
    return sales_view(spark, d).select(
        *ROW_KEY, F.coalesce(bad, F.date_format("order_date", "yyyy-MM-dd HH:mm:ss")).alias("order_date"),
        F.date_format("ship_date", "yyyy-MM-dd").alias("ship_date"), "region", F.col("sales").cast("double").alias("sales"))


def _file_query(fmt: str):
    def q(spark, d):
        path = f"{ensure_checkpoint_dir(spark)}/order-lines-{fmt}-{uuid.uuid4().hex}"
        lines = _text_lines(spark, d)
        # a task's lines are a file, read by a task again: gzip costs no parallelism, and the text is most of the disk used
        write_result(lines, path, fmt, compression="gzip", **({"header": "true"} if fmt == "csv" else {}))
        out = read_sales_file(spark, path, lines.schema, fmt, mode="lenient")
        return out.select(*ROW_KEY, "order_date", "ship_date", "region", "sales", "order_month", "quarter")
    q.__doc__ = f"Order lines written as {fmt.upper()} text, some with unreadable dates, and read back leniently."
    return q


_FILE_SQL = with_sales(
    f"SELECT {KEY}, order_date, ship_date, region, sales, date_trunc('month', order_date)::TIMESTAMP AS order_month, "
    f"'Q' || quarter(order_date) AS quarter FROM (SELECT {KEY}, {_BAD_DATES} AS order_date, "
    "CAST(CAST(ship_date AS DATE) AS TIMESTAMP) AS ship_date, region, CAST(sales AS DOUBLE) AS sales FROM sales)")
for _fmt in ("csv", "json"):
    register(f"read_sales_{_fmt}", _FILE_SQL)(_file_query(_fmt))


@register("records_sink", with_sales("SELECT region, CAST(sum(sales) AS DOUBLE) AS sales FROM sales WHERE region IS NOT NULL GROUP BY region"))
def q_records_sink(spark, d):
    """Sales by region written as JSON records and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    out = G.sales_by_region(sales_view(spark, d))
    write_result(out, path, "json")
    return spark.read.schema(out.schema).json(path)


@register("model_result_sink", with_sales(
    "SELECT 'linear' AS model, count(*) AS rows, (SELECT string_agg(c, ',') FROM (VALUES ('postal_code')) v(c)) AS features "
    "FROM sales WHERE isfinite(CAST(sales AS DOUBLE))"))
def q_model_result_sink(spark, d):
    """A model's result tables written and read back: its rows and the features used."""
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    write_model_result(_fit(spark, d, "linear:postal_code"), path)
    names = spark.read.parquet(f"{path}/features").agg(F.array_join(F.sort_array(F.collect_list("column")), ",").alias("features"))
    return spark.read.parquet(f"{path}/metrics").select("model", "rows", names.scalar().alias("features"))


@register("filter_trailing_preset_90d", with_sales(
    f"SELECT {KEYED_SQL} FROM sales, (SELECT max(order_date) AS mx FROM sales) m "
    "WHERE order_date >= m.mx - INTERVAL 90 DAY AND order_date <= m.mx"))
def q_filter_trailing_preset_90d(spark, d):
    """LAST_90D: [max - 90 days, max]."""
    return _keyed(FL.filter_trailing_preset(sales_view(spark, d), "LAST_90D"))


@register("filter_calendar", with_sales(
    f"SELECT {KEYED_SQL} FROM sales WHERE year(order_date) = 1999 AND quarter(order_date) = 2"))
def q_filter_calendar(spark, d):
    """Year 1999, quarter Q2."""
    return _keyed(FL.filter_calendar(sales_view(spark, d), year=1999, quarter="Q2"))


@register("apply_filters", with_sales(
    f"SELECT {KEYED_SQL} FROM sales, (SELECT max(order_date) AS mx FROM sales) m "
    "WHERE order_date >= m.mx - INTERVAL 5 YEAR AND order_date <= m.mx "
    "AND year(order_date) = 2000 AND month(order_date) = 3 "
    "AND region IN ('AMERICA', 'ASIA') AND segment IN ('AUTOMOBILE')"))
def q_apply_filters(spark, d):
    """LAST_5Y, then year 2000, month 3, then regions and segment."""
    return _keyed(FL.apply_filters(sales_view(spark, d), year=2000, month=3, preset="LAST_5Y",
                                   regions=["AMERICA", "ASIA"], segments=["AUTOMOBILE"]))


@register("finite_sales", with_sales(
    f"SELECT {KEYED_SQL} FROM sales WHERE isfinite(CAST(sales AS DOUBLE))"))
def q_finite_sales(spark, d):
    """Rows whose sales is a finite number."""
    return _keyed(FL.finite_rows(sales_view(spark, d), "sales"))


@register("date_bounds", with_sales(
    "SELECT min(order_date) AS min_date, max(order_date) AS max_date, "
    "date_trunc('day', max(order_date)) AS anchor_date FROM sales"))
def q_date_bounds(spark, d):
    """First and last order date and the anchor day."""
    return FL.date_bounds(sales_view(spark, d))


def _opts(col):
    return with_sales(f"SELECT DISTINCT {col} FROM sales WHERE {col} IS NOT NULL")


@register("region_options", _opts("region"))
def q_region_options(spark, d):
    """Sorted distinct regions."""
    return FL.dim_options(sales_view(spark, d), "region")


@register("category_options", _opts("category"))
def q_category_options(spark, d):
    """Sorted distinct categories."""
    return FL.dim_options(sales_view(spark, d), "category")


@register("segment_options", _opts("segment"))
def q_segment_options(spark, d):
    """Sorted distinct segments."""
    return FL.dim_options(sales_view(spark, d), "segment")


@register("year_options", with_sales(
    "SELECT DISTINCT CAST(year(order_date) AS INTEGER) AS year FROM sales WHERE order_date IS NOT NULL"))
def q_year_options(spark, d):
    """Sorted distinct order years."""
    return FL.year_options(sales_view(spark, d))


@register("quarter_options", with_sales(
    "SELECT DISTINCT 'Q' || CAST(quarter(order_date) AS VARCHAR) AS quarter FROM sales "
    "WHERE year(order_date) = 2001"))
def q_quarter_options(spark, d):
    """Quarters present in 2001."""
    return FL.quarter_options(sales_view(spark, d), year=2001)


@register("month_options", with_sales(
    "SELECT DISTINCT CAST(month(order_date) AS INTEGER) AS month_num, strftime(order_date, '%b') AS month "
    "FROM sales WHERE year(order_date) = 2000 AND quarter(order_date) = 3"))
def q_month_options(spark, d):
    """(month number, month name) pairs present in 2000 Q3."""
    return FL.month_options(sales_view(spark, d), year=2000, quarter="Q3")


# --- KPIs ----------------------------------------------------------------------

KPI_SQL = ("CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS total_sales, "
           "CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS total_profit, "
           "COUNT(DISTINCT order_id) AS order_count, COUNT(DISTINCT customer_id) AS customer_count, "
           "COUNT(*) AS row_count")


@register("kpi_totals", with_sales(f"SELECT {KPI_SQL} FROM sales"))
def q_kpi_totals(spark, d):
    """Totals over the whole table."""
    return K.kpi_totals(sales_view(spark, d))


@register("kpi_totals_filtered", with_sales(
    f"SELECT {KPI_SQL} FROM sales WHERE CAST(order_date AS DATE) BETWEEN DATE '{RANGE[0]}' "
    f"AND DATE '{RANGE[1]}' AND {_in('region', REGIONS)} AND {_in('segment', SEGMENTS)}"))
def q_kpi_totals_filtered(spark, d):
    """Totals after a date range and dimension filters."""
    s = FL.filter_in_dims(FL.filter_date_range(sales_view(spark, d), *RANGE),
                          regions=REGIONS, segments=SEGMENTS)
    return K.kpi_totals(s)


@register("kpi_cards_text", with_sales(
    "SELECT '$' || format('{:,.0f}', total_sales) AS sales_text, "
    "'$' || format('{:,.0f}', total_profit) AS profit_text, format('{:,}', order_count) AS orders_text, "
    "format('{:,}', customer_count) AS customers_text, format('{:,}', row_count) AS rows_text "
    f"FROM (SELECT {KPI_SQL} FROM sales, b WHERE order_date >= greatest(least(b.hi - INTERVAL 1 YEAR, b.hi), b.lo) "
    "AND order_date < b.hi + INTERVAL 1 DAY)", _PRESET_SQL_CTE))
def q_kpi_cards_text(spark, d):
    """KPI card texts of the one-page dashboard in its default state
    ('last_year' preset, no dimension filter)."""
    k = K.kpi_totals(FL.filter_preset(sales_view(spark, d), "last_year"))
    return k.select(fmt.currency0(F.col("total_sales")).alias("sales_text"),
                    fmt.currency0(F.col("total_profit")).alias("profit_text"),
                    fmt.count_text(F.col("order_count")).alias("orders_text"),
                    fmt.count_text(F.col("customer_count")).alias("customers_text"),
                    fmt.count_text(F.col("row_count")).alias("rows_text"))


def _ytd_clamped_sql(end: str, dims: str) -> str:
    return with_sales(f"""
SELECT ytd_sales, lytd_sales, CASE WHEN lytd_sales <> 0 THEN (ytd_sales - lytd_sales) / lytd_sales END AS yoy_pct,
       e AS through_date
FROM (
  SELECT CAST(COALESCE(SUM(CASE WHEN order_date >= ys AND order_date <= e THEN sales END), 0) AS DOUBLE) AS ytd_sales,
         CAST(COALESCE(SUM(CASE WHEN order_date >= ls AND order_date <= le THEN sales END), 0) AS DOUBLE) AS lytd_sales,
         any_value(e) AS e
  FROM w LEFT JOIN (SELECT * FROM sales WHERE {dims}) s ON TRUE
)""", _PRESET_SQL_CTE + """,
e0 AS (SELECT least(greatest(TIMESTAMP '""" + end + """', lo), hi) AS e, lo, hi FROM b),
y0 AS (SELECT e, lo, hi, least(greatest(make_timestamp(year(e), 1, 1, 0, 0, 0), lo), hi) AS ys,
              least(greatest(e - INTERVAL 1 YEAR, lo), hi) AS le FROM e0),
w AS (SELECT e, ys, le, least(greatest(make_timestamp(year(le), 1, 1, 0, 0, 0), lo), hi) AS ls FROM y0)""")


@register("ytd_metrics_clamped", _ytd_clamped_sql("2000-03-15 00:00:00", _in("region", REGIONS)))
def q_ytd_metrics_clamped(spark, d):
    """YTD/LYTD/YoY through 2000-03-15 for two regions, bounds clamped to
    the data's dates."""
    s = sales_view(spark, d)
    b = FL.bounds(s)
    return K.ytd_metrics_clamped(FL.filter_in_dims(s, regions=REGIONS), "2000-03-15", b)


@register("ytd_metrics_clamped_early", _ytd_clamped_sql("1995-06-30 00:00:00", "TRUE"))
def q_ytd_metrics_clamped_early(spark, d):
    """YTD through 1995-06-30: last year precedes the data, so both LYTD
    bounds clamp to the first day and LYTD is that day's sales."""
    s = sales_view(spark, d)
    return K.ytd_metrics_clamped(s, "1995-06-30", FL.bounds(s))


def _ytd_anchored_sql(base_where: str, pred: str) -> str:
    sums = f"""
  SELECT CAST(COALESCE(SUM(CASE WHEN {pred} THEN sales END), 0) AS DOUBLE) AS total_sales,
         COUNT(DISTINCT CASE WHEN {pred} THEN customer_id END) AS customer_count,
         COUNT(DISTINCT CASE WHEN {pred} THEN order_id END) AS order_count,
         CAST(COALESCE(SUM(CASE WHEN order_date >= make_timestamp(year(a), 1, 1, 0, 0, 0) AND order_date <= a
                                THEN sales END), 0) AS DOUBLE) AS ytd_sales,
         CAST(COALESCE(SUM(CASE WHEN order_date >= make_timestamp(year(a - INTERVAL 1 YEAR), 1, 1, 0, 0, 0)
                                 AND order_date <= a - INTERVAL 1 YEAR THEN sales END), 0) AS DOUBLE) AS lytd_sales,
         any_value(a) AS anchor_date
  FROM base, an"""
    return with_sales(
        "SELECT total_sales, customer_count, order_count, ytd_sales, lytd_sales, "
        "CASE WHEN lytd_sales <> 0 THEN (ytd_sales - lytd_sales) / lytd_sales END AS yoy_pct, anchor_date "
        f"FROM ({sums})",
        f"""base AS (SELECT * FROM sales WHERE {base_where}),
an AS (SELECT coalesce((SELECT max(order_date) FROM base WHERE {pred}),
                       (SELECT max(order_date) FROM base)) AS a)""")


@register("ytd_metrics_anchored", _ytd_anchored_sql("TRUE", "TRUE"))
def q_ytd_metrics_anchored(spark, d):
    """Six-tab KPIs in the default state (all time, no filters)."""
    return K.ytd_metrics_anchored(sales_view(spark, d), None)


@register("ytd_metrics_anchored_filtered", _ytd_anchored_sql(
    "region IN ('EUROPE')", "year(order_date) = 1999 AND quarter(order_date) = 2"))
def q_ytd_metrics_anchored_filtered(spark, d):
    """Six-tab KPIs for EUROPE with year 1999 / Q2 selected: anchor is the
    last date of the filtered rows; YTD/LYTD run over all EUROPE rows."""
    base = FL.filter_in_dims(sales_view(spark, d), regions=["EUROPE"])
    pred = FL.time_predicate(base, year=1999, quarter="Q2")
    return K.ytd_metrics_anchored(base, pred)


# --- grouped measures ------------------------------------------------------------

def _by_sql(key: str, where: str = "TRUE") -> str:
    return with_sales(f"SELECT {key}, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales FROM sales "
                      f"WHERE {key} IS NOT NULL AND {where} GROUP BY {key}")


@register("sales_by_month", _by_sql("order_month"))
def q_sales_by_month(spark, d):
    """Sales per month over all rows."""
    return G.sales_by_month(sales_view(spark, d))


@register("sales_by_region", _by_sql("region"))
def q_sales_by_region(spark, d):
    """Sales per region."""
    return G.sales_by_region(sales_view(spark, d))


@register("sales_by_category", _by_sql("category"))
def q_sales_by_category(spark, d):
    """Sales per category."""
    return G.sales_by_category(sales_view(spark, d))


@register("region_share", with_sales(
    "SELECT region, CAST(sales AS DOUBLE) AS sales, CAST(sales AS DOUBLE) / CAST(SUM(sales) OVER () AS DOUBLE) "
    "AS share FROM (SELECT region, COALESCE(SUM(sales), 0) AS sales FROM sales "
    "WHERE region IS NOT NULL GROUP BY region)"))
def q_region_share(spark, d):
    """Each region's share of total sales (the pie)."""
    return G.region_share(sales_view(spark, d))


def _top_sql(key: str, n: int = 10) -> str:
    return with_sales(f"SELECT {key}, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales FROM sales "
                      f"WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY sales DESC, {key} LIMIT {n}")


@register("top_n_subcategories", _top_sql("sub_category"))
def q_top_n_subcategories(spark, d):
    """Ten sub-categories with the most sales."""
    return G.top_n_subcategories(sales_view(spark, d))


@register("top_n_states", _top_sql("state"))
def q_top_n_states(spark, d):
    """Ten states with the most sales."""
    return G.top_n_states(sales_view(spark, d))


@register("top_n_products", _top_sql("product_name"))
def q_top_n_products(spark, d):
    """Ten products with the most sales."""
    return G.top_n_products(sales_view(spark, d))


@register("product_share", with_sales(
    "SELECT product_name, CAST(sales AS DOUBLE) AS sales, "
    "CAST(sales AS DOUBLE) / CAST(SUM(sales) OVER () AS DOUBLE) AS share FROM ("
    "SELECT product_name, COALESCE(SUM(sales), 0) AS sales FROM sales "
    "WHERE product_name IS NOT NULL GROUP BY product_name ORDER BY sales DESC, product_name LIMIT 10)"))
def q_product_share(spark, d):
    """Share of each top-10 product within the ten shown."""
    return G.product_share(sales_view(spark, d))


@register("top_customers", with_sales(
    "SELECT customer_name, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales, "
    "CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS profit, COUNT(DISTINCT order_id) AS orders "
    "FROM sales WHERE customer_name IS NOT NULL GROUP BY customer_name "
    "ORDER BY sales DESC, customer_name LIMIT 10"))
def q_top_customers(spark, d):
    """Ten customers (by name) with the most sales, with profit and orders."""
    return G.top_customers(sales_by_order(spark, d))


_PRODUCT_MEASURES_SQL = ("SELECT product_name, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales, "
                         "CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS profit, "
                         "COALESCE(SUM(quantity), 0.0) AS quantity FROM sales "
                         "WHERE product_name IS NOT NULL GROUP BY product_name")
_ORDERS_PER_PRODUCT_SQL = ("SELECT product_name, COUNT(DISTINCT order_id) AS orders FROM sales "
                           "WHERE product_name IS NOT NULL GROUP BY product_name")


@register("product_measures", with_sales(_PRODUCT_MEASURES_SQL))
def q_product_measures(spark, d):
    """Sales, profit and quantity per product name (the pivot table)."""
    return G.product_measures(sales_view(spark, d))


@register("orders_per_product", with_sales(_ORDERS_PER_PRODUCT_SQL))
def q_orders_per_product(spark, d):
    """Distinct orders per product name."""
    return G.orders_per_product(sales_by_order(spark, d))


@register("left_join_orders_per_product", with_sales(
    "SELECT m.product_name, m.sales, m.profit, m.quantity, COALESCE(o.orders, 0) AS orders "
    "FROM m LEFT JOIN o ON m.product_name = o.product_name",
    f"m AS ({_PRODUCT_MEASURES_SQL}), o AS ({_ORDERS_PER_PRODUCT_SQL})"))
def q_left_join_orders_per_product(spark, d):
    """Product measures LEFT JOIN distinct orders per product."""
    return G.left_join_orders_per_product(sales_by_order(spark, d))


_TOP_PIVOT_SQL = with_sales(
    "SELECT m.product_name, m.sales, m.profit, m.quantity, COALESCE(o.orders, 0) AS orders "
    "FROM m LEFT JOIN o ON m.product_name = o.product_name ORDER BY m.sales DESC, m.product_name LIMIT 10",
    f"m AS ({_PRODUCT_MEASURES_SQL}), o AS ({_ORDERS_PER_PRODUCT_SQL})")


@register("top_products_pivot", _TOP_PIVOT_SQL)
def q_top_products_pivot(spark, d):
    """Top-10 products table (one fused aggregate)."""
    return G.top_products_pivot(sales_by_order(spark, d), method="fused")


@register("top_products_pivot_join", _TOP_PIVOT_SQL)
def q_top_products_pivot_join(spark, d):
    """Top-10 products table through the explicit left join."""
    return G.top_products_pivot(sales_by_order(spark, d), method="join")


def _hier_sql(parent: str, child: str) -> str:
    return with_sales(
        f"SELECT {parent} AS parent, {child} AS child, GROUPING_ID({parent}, {child}) AS level, "
        f"CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales FROM sales "
        f"WHERE {parent} IS NOT NULL AND {child} IS NOT NULL GROUP BY ROLLUP({parent}, {child})")


def _make_hier(name, parent, child):
    @register(f"sales_hierarchy_{name}", _hier_sql(parent, child))
    def q(spark, d):
        return G.sales_hierarchy(sales_view(spark, d), parent, child)
    q.__doc__ = f"Rollup of sales by {parent} / {child} (sunburst)."
    return q


for _n, (_p, _c) in G.HIERARCHIES.items():
    _make_hier(_n, _p, _c)


@register("group_features", with_sales(
    "SELECT region, category, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales, "
    "CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS profit, "
    "CAST(SUM(CAST(discount AS DECIMAL(28,12))) AS DOUBLE) / COUNT(discount) AS discount, "
    "COALESCE(SUM(quantity), 0.0) AS quantity, COUNT(DISTINCT order_id) AS order_count, "
    "COUNT(DISTINCT customer_id) AS customer_count FROM sales "
    "WHERE region IS NOT NULL AND category IS NOT NULL GROUP BY region, category"))
def q_group_features(spark, d):
    """Per region x category: the six clustering measures."""
    return G.group_features(sales_by_order(spark, d))


# --- series ------------------------------------------------------------------------

_FLAG_WHERE = (f"CAST(order_date AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}' "
               f"AND {_in('region', REGIONS)}")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Date range + regions -> sales by month -> index trend line."""
    s = FL.filter_in_dims(FL.filter_date_range(sales_view(spark, d), *RANGE), regions=REGIONS)
    return _rounded(SE.trend_by_index(G.sales_by(s, "order_month")), 2, "trend")


@register("trend_by_index", with_sales(
    "SELECT order_month, sales, month_index, "
    "round(regr_slope(sales, month_index) OVER () * month_index + regr_intercept(sales, month_index) OVER (), 2) "
    "AS trend FROM (SELECT *, CAST(row_number() OVER (ORDER BY order_month) - 1 AS INTEGER) AS month_index "
    "FROM (SELECT order_month, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales FROM sales "
    f"WHERE order_month IS NOT NULL AND {_FLAG_WHERE} GROUP BY order_month))"))
def q_trend_by_index(spark, d):
    """Monthly sales of a filtered view with its least-squares trend over the
    month position (the flagship panel)."""
    return flagship(spark, d)


def _monthly_sql(where: str = "TRUE") -> str:
    return ("SELECT CAST(strptime(ym || '-01', '%Y-%m-%d') AS TIMESTAMP) AS ds, y FROM ("
            "SELECT strftime(order_date, '%Y-%m') AS ym, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS y "
            f"FROM sales WHERE order_date IS NOT NULL AND {where} GROUP BY ym)")


_MONTHLY_SQL = _monthly_sql()


@register("trend_by_date", with_sales(
    "SELECT ds, y, round(regr_slope(y, o) OVER () * o + regr_intercept(y, o) OVER (), 2) AS trend FROM ("
    "SELECT ds, y, CAST(date_diff('day', DATE '0001-01-01', CAST(ds AS DATE)) + 1 AS DOUBLE) AS o "
    f"FROM ({_MONTHLY_SQL}))"))
def q_trend_by_date(spark, d):
    """Monthly series with a trend line over the ordinal day number."""
    return _rounded(SE.trend_by_date(SE.monthly_series(sales_view(spark, d))), 2, "trend")


def _forecast_sql(horizon=6, alpha=5.0, min_months=8, where: str = "TRUE") -> str:
    """Ridge on (t, sin, cos) by elimination, one unknown after the other, on
    means of products; the band from the residuals row by row."""
    w = SE.OMEGA
    body = f"""hist AS (SELECT ds, y, CAST(row_number() OVER (ORDER BY ds) - 1 AS DOUBLE) AS t FROM ({_monthly_sql(where)})),
h AS (SELECT ds, y, t, sin({w!r} * t) AS u, cos({w!r} * t) AS v FROM hist),
s AS (SELECT count(*) AS n, max(ds) AS last_ds, avg(y) AS my, avg(t) AS mt, avg(u) AS mu, avg(v) AS mv,
  regr_sxx(t, t) + {alpha!r} AS a11, regr_sxy(u, t) AS a12, regr_sxy(v, t) AS a13, regr_sxy(y, t) AS c1,
  regr_sxx(u, u) + {alpha!r} AS a22, regr_sxy(v, u) AS a23, regr_sxy(y, u) AS c2,
  regr_sxx(v, v) + {alpha!r} AS a33, regr_sxy(y, v) AS c3 FROM h),
e1 AS (SELECT *, a22 - a12 * a12 / a11 AS b22, a23 - a12 * a13 / a11 AS b23, c2 - a12 * c1 / a11 AS d2,
  a33 - a13 * a13 / a11 AS b33, c3 - a13 * c1 / a11 AS d3 FROM s),
e2 AS (SELECT *, (d3 - b23 * d2 / b22) / (b33 - b23 * b23 / b22) AS kv FROM e1),
e3 AS (SELECT *, (d2 - b23 * kv) / b22 AS ku FROM e2),
fit AS (SELECT *, (c1 - a12 * ku - a13 * kv) / a11 AS kt FROM e3 WHERE n >= {min_months}),
res AS (SELECT stddev_samp(y - (my + kt * (t - mt) + ku * (u - mu) + kv * (v - mv))) AS sigma FROM h, fit),
fc AS (SELECT last_ds, step, my + kt * (n - 1 + step - mt) + ku * (sin({w!r} * (n - 1 + step)) - mu)
  + kv * (cos({w!r} * (n - 1 + step)) - mv) AS yhat, 1.96 * sigma AS band FROM fit, res, range(1, {horizon + 1}) r(step))"""
    return with_sales(
        "SELECT 'history' AS kind, ds, y, CAST(NULL AS DOUBLE) AS yhat, CAST(NULL AS DOUBLE) AS yhat_upper, "
        "CAST(NULL AS DOUBLE) AS yhat_lower FROM hist UNION ALL "
        "SELECT 'forecast', CAST(last_ds + to_months(CAST(step AS INTEGER)) AS TIMESTAMP), NULL, round(yhat, 2), "
        "round(yhat + band, 2), round(yhat - band, 2) FROM fc", body)


@register("forecast_monthly", _forecast_sql())
def q_forecast_monthly(spark, d):
    """Monthly history plus a 6-month seasonal ridge forecast with a band."""
    return _rounded(SE.forecast_monthly(sales_view(spark, d)), 2, "yhat", "yhat_upper", "yhat_lower")


@register("forecast_monthly_filtered", _forecast_sql(
    where="order_date >= (SELECT max(order_date) FROM sales) - INTERVAL 3 YEAR "
          "AND order_date <= (SELECT max(order_date) FROM sales) AND region IN ('ASIA')"))
def q_forecast_monthly_filtered(spark, d):
    """Forecast on a filtered view (LAST_3Y, ASIA) -- exercises gaps closed
    up by the observed-month index."""
    s = FL.apply_filters(sales_view(spark, d), preset="LAST_3Y", regions=["ASIA"])
    return _rounded(SE.forecast_monthly(s), 2, "yhat", "yhat_upper", "yhat_lower")


# --- distributions -------------------------------------------------------------------

from ordertide.operators import dist as DI  # noqa: E402

_FINITE = "isfinite(CAST(sales AS DOUBLE))"


@register("sales_quantile", with_sales(
    f"SELECT count(*) AS n, quantile_cont(CAST(sales AS DOUBLE), 0.75) AS quantile FROM sales WHERE {_FINITE}"))
def q_sales_quantile(spark, d):
    """Exact 0.75 quantile of sales (linear interpolation)."""
    return DI.sales_quantile(sales_view(spark, d), 0.75)


@register("histogram", with_sales("""
SELECT b.bin, st.lo + b.bin * st.w AS bin_lo, st.lo + (b.bin + 1) * st.w AS bin_hi, COALESCE(c.cnt, 0) AS count
FROM st, (SELECT CAST(range AS INTEGER) AS bin FROM range((SELECT k FROM st))) b
LEFT JOIN (SELECT CAST(least(floor((x - lo) / w), k - 1) AS INTEGER) AS bin, count(*) AS cnt
           FROM v, st GROUP BY 1) c ON b.bin = c.bin""", f"""v AS (SELECT CAST(sales AS DOUBLE) AS x FROM sales WHERE {_FINITE}),
st0 AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi FROM v),
st AS (SELECT lo, greatest(10, least(60, CAST(floor(sqrt(n)) AS INTEGER))) AS k,
              (hi - lo) / greatest(10, least(60, CAST(floor(sqrt(n)) AS INTEGER))) AS w FROM st0)"""))
def q_histogram(spark, d):
    """Sales histogram, clamp(floor(sqrt n), 10, 60) equal-width bins."""
    return DI.histogram(sales_view(spark, d), "sales")


@register("rug", with_sales(f"SELECT {KEY}, CAST(sales AS DOUBLE) AS sales FROM sales WHERE {_FINITE}"))
def q_rug(spark, d):
    """Every finite sales value with its row key (the rug marks)."""
    return DI.rug(sales_view(spark, d), "sales", ROW_KEY)


def _hazen(p: float) -> str:
    return f"least(greatest(CAST({p} AS DOUBLE) * CAST(n AS DOUBLE) - 0.5, 0.0), CAST(n AS DOUBLE) - 1)"


def _interp(h: str) -> str:
    return (f"CASE WHEN {h} - floor({h}) = 0 THEN max(CASE WHEN pos = floor({h}) THEN x END) ELSE "
            f"max(CASE WHEN pos = floor({h}) THEN x END) + (max(CASE WHEN pos = ceil({h}) THEN x END) - "
            f"max(CASE WHEN pos = floor({h}) THEN x END)) * max({h} - floor({h})) END")


_BOX_CTE = f"""v AS (SELECT category AS g, CAST(sales AS DOUBLE) AS x,
                     row_number() OVER (PARTITION BY category ORDER BY CAST(sales AS DOUBLE), {KEY}) - 1 AS pos,
                     count(*) OVER (PARTITION BY category) AS n
              FROM sales WHERE category IS NOT NULL AND {_FINITE}),
q AS (SELECT g, max(n) AS n, {_interp(_hazen(0.25)).replace('max(CASE', 'max(CASE')} AS q1,
             {_interp(_hazen(0.5))} AS median, {_interp(_hazen(0.75))} AS q3
      FROM v GROUP BY g, n),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)"""


@register("box_stats", with_sales("""
SELECT f.g AS category, f.n, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence,
       min(CASE WHEN v.x >= f.lower_fence AND v.x <= f.upper_fence THEN v.x END) AS whisker_low,
       max(CASE WHEN v.x >= f.lower_fence AND v.x <= f.upper_fence THEN v.x END) AS whisker_high,
       count(CASE WHEN NOT (v.x >= f.lower_fence AND v.x <= f.upper_fence) THEN 1 END) AS outliers
FROM f JOIN v ON f.g = v.g
GROUP BY f.g, f.n, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence""", _BOX_CTE))
def q_box_stats(spark, d):
    """Box-and-whisker numbers of sales per first usable group (category)."""
    s = sales_view(spark, d)
    g = FL.first_usable_group(s)
    return DI.box_stats(s, "sales", g)


@register("box_outliers", with_sales(f"""
SELECT s.category, {', '.join('s.' + k.strip() for k in KEY.split(','))}, CAST(s.sales AS DOUBLE) AS sales
FROM sales s JOIN f ON s.category = f.g
WHERE {_FINITE.replace('sales', 's.sales')} AND (CAST(s.sales AS DOUBLE) < f.lower_fence OR CAST(s.sales AS DOUBLE) > f.upper_fence)""",
    _BOX_CTE))
def q_box_outliers(spark, d):
    """Rows drawn as box-plot outliers, per category."""
    return DI.box_outliers(sales_view(spark, d), "sales", "category", key=ROW_KEY)


_BOX_ALL_CTE = f"""v AS (SELECT 1 AS g, CAST(sales AS DOUBLE) AS x,
                     row_number() OVER (ORDER BY CAST(sales AS DOUBLE), {KEY}) - 1 AS pos,
                     count(*) OVER () AS n FROM sales WHERE {_FINITE}),
q AS (SELECT g, max(n) AS n, {_interp(_hazen(0.25))} AS q1, {_interp(_hazen(0.5))} AS median,
             {_interp(_hazen(0.75))} AS q3 FROM v GROUP BY g, n),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)"""


@register("box_stats_overall", with_sales("""
SELECT f.n, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence,
       min(CASE WHEN v.x >= f.lower_fence AND v.x <= f.upper_fence THEN v.x END) AS whisker_low,
       max(CASE WHEN v.x >= f.lower_fence AND v.x <= f.upper_fence THEN v.x END) AS whisker_high,
       count(CASE WHEN NOT (v.x >= f.lower_fence AND v.x <= f.upper_fence) THEN 1 END) AS outliers
FROM f JOIN v ON f.g = v.g
GROUP BY f.n, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence""", _BOX_ALL_CTE))
def q_box_stats_overall(spark, d):
    """One overall box of sales (the no-group fallback)."""
    return DI.box_stats(sales_view(spark, d), "sales", None)


_QQ_M = ("CASE WHEN n = 1 THEN 0.5 WHEN rk = 1 THEN 1.0 - pow(0.5, 1.0 / n) WHEN rk = n THEN pow(0.5, 1.0 / n) "
         "ELSE (rk - 0.3175) / (n + 0.365) END")
def _phi_sql(x: str, terms: int = 64) -> str:
    """The normal distribution function by its power series x + x^3/3 + x^5/15 + ..."""
    coefs, c = [], 1.0
    for k in range(terms):
        coefs.append(c)
        c /= 2 * k + 3
    acc = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = f"({acc} * {x} * {x} + {c!r})"
    return f"(0.5 + exp(-0.5 * {x} * {x}) / sqrt(2 * pi()) * {x} * {acc})"


# The inverse by Newton's method on the distribution function itself, from a
# rough start (Abramowitz and Stegun 26.2.23).
_QQ_CTE = f"""r AS (SELECT {KEY}, CAST(sales AS DOUBLE) AS osr,
                     row_number() OVER (ORDER BY CAST(sales AS DOUBLE), {KEY}) AS rk,
                     CAST(count(*) OVER () AS DOUBLE) AS n FROM sales WHERE {_FINITE}),
m AS (SELECT *, {_QQ_M} AS m FROM r),
s AS (SELECT *, sqrt(-2 * ln(least(m, 1 - m))) AS t FROM m),
x0 AS (SELECT *, sign(m - 0.5) * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t)
         / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)) AS x FROM s),
x1 AS (SELECT * REPLACE (x - ({_phi_sql('x')} - m) * sqrt(2 * pi()) * exp(0.5 * x * x) AS x) FROM x0),
x2 AS (SELECT * REPLACE (x - ({_phi_sql('x')} - m) * sqrt(2 * pi()) * exp(0.5 * x * x) AS x) FROM x1),
x3 AS (SELECT * REPLACE (x - ({_phi_sql('x')} - m) * sqrt(2 * pi()) * exp(0.5 * x * x) AS x) FROM x2),
qq AS (SELECT {KEY}, rk AS rank, x AS osm, osr FROM x3)"""


@register("qq_normal", with_sales("SELECT * REPLACE (round(osm, 6) AS osm) FROM qq", _QQ_CTE))
def q_qq_normal(spark, d):
    """Normal Q-Q points of sales (every row)."""
    return _rounded(DI.qq_normal(sales_view(spark, d), "sales", ROW_KEY), 6, "osm")


@register("qq_fit", with_sales(
    "SELECT round(regr_slope(osr, osm), 3) AS slope, round(regr_intercept(osr, osm), 3) AS intercept, "
    "round(corr(osr, osm), 8) AS r FROM qq", _QQ_CTE))
def q_qq_fit(spark, d):
    """Reference line (slope, intercept) and correlation of the Q-Q points."""
    f = DI.qq_fit(DI.qq_normal(sales_view(spark, d), "sales", ROW_KEY))
    return f.select(F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"),
                    F.round("r", 8).alias("r"))


@register("kde", with_sales("""
SELECT g.point, st.lo + g.point * st.step AS x,
       round(sum(exp(-0.5 * ((st.lo + g.point * st.step - v.x) / st.h) * ((st.lo + g.point * st.step - v.x) / st.h)))
             * (1.0 / (st.n * st.h * sqrt(2 * pi()))), 12) AS density
FROM st, (SELECT CAST(range AS INTEGER) AS point FROM range(500)) g, v
GROUP BY g.point, st.lo, st.step, st.n, st.h""", f"""v AS (SELECT CAST(sales AS DOUBLE) AS x FROM sales WHERE {_FINITE}),
st AS (SELECT count(*) AS n, min(x) AS lo, (max(x) - min(x)) / 500 AS step,
              stddev_samp(x) * pow(count(*), -0.2) AS h FROM v)"""))
def q_kde(spark, d):
    """Gaussian kernel density of sales on a 500-point grid."""
    return _rounded(DI.kde(sales_view(spark, d), "sales", 500), 12, "density")


# --- supervised models ------------------------------------------------------------------

from ordertide.operators import evalcurves as EC  # noqa: E402
from ordertide.operators import features as FE  # noqa: E402
from ordertide.operators import supervised as SU  # noqa: E402

_FITS: dict = {}


def _data_state(spark, d) -> tuple:
    """Paths, sizes and times of the files that the fact view reads."""
    out = []
    for t in ("region", "nation", "customer", "part", "orders", "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d.rstrip('/')}/{t}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(out))


def _once(spark, d, kind: str, make):
    """One result per (application, files, kind), shared by the queries that
    show its different outputs; rewritten files are fitted anew."""
    k = (spark.sparkContext.applicationId, _data_state(spark, d), kind)
    if k not in _FITS:
        _FITS[k] = make()
    return _FITS[k]


def clear_fits() -> None:
    """Forget the shared results; their checkpoint files go with them."""
    _FITS.clear()


def _fit(spark, d, kind: str):
    def make():
        s = sales_view(spark, d)
        if kind == "classifier":
            return SU.fit_classifier(s)
        model, _, only = kind.partition(":")
        model, _, solver = model.partition("-")
        return SU.fit_regression(s, model, features=only.split(",") if only else None, solver=solver or None)
    return _once(spark, d, kind, make)


def _reg_query(kind, part, doc):
    def q(spark, d):
        return _fit(spark, d, kind)[part]
    q.__doc__ = doc
    return q


for _kind, _label in (("linear", "OLS"), ("ridge", "ridge (alpha 1)"), ("forest", "random forest")):
    _name = {"linear": "linear_regression", "ridge": "ridge_regression", "forest": "random_forest"}[_kind]
    register(_name, None)(_reg_query(_kind, "metrics", f"Test-set R2/MAE/RMSE of the {_label} sales model."))
    register(f"{_name}_predictions", None)(
        _reg_query(_kind, "predictions", f"Actual, predicted and residual per test row ({_label})."))
register("feature_importance_forest", None)(
    _reg_query("forest", "importances", "Forest importances by column, adding to 1."))
register("feature_importance_linear", None)(
    _reg_query("linear", "importances", "Top-20 OLS coefficients by magnitude."))


for _kind in ("linear", "ridge"):
    register(f"{_kind}_regression_absorbed", None)(
        _reg_query(f"{_kind}-absorb", "metrics", f"Test-set R2/MAE/RMSE of the {_kind} sales model, product ids absorbed."))
register("feature_importance_absorbed", None)(
    _reg_query("ridge-absorb", "importances", "Top-20 ridge coefficients by magnitude, product ids among them."))


@register("residual_histogram", None)
def q_residual_histogram(spark, d):
    """40-bin histogram of the ridge model's test residuals."""
    return DI.histogram(_fit(spark, d, "ridge")["predictions"], "residual", bins=40)


def _u_sql(seed: int = 0) -> str:
    parts = ", ".join(["CAST(order_id AS VARCHAR)", "CAST(line_number AS VARCHAR)", "CAST(product_id AS VARCHAR)",
                       "CAST(supplier_id AS VARCHAR)", "CAST(CAST(extended_price AS DECIMAL(38,10)) AS VARCHAR)"])
    return (f"CAST(CAST(('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 15)) AS BIGINT) AS DOUBLE)"
            f" / {float(16 ** 15)!r}")


@register("split_random", with_sales(f"SELECT {KEY}, {_u_sql()} < 0.2 AS is_test FROM sales WHERE {_FINITE}"))
def q_split_random(spark, d):
    """Deterministic 20 % test split by key hash (seed 0)."""
    s = FL.finite_rows(sales_view(spark, d)).select(*ROW_KEY)
    return SU.split_random(s, 0.2, ROW_KEY, 0)


@register("ideal_line", with_sales(
    f"SELECT min(CAST(sales AS DOUBLE)) AS lo, max(CAST(sales AS DOUBLE)) AS hi FROM sales WHERE {_FINITE} AND {_u_sql()} < 0.2"))
def q_ideal_line(spark, d):
    """Min and max actual sales of the test rows (the y = x segment)."""
    return SU.ideal_line(_fit(spark, d, "ridge")["predictions"])


# The regressions on the one numeric column: closed forms on the training split.
# Scaling by the population deviation s turns the ridge penalty 1 into s^2.
def _line_cte(penalty: str) -> str:
    return f"""r AS (SELECT {KEY}, CAST(sales AS DOUBLE) AS y, postal_code AS x, {_u_sql()} < 0.2 AS is_test FROM sales WHERE {_FINITE}),
m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + {penalty}) AS slope
      FROM r WHERE NOT is_test),
p AS (SELECT {KEY}, y AS actual, my + slope * (x - mx) AS predicted FROM r, m WHERE is_test)"""


# Ridge on postal code and product id, the product ids eliminated level by level:
# with intercept a and slope b, each product's effect is (t - n a - s b) / (n + 1).
_ABSORBED_CTE = f"""r AS (SELECT {KEY}, CAST(sales AS DOUBLE) AS y, postal_code AS x0, {_u_sql()} < 0.2 AS is_test FROM sales WHERE {_FINITE}),
sd AS (SELECT stddev_pop(x0) AS d FROM r WHERE NOT is_test),
z AS (SELECT r.*, x0 / d AS x FROM r, sd),
g AS (SELECT product_id, count(*)::DOUBLE AS n, sum(x) AS s, sum(y) AS t FROM z WHERE NOT is_test GROUP BY product_id),
a AS (SELECT count(*)::DOUBLE AS n, sum(x) AS x, sum(x * x) AS xx, sum(y) AS y, sum(x * y) AS xy FROM z WHERE NOT is_test),
e AS (SELECT sum(n * n / (n + 1)) AS nn, sum(n * s / (n + 1)) AS ns, sum(s * s / (n + 1)) AS ss, sum(n * t / (n + 1)) AS nt,
        sum(s * t / (n + 1)) AS st FROM g),
q AS (SELECT a.n - nn AS p, x - ns AS q, xx + 1 - ss AS r, y - nt AS u, xy - st AS v FROM a, e),
c AS (SELECT (u * r - v * q) / (p * r - q * q) AS a, (v * p - u * q) / (p * r - q * q) AS b FROM q),
p AS (SELECT {", ".join("z." + k.strip() for k in KEY.split(","))}, y AS actual, c.a + c.b * x + coalesce((t - n * c.a - s * c.b) / (n + 1), 0) AS predicted
      FROM z CROSS JOIN c LEFT JOIN g ON z.product_id = g.product_id WHERE is_test)"""


@register("ridge_absorbed_predictions", with_sales(
    f"SELECT {KEY}, actual, round(predicted, 3) AS predicted, round(actual - predicted, 3) AS residual FROM p", _ABSORBED_CTE))
def q_ridge_absorbed_predictions(spark, d):
    """Test rows of the ridge model of sales on postal code and product id, the product ids absorbed."""
    return _rounded(_fit(spark, d, "ridge-absorb:postal_code,product_id")["predictions"], 3, "predicted", "residual")


for _kind, _penalty in (("linear", "0"), ("ridge", "var_pop(x)")):
    def _numeric(spark, d, kind=_kind):
        return _rounded(_fit(spark, d, f"{kind}:postal_code")["predictions"], 3, "predicted", "residual")

    def _numeric_metrics(spark, d, kind=_kind):
        m = _fit(spark, d, f"{kind}:postal_code")["metrics"].select("test_rows", "r2", "mae", "rmse")
        return _rounded(_rounded(m, 8, "r2"), 4, "mae", "rmse")

    _numeric.__doc__ = f"Test rows of the {_kind} model of sales on postal_code alone."
    _numeric_metrics.__doc__ = f"R2, MAE and RMSE of the {_kind} model of sales on postal_code alone."
    register(f"{_kind}_numeric_predictions", with_sales(
        f"SELECT {KEY}, actual, round(predicted, 3) AS predicted, round(actual - predicted, 3) AS residual FROM p",
        _line_cte(_penalty)))(_numeric)
    register(f"{_kind}_numeric_metrics", with_sales(
        "SELECT count(*) AS test_rows, round(1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)), 8) AS r2, "
        "round(avg(abs(actual - predicted)), 4) AS mae, round(sqrt(avg(pow(actual - predicted, 2))), 4) AS rmse FROM p",
        _line_cte(_penalty)))(_numeric_metrics)


@register("residual_histogram_numeric", with_sales("""
SELECT b.bin, round(lo + b.bin * w, 4) AS bin_lo, round(lo + (b.bin + 1) * w, 4) AS bin_hi, coalesce(c.n, 0) AS count
FROM st, (SELECT CAST(range AS INTEGER) AS bin FROM range(40)) b
LEFT JOIN (SELECT CAST(least(floor((e - lo) / w), 39) AS INTEGER) AS bin, count(*) AS n FROM e, st GROUP BY 1) c ON b.bin = c.bin""",
    _line_cte("var_pop(x)") + """,
e AS (SELECT actual - predicted AS e FROM p), st AS (SELECT min(e) AS lo, (max(e) - min(e)) / 40 AS w FROM e)"""))
def q_residual_histogram_numeric(spark, d):
    """40-bin histogram of that ridge model's test residuals."""
    h = DI.histogram(_fit(spark, d, "ridge:postal_code")["predictions"], "residual", bins=40)
    return _rounded(h, 4, "bin_lo", "bin_hi")


_LABEL_CTE = f"""v AS (SELECT {KEY}, CAST(sales AS DOUBLE) AS s FROM sales WHERE {_FINITE}),
cut AS (SELECT quantile_cont(s, 0.75) AS c FROM v),
l AS (SELECT v.*, CAST(s >= c AS INTEGER) AS label FROM v, cut)"""


def _priced(spark, d) -> DataFrame:
    """Keys, sales, quantity and discount of the fact, written once: cut-off, labels and splits read them, not the star join again."""
    return _once(spark, d, "priced", lambda: computed_once(sales_view(spark, d).select(*ROW_KEY, "sales", "quantity", "discount")))


@register("label_high_value", with_sales(f"SELECT {KEY}, label FROM l", _LABEL_CTE))
def q_label_high_value(spark, d):
    """1 when a line's sales reach the 0.75 quantile, else 0."""
    lab, _ = SU.high_value_labels(_priced(spark, d), ROW_KEY)
    return lab.select(*ROW_KEY, "label")


@register("class_counts", with_sales("SELECT label, count(*) AS count FROM l GROUP BY label", _LABEL_CTE))
def q_class_counts(spark, d):
    """Rows per high-value class."""
    lab, _ = SU.high_value_labels(_priced(spark, d), ROW_KEY)
    return lab.groupBy("label").count()


@register("positive_rate", with_sales("SELECT avg(label) AS positive_rate FROM l", _LABEL_CTE))
def q_positive_rate(spark, d):
    """Share of high-value lines."""
    lab, _ = SU.high_value_labels(_priced(spark, d), ROW_KEY)
    return lab.agg(F.avg("label").alias("positive_rate"))


_STRAT_CTE = _LABEL_CTE + f""",
u AS (SELECT *, {_u_sql()} AS u FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, {KEY}) AS rk,
             count(*) OVER (PARTITION BY label) AS nc FROM u)"""


@register("split_stratified", with_sales(
    f"SELECT {KEY}, label, rk <= ceil(0.25 * nc) AS is_test FROM r", _STRAT_CTE))
def q_split_stratified(spark, d):
    """Stratified 25 % test split: per class, the rows with the smallest key hash."""
    lab, _ = SU.high_value_labels(_priced(spark, d), ROW_KEY)
    return SU.split_stratified(lab.select(*ROW_KEY, "label"), "label", 0.25, ROW_KEY, 0)


@register("classification_summary", with_sales(
    "SELECT (SELECT c FROM cut) AS threshold, (SELECT avg(label) FROM l) AS positive_rate, "
    "(SELECT count(*) FROM l) AS rows, "
    "(SELECT sum(nc - ceil(0.25 * nc)) FROM (SELECT count(*) AS nc FROM l GROUP BY label))::BIGINT AS train_rows",
    _LABEL_CTE))
def q_classification_summary(spark, d):
    """High-value cutoff, positive rate, rows and training rows of the classifier."""
    return _fit(spark, d, "classifier")["summary"]


def _cls_query(fn, doc):
    def q(spark, d):
        return fn(_fit(spark, d, "classifier")["predictions"])
    q.__doc__ = doc
    return q


register("predict_class", None)(_cls_query(lambda p: p, "Label, score and predicted class per test row."))
register("confusion_matrix", None)(_cls_query(EC.confusion_matrix, "2x2 confusion matrix as 4 rows."))
register("accuracy", None)(_cls_query(lambda p: EC.accuracy(EC.confusion_matrix(p)), "Classifier accuracy."))
register("class_flow", None)(_cls_query(lambda p: EC.class_flow(EC.confusion_matrix(p)),
                                        "Actual -> predicted flow edges."))
register("roc_curve", None)(_cls_query(EC.roc_curve, "ROC points (collinear interior points dropped)."))
register("roc_auc", None)(_cls_query(EC.roc_auc, "Area under the ROC curve."))
register("pr_curve", None)(_cls_query(EC.pr_curve, "Precision-recall points."))
register("average_precision", None)(_cls_query(EC.average_precision, "Average precision."))


# The evaluation operators on a score that SQL can state.
_SCORE_CTE = _LABEL_CTE.replace(f"SELECT {KEY}, CAST(sales AS DOUBLE) AS s", f"SELECT {KEY}, quantity, discount, CAST(sales AS DOUBLE) AS s") + """,
q AS (SELECT label, quantity / 50.0 + discount AS score, CAST(quantity / 50.0 + discount >= 0.5 AS INTEGER) AS pred FROM l),
d AS (SELECT score, sum(label) AS tp, sum(1 - label) AS fp FROM q GROUP BY score),
t AS (SELECT score, tp, fp, row_number() OVER (ORDER BY score DESC) AS rank, sum(tp) OVER (ORDER BY score DESC) AS tps,
  sum(fp) OVER (ORDER BY score DESC) AS fps, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM d)"""
_MATRIX_SQL = ("(SELECT a.v AS actual, b.v AS predicted, (SELECT count(*) FROM q WHERE label = a.v AND pred = b.v) AS count "
               "FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v))")


def _formula_scores(spark, d):
    def make():
        lab, _ = SU.high_value_labels(_priced(spark, d), ROW_KEY)
        score = F.col("quantity") / F.lit(50.0) + F.col("discount")
        return computed_once(lab.select("label", score.alias("score"), (score >= 0.5).cast("int").alias("pred")))
    return _once(spark, d, "formula", make)


def _formula_query(name, sql, fn, doc):
    def q(spark, d):
        return fn(_formula_scores(spark, d))
    q.__doc__ = doc + " (score: a formula of quantity and discount)."
    register(name, with_sales(sql, _SCORE_CTE))(q)


_formula_query("confusion_matrix_formula", f"SELECT * FROM {_MATRIX_SQL}", EC.confusion_matrix, "2x2 confusion matrix")
_formula_query("accuracy_formula", "SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM q",
               lambda p: EC.accuracy(EC.confusion_matrix(p)), "Accuracy")
_formula_query("class_flow_formula", "SELECT 'Actual: ' || CASE actual WHEN 1 THEN 'High' ELSE 'Low' END AS source, "
               f"'Pred: ' || CASE predicted WHEN 1 THEN 'High' ELSE 'Low' END AS target, count AS value FROM {_MATRIX_SQL}",
               lambda p: EC.class_flow(EC.confusion_matrix(p)), "Actual -> predicted flow edges")
_formula_query("roc_curve_formula", "SELECT 0 AS rank, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'infinity'::DOUBLE AS threshold UNION ALL "
               "SELECT rank, fps::DOUBLE / n::DOUBLE, tps::DOUBLE / p::DOUBLE, score FROM (SELECT *, lag(tps) OVER w AS t0, lead(tps) OVER w AS t2, "
               "lag(fps) OVER w AS f0, lead(fps) OVER w AS f2 FROM t WINDOW w AS (ORDER BY rank)) "
               "WHERE t0 IS NULL OR t2 IS NULL OR t2 - tps <> tps - t0 OR f2 - fps <> fps - f0", EC.roc_curve,
               "ROC points (collinear interior points dropped)")
_formula_query("roc_auc_formula", "SELECT round(sum(fp * (2 * tps - tp) / 2.0)::DOUBLE / (max(p) * max(n))::DOUBLE, 12) AS roc_auc FROM t",
               lambda p: _rounded(EC.roc_auc(p), 12, "roc_auc"), "Area under the ROC curve")
_formula_query("pr_curve_formula", "SELECT rank, tps::DOUBLE / p::DOUBLE AS recall, tps::DOUBLE / (tps + fps)::DOUBLE AS precision, score AS threshold FROM t "
               "UNION ALL SELECT 0, 0.0, 1.0, NULL", EC.pr_curve, "Precision-recall points")
_formula_query("average_precision_formula", "SELECT round(sum(tp::DOUBLE / p::DOUBLE * tps::DOUBLE / (tps + fps)::DOUBLE), 12) AS average_precision FROM t",
               lambda p: _rounded(EC.average_precision(p), 12, "average_precision"), "Average precision")


_CAT_SQL_COLS = ["ship_mode", "segment", "region", "state", "category", "sub_category", "product_id"]


@register("impute_mode", with_sales(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM sales "
    f"WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 1)" for c in _CAT_SQL_COLS)))
def q_impute_mode(spark, d):
    """Most frequent value of each categorical feature (imputation fill)."""
    return FE.mode_table(sales_view(spark, d), FE.CAT_COLS)


@register("impute_median", with_sales(" UNION ALL ".join(
    f"SELECT '{c}' AS col, count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM sales"
    for c in FE.CLS_NUM_COLS)))
def q_impute_median(spark, d):
    """Median of each numeric feature (imputation fill)."""
    return FE.median_table(sales_view(spark, d), FE.CLS_NUM_COLS)


@register("feature_scales", with_sales(" UNION ALL ".join(
    f"SELECT '{c}' AS col, round(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 0 THEN stddev_pop(CAST({c} AS DOUBLE)) "
    f"ELSE 1.0 END, 9) AS scale FROM sales" for c in FE.CLS_NUM_COLS)))
def q_feature_scales(spark, d):
    """Population std divisor of each numeric feature (no centring), shown
    to 9 decimals."""
    t = FE.scale_table(sales_view(spark, d), FE.CLS_NUM_COLS)
    return t.select("col", F.round("scale", 9).alias("scale"))


@register("feature_names", with_sales(
    "SELECT row_number() OVER (ORDER BY ord, lvl) - 1 AS idx, name FROM (" + " UNION ALL ".join(
        [f"SELECT {i} AS ord, lvl, '{c}_' || lvl AS name FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS lvl "
         f"FROM sales WHERE {c} IS NOT NULL)" for i, c in enumerate(_CAT_SQL_COLS)]
        + [f"SELECT {len(_CAT_SQL_COLS) + i} AS ord, '' AS lvl, '{c}' AS name"
           for i, c in enumerate(FE.REG_NUM_COLS)]) + ")"))
def q_feature_names(spark, d):
    """Expanded one-hot + numeric feature names in vector order."""
    return FE.feature_name_table(sales_view(spark, d), FE.CAT_COLS, FE.REG_NUM_COLS)


# --- clustering ----------------------------------------------------------------------------

from ordertide.operators import cluster as CL  # noqa: E402

_GF_SQL = ("SELECT region, category, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales, "
           "CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS profit, "
           "CAST(SUM(CAST(discount AS DECIMAL(28,12))) AS DOUBLE) / COUNT(discount) AS discount, "
           "COALESCE(SUM(quantity), 0.0) AS quantity, COUNT(DISTINCT order_id) AS order_count, "
           "COUNT(DISTINCT customer_id) AS customer_count FROM sales "
           "WHERE region IS NOT NULL AND category IS NOT NULL GROUP BY region, category")


@register("standardize_groups", with_sales(
    "SELECT region || ' | ' || category AS \"group\", "
    + ", ".join(f"round(CASE WHEN stddev_pop({f}) OVER () > 0 THEN ({f} - avg({f}) OVER ()) / "
                f"stddev_pop({f}) OVER () ELSE 0.0 END, 9) AS z_{f}" for f in CL.FEATURES)
    + " FROM g", f"g AS ({_GF_SQL})"))
def q_standardize_groups(spark, d):
    """Region x category groups with every feature z-scored (population std)."""
    g = CL.standardize_groups(computed_once(G.group_features(sales_by_order(spark, d), CL.KEYS)))
    return g.select(CL.group_label(*CL.KEYS).alias("group"),
                    *[F.round(f"z_{f}", 9).alias(f"z_{f}") for f in CL.FEATURES])


@register("choose_k", with_sales(
    "SELECT n AS groups, CASE WHEN least(greatest(n // 3, 3), 5, n - 1) >= 2 "
    "THEN least(greatest(n // 3, 3), 5, n - 1) END AS k FROM (SELECT count(*) AS n FROM g)", f"g AS ({_GF_SQL})"))
def q_choose_k(spark, d):
    """Number of groups and the cluster count chosen for them."""
    n = G.group_features(sales_by_order(spark, d), CL.KEYS).count()
    return spark.createDataFrame([(n, CL.choose_k(n))], "groups long, k int")


def _group_table(spark, d):
    return _once(spark, d, "groups", lambda: CL.cluster_groups_table(sales_by_order(spark, d))[0])


def _clusters(spark, d):
    return _once(spark, d, "kmeans", lambda: CL.kmeans_clusters(_group_table(spark, d)))


def _curves(spark, d):
    return _once(spark, d, "curves", lambda: CL.elbow_and_silhouette(_group_table(spark, d)))


@register("kmeans", None)
def q_kmeans(spark, d):
    """Cluster of each region x category group (best of 10 restarts)."""
    return _clusters(spark, d).select("group", *CL.KEYS, "cluster")


@register("cluster_scatter", None)
def q_cluster_scatter(spark, d):
    """Sales against profit per group, coloured by cluster."""
    return CL.cluster_scatter(_clusters(spark, d))


@register("centroids", None)
def q_centroids(spark, d):
    """Mean raw features per k-means cluster."""
    return CL.centroids(_clusters(spark, d))


@register("cluster_heatmap", None)
def q_cluster_heatmap(spark, d):
    """Centroid z-scores across the k-means clusters."""
    return CL.cluster_heatmap(_clusters(spark, d))


@register("elbow_curve", None)
def q_elbow_curve(spark, d):
    """Inertia for k = 2..min(10, groups - 1)."""
    return _curves(spark, d)[0]


@register("silhouette_curve", None)
def q_silhouette_curve(spark, d):
    """Silhouette (plain Euclidean distances) for the same k's."""
    return _curves(spark, d)[1]


@register("cluster_hierarchy", None)
def q_cluster_hierarchy(spark, d):
    """Divisive hierarchy: cluster of each group at k = 2..10."""
    return CL.cluster_hierarchy(_group_table(spark, d))


# The operators behind the fits, on an assignment that SQL can state: groups by
# the length of their category's name, modulo 3.
_GIVEN_CTE = f"""g AS ({_GF_SQL}),
z AS (SELECT region, category, length(category) % 3 AS cluster, """ + ", ".join(
    f"{f}, CASE WHEN stddev_pop({f}) OVER () > 0 THEN ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () ELSE 0.0 END AS z_{f}"
    for f in CL.FEATURES) + " FROM g)"
_MEANS = ", ".join(f"avg({f}) AS {f}" for f in CL.FEATURES)
_APART = " + ".join(f"pow(a.z_{f} - b.z_{f}, 2)" for f in CL.FEATURES)


def _given(spark, d):
    g = _group_table(spark, d).drop("features")
    return g.withColumn("cluster", (F.length("category") % 3).cast("long"))


@register("cluster_scatter_given", with_sales(
    "SELECT region, category, sales, profit AS y, 'profit' AS y_name, cluster FROM z", _GIVEN_CTE))
def q_cluster_scatter_given(spark, d):
    """Scatter of a given assignment."""
    return CL.cluster_scatter(_given(spark, d))


@register("centroids_given", with_sales(
    "SELECT cluster, " + ", ".join(f"round(avg({f}), 6) AS {f}" for f in CL.FEATURES) + " FROM z GROUP BY cluster",
    _GIVEN_CTE))
def q_centroids_given(spark, d):
    """Mean raw features per cluster of a given assignment."""
    return _rounded(CL.centroids(_given(spark, d)), 6, *CL.FEATURES)


@register("cluster_heatmap_given", with_sales(
    "SELECT cluster, " + ", ".join(f"round(coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0), 8) AS {f}"
                                   for f in CL.FEATURES)
    + f" FROM (SELECT cluster, {_MEANS} FROM z GROUP BY cluster)", _GIVEN_CTE))
def q_cluster_heatmap_given(spark, d):
    """Centroid z-scores of a given assignment."""
    return _rounded(CL.cluster_heatmap(_given(spark, d)), 8, *CL.FEATURES)


@register("inertia_given", with_sales(
    "SELECT round(sum(" + " + ".join(f"pow(z_{f} - m_{f}, 2)" for f in CL.FEATURES) + "), 8) AS inertia FROM z JOIN (SELECT cluster, "
    + ", ".join(f"avg(z_{f}) AS m_{f}" for f in CL.FEATURES) + " FROM z GROUP BY cluster) USING (cluster)", _GIVEN_CTE))
def q_inertia_given(spark, d):
    """Within-cluster sum of squares of a given assignment."""
    return _rounded(CL.inertia(_given(spark, d), [f"z_{f}" for f in CL.FEATURES]), 8, "inertia")


@register("silhouette_given", with_sales(
    "SELECT round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 8) AS silhouette_sq_euclidean "
    "FROM (SELECT region, category, max(CASE WHEN same THEN d END) AS own, min(CASE WHEN NOT same THEN d END) AS other FROM ("
    "SELECT a.region, a.category, a.cluster = b.cluster AS same, avg(" + _APART + ") AS d FROM z a JOIN z b "
    "ON a.region <> b.region OR a.category <> b.category GROUP BY a.region, a.category, a.cluster, b.cluster) "
    "GROUP BY region, category)", _GIVEN_CTE))
def q_silhouette_given(spark, d):
    """Squared-Euclidean silhouette of a given assignment (twin: all pairs)."""
    return _rounded(CL.silhouette(_given(spark, d), [f"z_{f}" for f in CL.FEATURES]), 8, "silhouette_sq_euclidean")


@register("silhouette_euclidean_given", with_sales(
    "SELECT round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 8) AS silhouette "
    "FROM (SELECT region, category, max(CASE WHEN same THEN d END) AS own, min(CASE WHEN NOT same THEN d END) AS other FROM ("
    "SELECT a.region, a.category, a.cluster = b.cluster AS same, avg(sqrt(" + _APART + ")) AS d FROM z a JOIN z b "
    "ON a.region <> b.region OR a.category <> b.category GROUP BY a.region, a.category, a.cluster, b.cluster) "
    "GROUP BY region, category)", _GIVEN_CTE))
def q_silhouette_euclidean_given(spark, d):
    """Plain Euclidean silhouette of a given assignment (twin: all pairs)."""
    return _rounded(CL.silhouette_euclidean(_given(spark, d), [f"z_{f}" for f in CL.FEATURES]), 8, "silhouette")


# --- formatted tables and cards ---------------------------------------------------------------

@register("kpi_cards_anchored_text", _ytd_anchored_sql("TRUE", "TRUE").replace(
    "SELECT total_sales, customer_count, order_count, ytd_sales, lytd_sales, "
    "CASE WHEN lytd_sales <> 0 THEN (ytd_sales - lytd_sales) / lytd_sales END AS yoy_pct, anchor_date ",
    "SELECT '$' || format('{:,.2f}', total_sales) AS sales_text, format('{:,}', customer_count) AS customers_text, "
    "format('{:,}', order_count) AS orders_text, '$' || format('{:,.2f}', ytd_sales) AS ytd_text, "
    "'$' || format('{:,.2f}', lytd_sales) AS lytd_text, "
    "format('{:,.2f}', COALESCE(CASE WHEN lytd_sales <> 0 THEN (ytd_sales - lytd_sales) / lytd_sales END, 0) * 100)"
    " || '%' AS yoy_text ", 1))
def q_kpi_cards_anchored_text(spark, d):
    """Six-tab KPI card texts ($1,234.00 / 1,234 / 12.34%) in the default state."""
    k = K.ytd_metrics_anchored(sales_view(spark, d), None)
    return k.select(fmt.currency2(F.col("total_sales")).alias("sales_text"),
                    fmt.safe_int(F.col("customer_count")).alias("customers_text"),
                    fmt.safe_int(F.col("order_count")).alias("orders_text"),
                    fmt.currency2(F.col("ytd_sales")).alias("ytd_text"),
                    fmt.currency2(F.col("lytd_sales")).alias("lytd_text"),
                    fmt.safe_pct(F.col("yoy_pct")).alias("yoy_text"))


@register("ytd_cards_text", _ytd_clamped_sql("2001-08-01 00:00:00", "TRUE").replace(
    "SELECT ytd_sales, lytd_sales, CASE WHEN lytd_sales <> 0 THEN (ytd_sales - lytd_sales) / lytd_sales END AS yoy_pct,"
    "\n       e AS through_date",
    "SELECT '$' || format('{:,.0f}', ytd_sales) AS ytd_text, '$' || format('{:,.0f}', lytd_sales) AS lytd_text, "
    "COALESCE(format('{:,.1f}', (ytd_sales - lytd_sales) / NULLIF(lytd_sales, 0) * 100) || '%', '—') AS yoy_text", 1))
def q_ytd_cards_text(spark, d):
    """One-page YTD / LYTD / YoY card texts through 2001-08-01 ('—' when LYTD is 0)."""
    s = sales_view(spark, d)
    y = K.ytd_metrics_clamped(s, "2001-08-01", FL.bounds(s))
    return y.select(fmt.currency0(F.col("ytd_sales")).alias("ytd_text"),
                    fmt.currency0(F.col("lytd_sales")).alias("lytd_text"),
                    fmt.pct1_or_dash(F.col("yoy_pct")).alias("yoy_text"))


@register("top_customers_table", with_sales(
    "SELECT customer_name, '$' || format('{:,.0f}', sales) AS sales, '$' || format('{:,.0f}', profit) AS profit, "
    "CAST(orders AS BIGINT) AS orders FROM (SELECT customer_name, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales, "
    "CAST(COALESCE(SUM(profit), 0) AS DOUBLE) AS profit, COUNT(DISTINCT order_id) AS orders "
    "FROM sales WHERE customer_name IS NOT NULL GROUP BY customer_name ORDER BY sales DESC, customer_name LIMIT 10)"))
def q_top_customers_table(spark, d):
    """Top-10 customers table as displayed ($ texts, integer orders)."""
    t = G.top_customers(sales_by_order(spark, d))
    return t.select("customer_name", fmt.currency0(F.col("sales")).alias("sales"),
                    fmt.currency0(F.col("profit")).alias("profit"), fmt.int_cast(F.col("orders")).alias("orders"))


@register("top_products_table", with_sales(
    "SELECT product_name, '$' || format('{:,.0f}', sales) AS sales, '$' || format('{:,.0f}', profit) AS profit, "
    "CAST(quantity AS BIGINT) AS quantity, CAST(COALESCE(orders, 0) AS BIGINT) AS orders FROM ("
    "SELECT m.product_name, m.sales, m.profit, m.quantity, o.orders FROM m LEFT JOIN o "
    "ON m.product_name = o.product_name ORDER BY m.sales DESC, m.product_name LIMIT 10)",
    f"m AS ({_PRODUCT_MEASURES_SQL}), o AS ({_ORDERS_PER_PRODUCT_SQL})"))
def q_top_products_table(spark, d):
    """Top-10 products pivot as displayed ($ texts, integer quantity and orders)."""
    t = G.top_products_pivot(sales_by_order(spark, d))
    return t.select("product_name", fmt.currency0(F.col("sales")).alias("sales"),
                    fmt.currency0(F.col("profit")).alias("profit"), fmt.int_cast(F.col("quantity")).alias("quantity"),
                    fmt.int_cast(F.col("orders")).alias("orders"))


# --- scale options: one scan, sketches, bins ----------------------------------------------

from ordertide.operators import cube as CU  # noqa: E402
from ordertide.operators.panels import Panels  # noqa: E402


def _panels(spark, d) -> Panels:
    return _once(spark, d, "panels", lambda: Panels(sales_view(spark, d)))


def _cube(spark, d) -> DataFrame:
    return _once(spark, d, "cube", lambda: computed_once(CU.build_cube(sales_view(spark, d))))


for _key in ("order_month", "region", "category"):
    _twin = REGISTRY["sales_by_month" if _key == "order_month" else f"sales_by_{_key}"].sql
    register(f"one_scan_sales_by_{_key}", _twin)(lambda spark, d, key=_key: _panels(spark, d).by(key))
for _name in G.HIERARCHIES:
    register(f"one_scan_hierarchy_{_name}", REGISTRY[f"sales_hierarchy_{_name}"].sql)(
        lambda spark, d, name=_name: _panels(spark, d).hierarchy(name))


@register("one_scan_totals", with_sales(
    "SELECT CAST(sum(sales) AS DOUBLE) AS total_sales, CAST(sum(profit) AS DOUBLE) AS total_profit, count(*) AS row_count FROM sales"))
def q_one_scan_totals(spark, d):
    """Totals from the same scan as all other one_scan panels."""
    return _panels(spark, d).totals()


def _cube_view(spark, d) -> DataFrame:
    cells = FL.filter_date_range(_cube(spark, d), *RANGE)
    return FL.filter_in_dims(cells, regions=REGIONS, categories=CATEGORIES)


@register("cube_money", with_sales(
    "SELECT CAST(coalesce(sum(sales), 0) AS DOUBLE) AS total_sales, CAST(coalesce(sum(profit), 0) AS DOUBLE) AS total_profit, "
    f"count(*) AS row_count FROM sales WHERE order_date >= TIMESTAMP '{RANGE[0]}' AND order_date < TIMESTAMP '{RANGE[1]}' + INTERVAL 1 DAY "
    f"AND {_in('region', REGIONS)} AND {_in('category', CATEGORIES)}"))
def q_cube_money(spark, d):
    """Sums and rows of a filtered view, from the sketch cube."""
    return CU.cube_kpis(_cube_view(spark, d)).select("total_sales", "total_profit", "row_count")


@register("cube_kpis", None)
def q_cube_kpis(spark, d):
    """The KPI row of a filtered view, distinct counts estimated from the cube's sketches."""
    return CU.cube_kpis(_cube_view(spark, d))


@register("cube_boxes", None)
def q_cube_boxes(spark, d):
    """Box per category from the cube's quantile sketches."""
    return CU.cube_boxes(_cube(spark, d), "category")


@register("kde_binned", with_sales("""
SELECT g.point, st.lo + g.point * st.step AS x,
       round(sum(w.w * exp(-0.5 * pow((st.lo + g.point * st.step - (st.lo + w.bin * st.width)) / st.h, 2)))
             / (st.n * st.h * sqrt(2 * pi())), 12) AS density
FROM st, (SELECT CAST(range AS INTEGER) AS point FROM range(500)) g, w
GROUP BY g.point, st.lo, st.step, st.n, st.h""", f"""v AS (SELECT CAST(sales AS DOUBLE) AS x FROM sales WHERE {_FINITE}),
s0 AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v),
st AS (SELECT n, lo, (hi - lo) / 500 AS step, h, ceil((hi - lo) / (0.02 * h)) AS bins, (hi - lo) / ceil((hi - lo) / (0.02 * h)) AS width FROM s0),
p AS (SELECT least(floor((x - lo) / width), bins - 1) AS bin, (x - lo) / width - least(floor((x - lo) / width), bins - 1) AS r FROM v, st),
w AS (SELECT bin, sum(w) AS w FROM (SELECT bin, 1 - r AS w FROM p UNION ALL SELECT bin + 1, r FROM p) GROUP BY bin)"""))
def q_kde_binned(spark, d):
    """Gaussian kernel density of sales over pre-binned values."""
    return _rounded(DI.kde_binned(sales_view(spark, d), "sales", 500), 12, "density")


@register("rug_sample", with_sales(f"""
SELECT CAST(bin AS INTEGER) AS bin, sales FROM (
  SELECT bin, x AS sales, row_number() OVER (PARTITION BY bin ORDER BY u, {KEY}) AS i FROM (
    SELECT {KEY}, CAST(sales AS DOUBLE) AS x, {_u_sql()} AS u,
      least(floor((CAST(sales AS DOUBLE) - st.lo) / ((st.hi - st.lo) / 60)), 59) AS bin
    FROM sales, (SELECT min(CAST(sales AS DOUBLE)) AS lo, max(CAST(sales AS DOUBLE)) AS hi FROM sales WHERE {_FINITE}) st WHERE {_FINITE}))
WHERE i <= 50"""))
def q_rug_sample(spark, d):
    """The rug at scale: 50 values of each of 60 histogram bins, drawn by hash."""
    return DI.rug_sample(sales_view(spark, d), ROW_KEY, "sales", bins=60)


from ordertide.operators.threshold import top_n_threshold  # noqa: E402


@register("top_n_products_threshold", REGISTRY["top_n_products"].sql)
def q_top_n_products_threshold(spark, d):
    """Top 10 product names by sales, by the threshold algorithm."""
    return top_n_threshold(sales_view(spark, d), "product_name", 10)
