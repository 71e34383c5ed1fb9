"""Order-line files with text dates (the spreadsheet-export shape).

``strict`` parsing raises on a malformed date (ANSI ``to_timestamp``);
``lenient`` turns it into NULL (``try_to_timestamp``), matching the two
loading modes of the surveyed dashboards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.functions.dates import calendar_columns, order_month

DATE_FORMAT = "yyyy-MM-dd[ HH:mm:ss]"


def parse_date(c: Column, mode: str = "strict", fmt: str = DATE_FORMAT) -> Column:
    pattern = F.lit(fmt)
    if mode == "strict":
        return F.to_timestamp_ntz(c, pattern)
    if mode == "lenient":
        # validity from try_to_timestamp; the value itself parsed straight to
        # timestamp_ntz, so no session-time-zone round trip (CASE WHEN only
        # evaluates the strict parse on rows that are valid)
        return F.when(F.try_to_timestamp(c, pattern).isNotNull(), F.to_timestamp_ntz(c, pattern))
    raise ValueError(f"unknown date mode {mode!r}")


def with_parsed_dates(df: DataFrame, mode: str = "strict",
                      columns=("order_date", "ship_date")) -> DataFrame:
    """Parse text date columns in place and add ``order_month`` (plus the
    calendar columns in lenient mode, as the six-tab dashboard does)."""
    out = df.withColumns({c: parse_date(F.col(c), mode) for c in columns if c in df.columns})
    out = out.withColumn("order_month", order_month(F.col("order_date")))
    if mode == "lenient":
        out = out.withColumns(calendar_columns(F.col("order_date")))
    return out


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL, so sums, means and distinct
    counts skip it as pandas does (Spark would propagate NaN)."""
    fixes = {f.name: F.when(~F.isnan(F.col(f.name)), F.col(f.name))
             for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes) if fixes else df


def read_sales_file(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                    mode: str = "strict", **options) -> DataFrame:
    """Read order lines from CSV/JSON/parquet with a declared schema."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return with_parsed_dates(nan_to_null(reader.format(fmt).load(path)), mode)
