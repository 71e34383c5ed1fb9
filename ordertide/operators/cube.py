"""Sketch cube: KPIs and quantiles of any filtered view without the fact.

One pass over the fact stores, for every (day, region, category, segment), exact
money sums and row counts, HyperLogLog sketches of orders and customers and a
KLL sketch of the sales values. Sketches merge, so a view's distinct counts and
quantiles are unions over its cells: filters and date ranges apply to the cube
as they do to the fact, since its columns have the same names. The cube's size
follows from the days and the dimensions, not from the rows.

Errors: a distinct count's relative error has deviation 1.04 / sqrt(2^lg_k) at
most (0.8 % at lg_k 14, exact for small sets); a quantile's rank is off by at
most ``kll_rank_error(k)`` with 99 % confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.functions.numeric import is_finite
from ordertide.operators.kpis import money_sum

DIMENSIONS = ("region", "category", "segment")
#: Log2 of the distinct sketch's registers, and the quantile sketch's size.
LG_K, KLL_K = 14, 400


def hll_relative_error(lg_k: int = LG_K) -> float:
    """Three deviations of a distinct count's relative error."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def kll_rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a quantile (99 % confidence), as published for
    this sketch: 2.296 / k^0.9723."""
    return 2.296 / k ** 0.9723


def build_cube(df: DataFrame, dims=DIMENSIONS, lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """One row per (day as ``order_date``, ``dims``), null values a group of
    their own: total_sales, total_profit, row_count, the sketches orders,
    customers and values (of finite sales, null if none), and the largest
    time of the day, which anchors relative presets."""
    value = F.col("sales").cast("double")
    return (df.withColumn("__day", F.date_trunc("day", F.col("order_date")).cast("timestamp_ntz"))
            .groupBy(F.col("__day").alias("order_date"), *dims)
            .agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("row_count"),
                 F.hll_sketch_agg(F.col("order_id"), lg_k).alias("orders"),
                 F.hll_sketch_agg(F.col("customer_id"), lg_k).alias("customers"),
                 F.kll_sketch_agg_double(F.when(is_finite(value), value), kll_k).alias("values"),
                 F.max("order_date").alias("last_time")))


def write_cube(cube: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a cube by year, so that date filters prune its folders."""
    (cube.withColumn("order_year", F.year("order_date")).sortWithinPartitions("order_year", "order_date")
     .write.mode(mode).partitionBy("order_year").parquet(path))


def cube_kpis(cells: DataFrame) -> DataFrame:
    """The KPI row of ``kpi_totals`` over a cube's (filtered) cells: sums and
    rows exact, orders and customers estimated (0 without cells)."""
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0).cast("long"))
    return cells.agg(money_sum("sales").alias("total_sales"), money_sum("profit").alias("total_profit"),
                     estimate("orders").alias("order_count"), estimate("customers").alias("customer_count"),
                     F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))


def cube_quantiles(cells: DataFrame, probs, group_cols=(), names=None) -> DataFrame:
    """Estimated quantiles of the finite sales per group of cells (NULL keys
    are a group), with n: values of the data at ranks within the sketch's error."""
    names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
    merged = (cells.where("kll_sketch_get_n_double(values) > 0").groupBy(*group_cols)
              .agg(F.kll_merge_agg_double("values").alias("__values"), F.count(F.lit(1)).alias("__cells")))
    merged = merged.where("__cells > 0").withColumn("n", F.kll_sketch_get_n_double("__values"))
    return merged.select(*group_cols, "n", *[F.kll_sketch_get_quantile_double("__values", F.lit(float(p))).alias(x)
                                             for p, x in zip(probs, names)])


def cube_boxes(cells: DataFrame, group_col: str, fence: float = 1.5) -> DataFrame:
    """Estimated box per group: n, q1, median, q3 and the fences."""
    q = cube_quantiles(cells.where(F.col(group_col).isNotNull()), [0.25, 0.5, 0.75], [group_col], ["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower_fence", F.col("q1") - fence * iqr).withColumn("upper_fence", F.col("q3") + fence * iqr)
