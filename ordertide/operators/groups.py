"""Grouped measures, top-k tables, shares and rollup hierarchies.

Every group-by drops NULL keys first (pandas ``groupby`` semantics). Hash
aggregation combines map-side before the shuffle, so a hot key costs one
partial row per input partition, not its row count. Top-k uses
``orderBy(...).limit(k)`` which plans as ``TakeOrderedAndProject``: each
partition keeps its k best, no global sort. Ties are broken by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordertide.operators.joins import computed_once
from ordertide.operators.kpis import distinct_count, money_sum


def _nonnull(df: DataFrame, keys) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def sales_by(df: DataFrame, key: str, value: str = "sales") -> DataFrame:
    """Sum of ``value`` per non-NULL ``key``."""
    return _nonnull(df, [key]).groupBy(key).agg(money_sum(value).alias(value))


def sales_by_month(df: DataFrame, month_col: str = "order_month") -> DataFrame:
    return sales_by(df, month_col).orderBy(month_col)


def sales_by_region(df: DataFrame) -> DataFrame:
    return sales_by(df, "region").orderBy(F.desc("sales"), "region")


def sales_by_category(df: DataFrame) -> DataFrame:
    return sales_by(df, "category").orderBy(F.desc("sales"), "category")


def _exact_sales_by(df: DataFrame, key: str, value: str = "sales") -> DataFrame:
    """Like ``sales_by`` but keeps the exact decimal sum."""
    return _nonnull(df, [key]).groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def share(result: DataFrame, value: str = "sales", name: str = "share") -> DataFrame:
    """value / total of ``value`` over the rows of ``result`` (an aggregated
    result with an exact decimal ``value``). The total is a scalar subquery,
    summed exactly before the division; no single-partition window."""
    # the aggregated result is read twice (rows and total)
    result = computed_once(result)
    total = result.agg(F.sum(value).cast("double")).scalar()
    return result.select(*[c for c in result.columns if c != value],
                         F.col(value).cast("double").alias(value),
                         F.try_divide(F.col(value).cast("double"), total).alias(name))


def top_n_share(top: DataFrame, value: str = "sales", name: str = "share") -> DataFrame:
    """Share inside a top-k result with an exact decimal ``value`` (at most k
    rows, so the unpartitioned window sees a bounded row count)."""
    total = F.sum(value).over(Window.partitionBy()).cast("double")
    return top.select(*[c for c in top.columns if c != value],
                      F.col(value).cast("double").alias(value),
                      F.try_divide(F.col(value).cast("double"), total).alias(name))


def top_n(df: DataFrame, key: str, n: int = 10, value: str = "sales") -> DataFrame:
    """k largest groups by summed ``value``."""
    return sales_by(df, key, value).orderBy(F.desc(value), F.asc(key)).limit(n)


def top_n_subcategories(df: DataFrame, n: int = 10) -> DataFrame:
    return top_n(df, "sub_category", n)


def top_n_states(df: DataFrame, n: int = 10) -> DataFrame:
    return top_n(df, "state", n)


def top_n_products(df: DataFrame, n: int = 10) -> DataFrame:
    return top_n(df, "product_name", n)


def region_share(df: DataFrame) -> DataFrame:
    return share(_exact_sales_by(df, "region"))


def product_share(df: DataFrame, n: int = 10) -> DataFrame:
    top = _exact_sales_by(df, "product_name").orderBy(F.desc("sales"), "product_name").limit(n)
    return top_n_share(top)


def top_customers(df: DataFrame, n: int = 10, distinct: str = "exact") -> DataFrame:
    """Sales, profit and distinct orders per customer *name*, top k by sales."""
    return (_nonnull(df, ["customer_name"]).groupBy("customer_name")
            .agg(money_sum("sales").alias("sales"), money_sum("profit").alias("profit"),
                 distinct_count("order_id", distinct).alias("orders"))
            .orderBy(F.desc("sales"), "customer_name").limit(n))


def product_measures(df: DataFrame) -> DataFrame:
    """The 'pivot table': sales, profit, quantity summed per product name."""
    return (_nonnull(df, ["product_name"]).groupBy("product_name")
            .agg(money_sum("sales").alias("sales"), money_sum("profit").alias("profit"),
                 F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity")))


def orders_per_product(df: DataFrame) -> DataFrame:
    return (_nonnull(df, ["product_name"]).groupBy("product_name")
            .agg(F.count_distinct("order_id").alias("orders")))


def left_join_orders_per_product(df: DataFrame) -> DataFrame:
    """Per-product measures LEFT JOIN per-product distinct orders (missing ->
    0). Both sides come out of a hash aggregate on ``product_name``, so the
    join reuses that partitioning instead of shuffling again."""
    return (product_measures(df).join(orders_per_product(df), "product_name", "left")
            .withColumn("orders", F.coalesce(F.col("orders"), F.lit(0))))


def top_products_pivot(df: DataFrame, n: int = 10, method: str = "fused") -> DataFrame:
    """Top k products with sales, profit, quantity and distinct orders.
    ``fused`` computes all four in one aggregate (one pass, one shuffle);
    ``join`` keeps the two-aggregate left join."""
    if method == "join":
        table = left_join_orders_per_product(df)
    else:
        table = (_nonnull(df, ["product_name"]).groupBy("product_name")
                 .agg(money_sum("sales").alias("sales"), money_sum("profit").alias("profit"),
                      F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"),
                      F.count_distinct("order_id").alias("orders")))
    return table.orderBy(F.desc("sales"), "product_name").limit(n)


HIERARCHIES = {
    "region_category": ("region", "category"),
    "category_subcategory": ("category", "sub_category"),
    "region_state": ("region", "state"),
    "region_segment": ("region", "segment"),
}


def sales_hierarchy(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Sunburst data in one pass: leaves (level 0), parents (level 1) and the
    root (level 3) via ROLLUP; parents are sums of their leaves."""
    return (_nonnull(df, [parent, child]).rollup(parent, child)
            .agg(money_sum("sales").alias("sales"), F.grouping_id().alias("level"))
            .select(F.col(parent).alias("parent"), F.col(child).alias("child"), "level", "sales"))


def group_features(df: DataFrame, keys=("region", "category"), distinct: str = "exact") -> DataFrame:
    """Per group: sales, profit, mean discount, quantity, distinct orders and
    customers -- each only when its source column exists."""
    cols = set(df.columns)
    aggs = [money_sum("sales").alias("sales")]
    if "profit" in cols:
        aggs.append(money_sum("profit").alias("profit"))
    if "discount" in cols:
        # exact decimal sum / count, so the mean is independent of partitioning
        aggs.append((F.sum(F.col("discount").cast("decimal(28,12)")).cast("double")
                     / F.count("discount")).alias("discount"))
    if "quantity" in cols:
        aggs.append(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"))
    if "order_id" in cols:
        aggs.append(distinct_count("order_id", distinct).alias("order_count"))
    if "customer_id" in cols:
        aggs.append(distinct_count("customer_id", distinct).alias("customer_count"))
    return _nonnull(df, list(keys)).groupBy(*keys).agg(*aggs)
