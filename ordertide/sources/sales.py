"""The order-line sales fact: built from the star schema or read from files.

Grain is one row per order line. Money columns are DECIMAL so sums are exact
and independent of partitioning (double sums change with summation order).

Join plan (all inner equi-joins, written smallest-first so each big join sees
an already-enriched dimension side):

* region -> nation -> customer: dimension chain; region and nation are tiny and
  Spark broadcasts them under ``autoBroadcastJoinThreshold`` (a size check made
  from file statistics, re-checked at runtime by AQE).
* orders JOIN customer on custkey, lineitem JOIN orders on orderkey, lineitem
  JOIN part on partkey: at scale these are sort-merge joins shuffled on the key;
  AQE turns any side that proves small at runtime into a broadcast and splits
  skewed key partitions. Well compressed files stay under Spark's threshold with
  rows that the driver can't hold, so hints go by the rows, counted
  (``join_sized``): the smaller side of a join is merged where it may take more
  than BROADCAST_MAX_BYTES, and broadcast where only the larger one may.

For repeated dashboard queries at scale, ``materialize_sales_view`` writes the
joined fact once (partitioned by order year) so later panels scan pruned
parquet columns instead of redoing the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.functions.dates import order_month
from ordertide.operators.joins import join_sized
from ordertide.sources.tables import read_star

MONEY = "decimal(18,4)"

# Unique row key of the fact (``l_orderkey, l_linenumber`` alone is not unique
# in the test data).
ROW_KEY = ["order_id", "line_number", "product_id", "supplier_id", "extended_price"]

SALES_COLUMNS = [
    "order_id", "order_date", "ship_date", "customer_id", "customer_name", "segment",
    "region", "state", "category", "sub_category", "product_name", "sales", "quantity",
    "discount", "profit", "product_id", "ship_mode", "postal_code",
    "line_number", "supplier_id", "extended_price", "order_month",
]


def sales_amount(price: Column, discount: Column) -> Column:
    """price * (1 - discount) in exact decimal arithmetic. Operand types are
    chosen so every intermediate fits 18 digits: Spark then computes on
    64-bit unscaled longs instead of BigDecimal."""
    one = F.lit(1).cast("decimal(1,0)")
    return price.cast("decimal(12,2)") * (one - discount.cast("decimal(4,2)"))  # decimal(18,4)


def line_profit(sales: Column, quantity: Column, unit_price: Column) -> Column:
    """sales - quantity * unit price (stand-in cost), exact, within 18 digits."""
    cost = quantity.cast("decimal(5,0)") * unit_price.cast("decimal(12,2)")  # decimal(18,2)
    return sales.cast("decimal(17,4)") - cost.cast("decimal(17,4)")  # decimal(18,4)


def sales_view_from_tables(t: dict[str, DataFrame]) -> DataFrame:
    geo = (t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    cust = (join_sized(t["customer"], t["customer"], geo, t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "n_name", "r_name"))
    orders = (join_sized(t["orders"], t["orders"], cust, t["customer"], F.col("o_custkey") == F.col("c_custkey"))
              .drop("o_custkey", "o_orderstatus", "o_totalprice"))
    part = t["part"].select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    fact = join_sized(t["lineitem"], t["lineitem"], orders, t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    fact = join_sized(fact, t["lineitem"], part, t["part"], F.col("l_partkey") == F.col("p_partkey"))
    sales = sales_amount(F.col("l_extendedprice"), F.col("l_discount"))
    return fact.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("state"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_name").alias("product_name"),
        sales.alias("sales"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        line_profit(sales, F.col("l_quantity"), F.col("p_retailprice")).alias("profit"),
        F.col("p_partkey").alias("product_id"),
        F.col("o_orderpriority").alias("ship_mode"),
        F.col("c_nationkey").cast("double").alias("postal_code"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_extendedprice").alias("extended_price"),
        order_month(F.col("o_orderdate")).alias("order_month"),
    )


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line sales fact over the test star schema (lazy).

    Joins are inner: order lines without their order, customer or part are not
    sales and are left out. Money is computed in cents: prices are read with 2
    decimals, discounts with 2 and quantities as whole numbers; data with more
    digits are rounded to these (``sales_amount``, ``line_profit``)."""
    return sales_view_from_tables(read_star(spark, sf_dir))


#: Lines in a task that counts distinct orders; fewer than MIN_TASKS such tasks are left to Spark's own partitions.
LINES_A_TASK, MIN_TASKS = 1 << 18, 16


def sales_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact for counts of distinct orders, which keep an entry per order
    and group in memory: large ones are dealt by order into tasks of about
    LINES_A_TASK lines. Behind the joins a task would read as many lines as
    the session's partition size holds (64 MB: 2.5 million), and its entries
    share the task's memory with the joins' sorts. The lines of an order stay
    together, so an order is one entry of a group; the count of the lines
    reads the files' footers."""
    tables = read_star(spark, sf_dir)
    tasks = tables["lineitem"].count() // LINES_A_TASK
    fact = sales_view_from_tables(tables)
    return fact.repartition(tasks, "order_id") if tasks >= MIN_TASKS else fact


def materialize_sales_view(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the joined fact once, partitioned by order year and sorted by
    order date inside each file, so date-range predicates prune both
    directories and parquet row groups. No repartition: each join task
    writes its own rows (at most one file per year it holds), which avoids
    a range-sampling pass that would recompute the joins."""
    (df.withColumn("order_year", F.year("order_date"))
       .sortWithinPartitions("order_year", "order_date")
       .write.mode(mode).partitionBy("order_year").parquet(path))


# --- increments ---------------------------------------------------------------------

MONTH, WATERMARK = "month_key", "watermark"


def _month_state(df: DataFrame) -> DataFrame:
    """(month_key, rows, state): what a month's rows add up to, in any order. Rows without a date are month 'none'."""
    row = F.xxhash64(*[F.col(c) for c in df.columns if c != MONTH]).cast("decimal(38,0)")
    return df.groupBy(MONTH).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("state"))


def load_increment(df: DataFrame, path: str) -> list[str]:
    """Bring the monthly store at ``path`` up to the fact ``df``: months that
    are new, late or corrected are rewritten, others are not touched. Returns
    the rewritten and dropped months, in order.

    A month counts as changed if its number of rows or the sum of its rows'
    hashes differs from the store's watermark table (a row a month). Only the
    partitions of changed months are replaced (dynamic overwrite). The
    watermark is written last, so a load that broke off is repeated, and a
    month that has no rows any more is out of the watermark: ``read_store``
    leaves it out."""
    spark = df.sparkSession
    keyed = df.withColumn(MONTH, F.coalesce(F.date_format("order_date", "yyyy-MM"), F.lit("none")))
    state = {r[MONTH]: (r["rows"], r["state"]) for r in _month_state(keyed).collect()}  # a row a month
    before = {r[MONTH]: (r["rows"], r["state"]) for r in _watermark(spark, path).collect()}
    changed = sorted(m for m in state.keys() | before.keys() if state.get(m) != before.get(m))
    if present := [m for m in changed if m in state]:
        (keyed.where(F.col(MONTH).isin(present)).repartition(MONTH, F.pmod(F.xxhash64("order_id"), F.lit(16)))
         .sortWithinPartitions(MONTH, "order_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(MONTH).parquet(f"{path}/data"))
    if changed:
        spark.createDataFrame([(m, *v) for m, v in sorted(state.items())], f"{MONTH} string, rows long, state string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/{WATERMARK}")
    return changed


def _watermark(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{WATERMARK}/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(f"{path}/{WATERMARK}")
    return spark.createDataFrame([], f"{MONTH} string, rows long, state string")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The fact in a monthly store, of the months in its watermark (a partition filter)."""
    months = [r[MONTH] for r in _watermark(spark, path).collect()]
    return spark.read.parquet(f"{path}/data").where(F.col(MONTH).isin(months)).drop(MONTH)


# --- buckets ------------------------------------------------------------------------

def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "product_name", sort: str = "order_id",
                   path: str | None = None) -> DataFrame:
    """Save the fact as a table bucketed by ``key`` and sorted by (key,
    ``sort``) within buckets, and give it back: distinct counts of ``sort`` by
    ``key``, and joins of tables bucketed alike, need no exchange. One bucket
    holds all rows of a key, so keys should be many and even; for a hot key
    the plain fact's partial aggregation is the better plan."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, sort)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
