"""Scale options: approximate distinct counts, hashed encoding, checked broadcast."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ordertide.operators import kpis as K
from ordertide.operators import supervised as SU
from ordertide.operators.joins import broadcast_if_small, join_small
from ordertide.sources.sales import sales_view


def test_approx_distinct_close_to_exact(spark):
    s = sales_view(spark, SF_SMALL)
    ex = K.kpi_totals(s).first()
    ap = K.kpi_totals(s, distinct="approx").first()
    assert abs(ap.order_count - ex.order_count) <= 0.05 * ex.order_count
    assert ap.total_sales == ex.total_sales and ap.row_count == ex.row_count


def test_hashed_encoding_regression(spark):
    s = sales_view(spark, SF_SMALL)
    r = SU.fit_regression(s, "ridge", encoding="hash")
    m = r["metrics"].first()
    assert m.test_rows > 0 and m.rmse > 0
    names = [x.feature for x in r["importances"].collect()]
    assert len(names) == 20 and all(n.startswith("hash_") or n == "postal_code" for n in names)


def test_checked_broadcast(spark):
    big = spark.range(1000).withColumn("g", F.col("id") % 7)
    small = spark.range(7).withColumnRenamed("id", "g").withColumn("w", F.col("g").cast("string"))
    plan = join_small(big, small, "g")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert join_small(big, small, "g").count() == 1000
    # beyond the bound the hint is not applied
    assert broadcast_if_small(small, max_bytes=100) is small
