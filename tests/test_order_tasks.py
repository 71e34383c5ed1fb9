"""Counts of distinct orders run in tasks of a bounded number of lines, whatever partition size the session has."""

import pytest
from pyspark.sql import functions as F

from ordertide.plans import catalog
from ordertide.sources import sales
from tests.conftest import SF_SMALL

NAMES = ["group_features", "top_products_pivot", "top_products_pivot_join", "top_products_table", "orders_per_product",
         "left_join_orders_per_product", "top_customers", "top_customers_table", "standardize_groups"]


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(sales, "LINES_A_TASK", 250, raising=False)


@pytest.mark.parametrize("name", NAMES)
def test_orders_are_counted_in_bounded_tasks(spark, small_tasks, monkeypatch, name):
    dealt = catalog.REGISTRY[name].fn(spark, SF_SMALL)
    if name != "standardize_groups":  # its group table is computed already
        assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    got = dealt.collect()
    monkeypatch.setattr(sales, "MIN_TASKS", 1 << 40)
    plain = catalog.REGISTRY[name].fn(spark, SF_SMALL)
    assert "REPARTITION_BY_NUM" not in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got)) == sorted(map(str, plain.collect())) and got


def test_no_task_gets_many_lines(spark, small_tasks):
    fact = sales.sales_by_order(spark, SF_SMALL)
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    sizes = [r["count"] for r in fact.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == sales.sales_view(spark, SF_SMALL).count() and max(sizes) < 2 * 250 < lines
    assert fact.select("order_id", F.spark_partition_id().alias("p")).distinct().groupBy("order_id").count().where("count > 1").isEmpty()


def test_few_lines_are_left_alone(spark):
    assert "REPARTITION_BY_NUM" not in sales.sales_by_order(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_standardized_groups_run_the_join_once(spark):
    out = catalog.REGISTRY["standardize_groups"].fn(spark, SF_SMALL)
    assert "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()
