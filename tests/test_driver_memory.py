"""Tables whose files are small and whose rows are not never go to the driver."""

import os
import re

import pytest
from pyspark.sql import functions as F

from ordertide.operators.joins import join_sized
from ordertide.sources.sales import sales_view
from tests.conftest import SF_SMALL

ROWS = 400_000


@pytest.fixture(scope="module")
def wide_dims(spark, tmp_path_factory):
    """The small star with many customers and parts of few distinct texts."""
    d = tmp_path_factory.mktemp("star")
    for t in ("region", "nation", "orders", "lineitem"):
        os.symlink(f"{SF_SMALL}/{t}.parquet", d / f"{t}.parquet")
    for t, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        known = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        more = known.where(F.col(key) == known.agg(F.max(key)).first()[0]).drop(key).crossJoin(
            spark.range(1 << 40, (1 << 40) + ROWS).withColumnRenamed("id", key))
        known.unionByName(more.select(known.columns)).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return str(d)


def test_well_compressed_dimensions_are_merged(spark, wide_dims):
    for t in ("customer", "part"):
        files = [os.path.join(wide_dims, f"{t}.parquet", f) for f in os.listdir(os.path.join(wide_dims, f"{t}.parquet"))]
        assert sum(os.path.getsize(f) for f in files) < 10 << 20  # Spark would broadcast them
    plan = sales_view(spark, wide_dims)._jdf.queryExecution().executedPlan().toString()
    for key in ("c_custkey", "p_partkey"):
        joins = [x for x in plan.splitlines() if "Join [" in x and key in x]
        assert joins and all("SortMergeJoin" in x for x in joins), joins


def test_same_sales_by_either_join(spark, wide_dims):
    few = sales_view(spark, SF_SMALL)
    many = sales_view(spark, wide_dims)
    assert many.count() == few.count() and many.exceptAll(few).isEmpty()


def test_small_dimensions_stay_broadcast(spark):
    plan = sales_view(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [o_custkey" in plan and "BroadcastHashJoin [l_partkey" in plan


def _broadcast_columns(plan: str) -> set[str]:
    """The columns that a plan's broadcasts scan."""
    found, at = set(), []  # at: the depths of the broadcasts above a line
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        at = [x for x in at if x < depth]
        if "BroadcastExchange" in line:
            at.append(depth)
        if at and "FileScan" in line:
            found |= set(re.findall(r"(\w+)#", line.split("]")[0]))
    return found


def test_many_customers_do_not_go_to_few_nations(spark, wide_dims):
    plan = sales_view(spark, wide_dims)._jdf.queryExecution().executedPlan().toString()
    assert not {"c_custkey", "p_partkey"} & _broadcast_columns(plan), plan


def test_many_rows_of_a_small_file_do_not_go_to_few(spark, tmp_path):
    few = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    spark.range(ROWS * 3).select((F.col("id") * 0).alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    many = spark.read.parquet(f"{tmp_path}/orders.parquet")
    on = F.col("o_custkey") == F.col("c_custkey")
    chosen = many.join(few, on)._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" in _broadcast_columns(chosen)  # by the files' bytes
    sized = join_sized(many, many, few, few, on, max_bytes=1 << 20)
    sent = _broadcast_columns(sized._jdf.queryExecution().executedPlan().toString())
    assert "c_custkey" in sent and "o_custkey" not in sent
    assert sized.count() == few.where("c_custkey = 0").count() * ROWS * 3
    merged = join_sized(many, many, few, few, on, max_bytes=1)
    assert not _broadcast_columns(merged._jdf.queryExecution().executedPlan().toString())
