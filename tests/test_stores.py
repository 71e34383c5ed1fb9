import datetime as dt
import os

from pyspark.sql import functions as F

from ordertide.operators import cluster as CL
from ordertide.operators import groups as G
from ordertide.sources.sales import load_increment, read_store, write_bucketed
from tests.conftest import make_sales


def fact(spark, extra=(), change=None):
    rows = [dict(order_id=i, order_date=dt.datetime(2020, 1 + i % 4, 1 + i), sales=str(i), product_name=f"P{i % 5}") for i in range(20)]
    for i, v in (change or {}).items():
        rows[i].update(v)
    return make_sales(spark, [*rows, *extra])


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_increments(spark, tmp_path):
    """Only changed, new and late months are rewritten; totals stay right; a load without changes writes nothing."""
    path = str(tmp_path / "store")
    total = lambda: tuple(read_store(spark, path).agg(F.count(F.lit(1)), F.sum("sales")).first())
    want = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum("sales")).first())
    first = fact(spark)
    assert load_increment(first, path) == ["2020-01", "2020-02", "2020-03", "2020-04"] and total() == want(first)
    before = files(path)
    assert load_increment(first.repartition(3), path) == [] and files(path) == before
    second = fact(spark, [dict(order_id=99, order_date=dt.datetime(2020, 2, 5), sales="7"), dict(order_id=100, order_date=dt.datetime(2020, 9, 1)),
                          dict(order_id=101, order_date=None)])
    assert load_increment(second, path) == ["2020-02", "2020-09", "none"] and total() == want(second)
    after = files(path)
    assert all(after.get(f) == t for f, t in before.items() if "2020-02" not in f) and any(f not in after for f in before if "2020-02" in f)
    third = second.where("order_month < timestamp'2020-04-01' or order_date is null")
    assert load_increment(third, path) == ["2020-04", "2020-09"] and total() == want(third)
    assert sorted(read_store(spark, path).columns) == sorted(first.columns)


def test_bucketed_fact_needs_no_exchange(spark, tmp_path):
    df = fact(spark, [dict(order_id=3, product_name=None)])
    t = write_bucketed(df, "bucketed_fact_test", 4, path=str(tmp_path / "b"))
    try:
        got = G.orders_per_product(t)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, G.orders_per_product(df).collect()))
        counted = t.where("product_name is not null").groupBy("product_name").agg(F.count_distinct("order_id").alias("orders"), F.sum("sales").alias("sales"))
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        joined = t.where("product_name is not null").join(counted.hint("merge"), "product_name")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE bucketed_fact_test")


def test_plain_silhouette_is_the_pairwise_one(spark):
    rows = [(0, 0.0, 0.0), (0, 1.0, 0.0), (0, 1.0, 0.0), (1, 5.0, 5.0), (1, 6.0, 5.0), (2, -9.0, 2.0)]
    got = CL.silhouette_euclidean(spark.createDataFrame(rows, "cluster int, a double, b double"), ["a", "b"]).first()["silhouette"]
    apart = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    scores = []
    for i, p in enumerate(rows):
        mean = {c: [apart(p, q) for j, q in enumerate(rows) if q[0] == c and j != i] for c in (0, 1, 2)}
        if not mean[p[0]]:
            scores.append(0.0)
            continue
        own, other = sum(mean[p[0]]) / len(mean[p[0]]), min(sum(v) / len(v) for c, v in mean.items() if c != p[0])
        scores.append((other - own) / max(own, other))
    assert abs(got - sum(scores) / len(scores)) < 1e-12
    df = spark.createDataFrame(rows, "cluster int, a double, b double")
    assert CL.silhouette_euclidean(df, ["a", "b"], max_rows=5) == {"error": "too_many_rows", "rows": 6, "most": 5}
    assert CL.silhouette_euclidean(df.where("cluster = 0"), ["a", "b"]).first()["silhouette"] is None
    assert CL.silhouette_euclidean(df.limit(0), ["a", "b"]).first()["silhouette"] is None
