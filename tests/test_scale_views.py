import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordertide.operators import cube as CU
from ordertide.operators import dist as DI
from ordertide.operators import filters as FL
from ordertide.operators import groups as G
from ordertide.operators import kpis as K
from ordertide.operators.panels import Panels
from ordertide.sources.sales import ROW_KEY, sales_view
from tests.conftest import SF_SMALL, make_sales


@pytest.fixture(scope="module")
def fact(spark):
    return spark.createDataFrame(sales_view(spark, SF_SMALL).toArrow())


@pytest.fixture(scope="module")
def cube(fact, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube"))
    CU.write_cube(CU.build_cube(fact), path)
    return fact.sparkSession.read.parquet(path)


VIEWS = [dict(), dict(regions=["ASIA", "EUROPE"]), dict(year=1998, categories=["PROMO", "ECONOMY"]), dict(year=1900)]


@pytest.mark.parametrize("view", VIEWS)
def test_cube_kpis(fact, cube, view):
    """Sums and rows exact, distinct counts within the bound, no fact in the plan."""
    want = K.kpi_totals(FL.apply_filters(fact, **view)).first()
    df = CU.cube_kpis(FL.apply_filters(cube, **view))
    got = df.first()
    assert all(got[c] == want[c] for c in ("total_sales", "total_profit", "row_count"))
    for c in ("order_count", "customer_count"):
        assert abs(got[c] - want[c]) <= CU.hll_relative_error() * want[c]
    plan = df._jdf.queryExecution().toString()
    assert "cube" in plan and "LocalTableScan" not in plan and "ExistingRDD" not in plan


@pytest.mark.parametrize("view", VIEWS[:3])
@pytest.mark.parametrize("groups", [[], ["category"], ["region", "segment"]])
def test_cube_quantiles(fact, cube, view, groups):
    """The exact ranks of the estimates lie within the sketch's rank error, in every group."""
    probs = [0.25, 0.5, 0.75]
    rows = FL.apply_filters(fact, **view).select(*groups, F.col("sales").cast("double").alias("x")).collect()
    values = {}
    for r in rows:
        values.setdefault(tuple(r[g] for g in groups), []).append(r["x"])
    got = CU.cube_quantiles(FL.apply_filters(cube, **view), probs, groups).collect()
    assert {tuple(r[g] for g in groups) for r in got} == values.keys()
    for r in got:
        x = np.sort(values[tuple(r[g] for g in groups)])
        assert r["n"] == len(x)
        for p, name in zip(probs, ("q25", "q50", "q75")):
            below, upto = np.searchsorted(x, r[name], "left") / len(x), np.searchsorted(x, r[name], "right") / len(x)
            assert below - CU.kll_rank_error() - 1 / len(x) <= p <= upto + CU.kll_rank_error() + 1 / len(x)


def test_cube_edges(spark):
    rows = make_sales(spark, [dict(region=None), dict(sales="5", customer_id=None), dict(order_date=dt.datetime(2020, 1, 1, 23, 5))])
    cube = CU.build_cube(rows)
    assert cube.count() == 2 and CU.cube_kpis(cube).first()["row_count"] == 3
    none = CU.build_cube(rows.limit(0))
    got = CU.cube_kpis(none).first()
    assert (got["total_sales"], got["order_count"], got["row_count"]) == (0.0, 0, 0)
    assert CU.cube_quantiles(none, [0.5]).count() == 0
    assert CU.cube_boxes(cube, "region").count() == 1


def test_one_scan(spark):
    """Every panel of one scan equals the panel by itself; the fact is read once."""
    df = make_sales(spark, [dict(region=r, category=c, sales=str(10 * i + j), segment=None if i == 2 else "S", state="T", sub_category=s)
                            for i, r in enumerate(("A", "B", None)) for j, (c, s) in enumerate((("x", "p"), ("y", "q"), (None, "r")))])
    panels = Panels(df)
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(panels.by("region")) == rows(G.sales_by_region(df)) and rows(panels.by("category")) == rows(G.sales_by_category(df))
    assert rows(panels.by("order_month")) == rows(G.sales_by_month(df))
    for name, (parent, child) in G.HIERARCHIES.items():
        assert rows(panels.hierarchy(name)) == rows(G.sales_hierarchy(df, parent, child)), name
    assert panels.totals().first()["row_count"] == 9
    empty = Panels(df.limit(0))
    assert empty.totals().first()["total_sales"] == 0.0 and empty.by("region").count() == 0
    plan = panels.sums._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # written once


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_binned_density_is_within_its_bound(spark, spread):
    rng = np.random.default_rng(int(spread))
    x = np.concatenate([rng.normal(size=3000), np.exp(spread * rng.normal(size=3000))])
    df = spark.createDataFrame([(float(v),) for v in x], "sales double")
    a = {r["point"]: r["density"] for r in DI.kde(df).collect()}
    b = {r["point"]: r["density"] for r in DI.kde_binned(df).collect()}
    h = x.std(ddof=1) * len(x) ** -0.2
    top = 1 / (h * np.sqrt(2 * np.pi))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) <= DI.kde_bin_error() * top * (1 + 1e-9)
    one = spark.createDataFrame([(2.0,), (2.0,)], "sales double")
    assert DI.kde_binned(one).count() == 0 and DI.kde_binned(df.limit(0)).count() == 0


def test_rug_sample(spark):
    df = make_sales(spark, [dict(order_id=i, sales=str(i % 97 + (1000 if i == 5 else 0))) for i in range(900)])
    a = DI.rug_sample(df, ROW_KEY, bins=10, per_bin=7).collect()
    b = DI.rug_sample(df.repartition(6), ROW_KEY, bins=10, per_bin=7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 8 and {r["bin"] for r in a} == {0, 9}
    assert DI.rug_sample(df.limit(0), ROW_KEY).count() == 0
