"""Hand-made edge fixtures (nulls, empty filters, time-of-day, leap day,
short history, bad dates, ties, guards, unseen levels, score ties)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, make_sales
from ordertide.functions import dates as D
from ordertide.operators import cluster as CL
from ordertide.operators import dist as DI
from ordertide.operators import evalcurves as EC
from ordertide.operators import features as FE
from ordertide.operators import filters as FL
from ordertide.operators import groups as G
from ordertide.operators import kpis as K
from ordertide.operators import series as SE
from ordertide.operators import supervised as SU
from ordertide.operators.ranking import global_rank
from ordertide.sources.files import nan_to_null, parse_date


def test_null_keys(spark):
    df = make_sales(spark, [
        dict(region=None, order_id=1), dict(region="R1", order_id=2), dict(region="R2", order_id=None),
        dict(region="R2", order_id=3, customer_id=None), dict(region="R1", order_id=3), dict(region="R3")])
    k = K.kpi_totals(df).first()
    assert k.order_count == 3          # NULL order id not counted
    assert k.customer_count == 1       # one non-NULL customer id
    regions = {r.region for r in G.sales_by_region(df).collect()}
    assert regions == {"R1", "R2", "R3"}   # NULL key dropped


def test_nan_is_skipped_after_ingest(spark):
    raw = spark.createDataFrame([(1.0,), (float("nan"),), (2.5,)], "sales double")
    out = nan_to_null(raw).agg(F.sum("sales").alias("s"), F.count("sales").alias("n")).first()
    assert out.s == 3.5 and out.n == 2


def test_empty_filter(spark):
    df = make_sales(spark, [dict(), dict(order_date=dt.datetime(2020, 6, 1))])
    empty = FL.filter_in_dims(df, regions=["nowhere"])
    k = K.kpi_totals(empty).first()
    assert (k.total_sales, k.order_count, k.customer_count, k.row_count) == (0.0, 0, 0, 0)
    y = K.ytd_metrics_clamped(empty, "2020-06-01", FL.bounds(df)).first()
    assert y.ytd_sales == 0.0 and y.yoy_pct is None
    assert SU.fit_regression(empty, "linear")["error"] == "too_few_rows"


def test_filter_in_dims_empty_list_is_identity(spark):
    df = make_sales(spark, [dict(region="A"), dict(region=None)])
    assert FL.filter_in_dims(df, [], None, []).count() == 2


def test_end_of_day(spark):
    df = make_sales(spark, [dict(order_date=dt.datetime(2020, 3, 1)),
                            dict(order_date=dt.datetime(2020, 3, 31, 15, 0))])
    assert FL.filter_date_range(df, "2020-03-01", "2020-03-31").count() == 2   # calendar date
    assert FL.filter_ts_between(df, "2020-03-01", "2020-03-31").count() == 1   # midnight timestamp
    y = K.ytd_metrics_clamped(df, "2020-03-31", FL.bounds(df)).first()
    assert y.ytd_sales == 10.0   # the 15:00 order is after the midnight end bound


def test_leap_year_offsets(spark):
    a = dt.datetime(2020, 2, 29, 13, 30)
    assert D.add_years(a, -1) == dt.datetime(2019, 2, 28, 13, 30)
    assert D.add_months(dt.datetime(2020, 3, 31), -1) == dt.datetime(2020, 2, 29)
    df = make_sales(spark, [dict(order_date=a), dict(order_date=dt.datetime(2019, 2, 28, 13, 30)),
                            dict(order_date=dt.datetime(2019, 2, 28, 13, 29))])
    assert FL.filter_trailing_preset(df, "LAST_1Y").count() == 2


def test_short_history_clamped_lytd(spark):
    df = make_sales(spark, [dict(order_date=dt.datetime(2020, 3, 1), sales=7),
                            dict(order_date=dt.datetime(2020, 5, 1), sales=5),
                            dict(order_date=dt.datetime(2020, 6, 1), sales=3)])
    y = K.ytd_metrics_clamped(df, "2020-06-01", FL.bounds(df)).first()
    # last year precedes the data: both LYTD bounds clamp to the first day
    assert y.lytd_sales == 7.0 and y.ytd_sales == 15.0
    assert abs(y.yoy_pct - (15 - 7) / 7) < 1e-12


def test_bad_dates(spark):
    raw = spark.createDataFrame([("2020-01-02",), ("xx",)], "d string")
    lenient = raw.select(parse_date(F.col("d"), "lenient").alias("t")).collect()
    assert lenient[1].t is None and lenient[0].t == dt.datetime(2020, 1, 2)
    with pytest.raises(Exception):
        raw.select(parse_date(F.col("d"), "strict")).collect()


def test_top_n_ties_break_by_key(spark):
    rows = [dict(sub_category=f"S{i:02d}", sales=100) for i in range(12)]
    top = [r.sub_category for r in G.top_n_subcategories(make_sales(spark, rows)).collect()]
    assert top == [f"S{i:02d}" for i in range(10)]


def _months(spark, months, value=lambda i: 100 + 10 * i):
    return make_sales(spark, [dict(order_date=dt.datetime(y, m, 1), sales=value(i))
                              for i, (y, m) in enumerate(months)])


def test_forecast_guard_and_gap_closing(spark):
    seven = [(2020, m) for m in (1, 2, 3, 5, 6, 7, 8)]        # one gap (April)
    f7 = SE.forecast_monthly(_months(spark, seven)).collect()
    assert {r.kind for r in f7} == {"history"} and len(f7) == 7
    eight = seven + [(2020, 9)]
    f8 = SE.forecast_monthly(_months(spark, eight)).orderBy("ds").collect()
    fc = [r for r in f8 if r.kind == "forecast"]
    assert len(fc) == 6 and fc[0].ds == dt.datetime(2020, 10, 1) and fc[-1].ds == dt.datetime(2021, 3, 1)


def test_constant_series_band_collapses(spark):
    months = [(2020, m) for m in range(1, 9)]
    fc = [r for r in SE.forecast_monthly(_months(spark, months, lambda i: 50)).collect() if r.kind == "forecast"]
    assert all(r.yhat_upper == r.yhat == r.yhat_lower == 50.0 for r in fc)


def test_classifier_guards(spark):
    few = make_sales(spark, [dict(sales=i) for i in range(39)])
    assert SU.fit_classifier(few) == {"error": "too_few_rows", "rows": 39, "needed": 40}
    same = make_sales(spark, [dict(sales=5) for _ in range(60)])
    assert SU.fit_classifier(same)["error"] == "unbalanced_classes"
    r199 = make_sales(spark, [dict(sales=i) for i in range(199)])
    assert SU.fit_regression(r199, "linear") == {"error": "too_few_rows", "rows": 199, "needed": 200}


def test_cluster_guards(spark):
    three = make_sales(spark, [dict(region="R", category=c) for c in "ABC"])
    assert CL.cluster_groups_table(three) == (None, "too_few_groups")
    assert CL.cluster_groups_table(three.drop("region")) == (None, "missing_columns")
    assert CL.choose_k(4) == 3 and CL.choose_k(30) == 5 and CL.choose_k(2) is None
    four = make_sales(spark, [dict(region="R", category=c, sales=10 * (i + 1), order_id=i)
                              for i, c in enumerate("ABCD")])
    out = CL.kmeans_clusters(CL.cluster_groups_table(four)[0], n_init=2)
    assert out.count() == 4 and out.select("cluster").distinct().count() <= 3


def test_unseen_level_is_all_zero(spark):
    train = make_sales(spark, [dict(region="A"), dict(region="B")])
    test = make_sales(spark, [dict(region="Z")])
    fm = FE.fit_features(train, ["region"], [])
    v = fm.transform(test).select("features").first().features
    assert v.size == 2 and v.numNonzeros() == 0
    assert fm.names == ["region_A", "region_B"]


def test_score_ties_one_point_per_score(spark):
    pred = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    st = EC.score_table(pred).orderBy("rank").collect()
    assert [r.threshold for r in st] == [0.9, 0.5, 0.1]
    assert [(r.tps, r.fps) for r in st] == [(1, 1), (2, 2), (2, 3)]


def test_mode_ties_go_to_smallest(spark):
    df = make_sales(spark, [dict(region="B"), dict(region="A"), dict(region="B"), dict(region="A")])
    assert [tuple(r) for r in FE.mode_table(df, ["region"]).collect()] == [("region", "A", 2)]


def test_profit_uses_decimal_sum(spark):
    df = make_sales(spark, [dict(profit=Decimal("0.1")) for _ in range(10)])
    assert K.kpi_totals(df).first().total_profit == 1.0


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else f"g{i % 3}", i) for i in range(100)], "g string, id long")
    r = global_rank(df, ["id"], group_cols=["g"], size_col="n", num_partitions=3).collect()
    assert len(r) == 100
    assert sorted(x["rank"] for x in r if x.g is None) == list(range(1, 26)) and {x.n for x in r if x.g is None} == {25}


def test_quantiles_by_selection(spark):
    """Ties, NULL groups, infinities apart: as numpy's, at any scale."""
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, vs in {"a": rng.normal(0, 1e-9, 501), "b": rng.lognormal(20, 8, 1000), "c": np.full(7, 3.25),
                                        None: np.array([-1e308, 1e308, 0.0, 5.0]), "d": np.repeat(rng.normal(0, 1, 40), 25)}.items() for v in vs]
    df = spark.createDataFrame([*rows, ("a", None)], "g string, v double").repartition(5)
    got = {r.g: r for r in DI.exact_quantiles(df, "v", [0.1, 0.5, 0.75], ["g"]).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g, r in got.items():
        vs = sorted(v for k, v in rows if k == g)
        assert r.n == len(vs)
        for p, q in ((0.1, r.q10), (0.5, r.q50), (0.75, r.q75)):
            h = p * (len(vs) - 1)
            lo, hi = vs[int(np.floor(h))], vs[int(np.ceil(h))]
            assert q == (lo if h == int(h) else lo + (hi - lo) * (h - np.floor(h)))
    whole = DI.exact_quantiles(df.where("g = 'b'"), "v", [0.5]).first()
    assert whole.q50 == got["b"].q50 and DI.exact_quantiles(df.where("false"), "v", [0.5]).first().q50 is None


def test_missing_numbers(spark):
    """NaN and infinities are missing; columns without a value drop out; no column at all is a reason."""
    df = make_sales(spark, [dict(postal_code=v) for v in (1.0, 2.0, float("nan"), float("nan"), float("inf"))])
    assert [(r.col, r.n, r.median) for r in FE.median_table(df, ["postal_code"]).collect()] == [("postal_code", 2, 1.5)]
    rows = make_sales(spark, [dict(sales=i, order_id=i, postal_code=None, product_id=None if i % 9 == 0 else i % 4) for i in range(400)])
    r = SU.fit_regression(rows, "linear")
    assert "postal_code" not in r["feature_names"] and r["metrics"].first().test_rows > 40
    pred = r["predictions"]
    assert dict(pred.dtypes)["product_id"] == "bigint"
    keys = {(x.order_id, x.product_id) for x in pred.collect()}
    assert keys <= {(i, None if i % 9 == 0 else i % 4) for i in range(400)} and any(k[1] is None for k in keys)
    bare = rows.select("order_id", "line_number", "supplier_id", "extended_price", "sales")
    key = ["order_id", "line_number", "supplier_id", "extended_price"]
    assert SU.fit_regression(bare, "ridge", key_cols=key) == {"error": "no_features", "rows": 400}
    assert SU.fit_classifier(bare, key_cols=key) == {"error": "no_features", "rows": 400}


def test_hierarchy_splits(spark):
    """k clusters at level k, nested levels, falling cost."""
    from ordertide.sources.sales import sales_view
    x, _ = CL.cluster_groups_table(sales_view(spark, SF_SMALL))
    rows = CL.cluster_hierarchy(x).collect()
    levels = {}
    for r in rows:
        levels.setdefault(r.level, {})[r.group] = r.cluster
    cost = {r.level: r.cost for r in rows}
    for k in sorted(levels):
        assert len(set(levels[k].values())) == k
        if k > 2:
            assert cost[k] < cost[k - 1]
            parents = {}
            for g, c in levels[k].items():
                parents.setdefault(c, set()).add(levels[k - 1][g])
            assert all(len(p) == 1 for p in parents.values())


def test_silhouette_is_the_pairwise_one(spark):
    import numpy as np
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(1)
    rows = [(int(c), *map(float, rng.normal(c, 1, 2))) for c in rng.integers(0, 3, 60)] + [(9, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "cluster int, a double, b double")
    got = CL.silhouette(df, ["a", "b"]).first()[0]
    x, c = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        a, b = d[i, own].mean() if own.any() else None, min(d[i, c == k].mean() for k in set(c) if k != c[i])
        s.append(0.0 if a is None else (b - a) / max(a, b))
    assert abs(got - np.mean(s)) < 1e-12
    both = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    assert abs(got - ClusteringEvaluator(predictionCol="cluster").evaluate(both)) < 1e-9


def test_solvers_agree(spark):
    """The two solvers give the same ridge and OLS fits."""
    rows = make_sales(spark, [dict(sales=(i * 37) % 101 + i % 7, order_id=i, postal_code=float(i % 23), region=f"R{i % 3}") for i in range(400)])
    for model in ("linear", "ridge"):
        fits = [SU.fit_regression(rows, model, features=["postal_code", "region"], solver=s)["predictions"] for s in ("normal", "l-bfgs")]
        a, b = ({r.order_id: r.predicted for r in f.collect()} for f in fits)
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 * (1 + abs(a[k])) for k in a)


def test_band_at_any_level(spark):
    """The forecast band follows the noise, whatever the series' level."""
    import numpy as np
    noise = np.random.default_rng(0).normal(0, 1, 24)
    months = [(2019 + i // 12, i % 12 + 1) for i in range(24)]
    bands = []
    for base in (0, 10 ** 6, 10 ** 9, 10 ** 11):
        f = SE.forecast_monthly(_months(spark, months, lambda i: round(float(base + noise[i]), 3)))
        bands.append([(r.yhat_upper - r.yhat_lower) / 2 for r in f.collect() if r.kind == "forecast"][0])
    assert 1.0 < bands[0] < 3.0 and all(abs(b - bands[0]) < 1e-3 for b in bands)


def test_probit_is_the_inverse(spark):
    from statistics import NormalDist

    from ordertide.functions.normal import probit
    ps = [1e-300, 1e-12, 1e-5, 0.01, 0.0749, 0.075, 0.3, 0.5, 0.7, 0.925, 0.9251, 0.999, 1 - 1e-9]
    got = [r.x for r in spark.createDataFrame([(p,) for p in ps], "p double").select(probit(F.col("p")).alias("x")).collect()]
    assert all(abs(a - NormalDist().inv_cdf(p)) <= 1e-12 * max(1, abs(a)) for a, p in zip(got, ps))


def test_kde_keeps_its_digits(spark):
    df = spark.createDataFrame([(1e13 * (1 + i / 50),) for i in range(50)], "sales double")
    assert len({r.density for r in DI.kde(df, "sales", 100).collect()}) > 40
