"""Library results against closed forms computed with numpy."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import make_sales
from ordertide.operators import dist as DI
from ordertide.operators import evalcurves as EC
from ordertide.operators import groups as G
from ordertide.operators import series as SE
from ordertide.operators.ranking import global_rank

RNG = np.random.default_rng(7)


def _month_fixture(spark, ys, gap_after=None):
    rows, y, m = [], 2019, 1
    for i, v in enumerate(ys):
        rows.append(dict(order_date=dt.datetime(y, m, 1), sales=round(float(v), 2)))
        m += 2 if gap_after is not None and i == gap_after else 1
        while m > 12:
            m -= 12
            y += 1
    return make_sales(spark, rows)


def test_forecast_matches_ridge_closed_form(spark):
    ys = np.round(1000 + 30 * np.arange(14) + 200 * np.sin(np.arange(14)) + RNG.normal(0, 50, 14), 2)
    out = SE.forecast_monthly(_month_fixture(spark, ys, gap_after=5)).collect()
    t = np.arange(14, dtype=float)
    w = 2 * math.pi / 12
    X = np.column_stack([t, np.sin(w * t), np.cos(w * t)])
    Xc, yc = X - X.mean(0), ys - ys.mean()
    beta = np.linalg.solve(Xc.T @ Xc + 5.0 * np.eye(3), Xc.T @ yc)
    b0 = ys.mean() - X.mean(0) @ beta
    sigma = np.std(ys - (X @ beta + b0), ddof=1)
    tf = np.arange(14, 20, dtype=float)
    yf = np.column_stack([tf, np.sin(w * tf), np.cos(w * tf)]) @ beta + b0
    fc = sorted((r for r in out if r.kind == "forecast"), key=lambda r: r.ds)
    assert np.allclose([r.yhat for r in fc], yf, atol=0.011)
    assert np.allclose([r.yhat_upper - r.yhat for r in fc], 1.96 * sigma, atol=0.011)


def test_trend_by_index_matches_polyfit(spark):
    ys = np.round(RNG.uniform(100, 200, 9), 2)
    tr = SE.trend_by_index(G.sales_by_month(_month_fixture(spark, ys))).orderBy("month_index").collect()
    m, b = np.polyfit(np.arange(9.0), ys, 1)
    assert np.allclose([r.trend for r in tr], m * np.arange(9) + b, atol=0.006)


def test_trend_by_date_matches_polyfit(spark):
    ys = np.round(RNG.uniform(100, 200, 9), 2)
    s = SE.monthly_series(_month_fixture(spark, ys, gap_after=3))
    tr = SE.trend_by_date(s).orderBy("ds").collect()
    x = np.array([r.ds.toordinal() for r in tr], dtype=float)
    m, b = np.polyfit(x, ys, 1)
    assert np.allclose([r.trend for r in tr], m * x + b, atol=0.006)


def _xy(spark, n=60, p=3, logistic=False):
    X = RNG.normal(size=(n, p))
    if logistic:
        y = (X @ np.array([1.0, -2.0, 0.5]) + RNG.normal(0, 1, n) > 0.8).astype(float)
    else:
        y = 3 + X @ np.array([2.0, -1.0, 0.5]) + RNG.normal(0, 0.3, n)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)],
                               ", ".join(f"x{i} double" for i in range(p)) + ", y double")
    df = VectorAssembler(inputCols=[f"x{i}" for i in range(p)], outputCol="features").transform(df)
    return X, y, df


def test_ridge_regparam_mapping(spark):
    """alpha * stddev_pop(y) / n with the normal solver == sklearn Ridge."""
    X, y, df = _xy(spark)
    alpha, n = 1.0, len(y)
    lr = LinearRegression(labelCol="y", regParam=alpha * np.std(y) / n, elasticNetParam=0.0,
                          standardization=False, solver="normal").fit(df)
    Xc, yc = X - X.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    assert np.allclose(lr.coefficients.toArray(), beta, atol=1e-6)
    assert abs(lr.intercept - (y.mean() - X.mean(0) @ beta)) < 1e-6


def test_logistic_regparam_mapping(spark):
    """regParam = 1/n with balanced weights == C=1 L2 logistic (Newton)."""
    X, y, df = _xy(spark, n=200, logistic=True)
    n = len(y)
    wts = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    df = df.withColumn("w", F.when(F.col("y") == 1, float(wts[y == 1][0])).otherwise(float(wts[y == 0][0])))
    m = LogisticRegression(labelCol="y", weightCol="w", regParam=1.0 / n, elasticNetParam=0.0,
                           standardization=False, maxIter=1000, tol=1e-10).fit(df)
    A = np.column_stack([X, np.ones(n)])
    theta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ theta))
        grad = A.T @ (wts * (p - y)) + np.r_[theta[:3], 0]
        H = A.T @ (A * (wts * p * (1 - p))[:, None]) + np.diag([1, 1, 1, 0])
        theta -= np.linalg.solve(H, grad)
    assert np.allclose(m.coefficients.toArray(), theta[:3], atol=1e-4)
    assert abs(m.intercept - theta[3]) < 1e-4


def _sk_curves(y, s):
    """numpy statement of the published ROC/PR definitions."""
    order = np.argsort(-s, kind="mergesort")
    s, y = s[order], y[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    fpr = np.r_[0, fps[keep]] / fps[-1]
    tpr = np.r_[0, tps[keep]] / tps[-1]
    auc = np.trapezoid(np.r_[0, tps] / tps[-1], np.r_[0, fps] / fps[-1])
    prec, rec = tps / (tps + fps), tps / tps[-1]
    ap = np.sum(np.diff(np.r_[0, rec]) * prec)
    return fpr, tpr, auc, ap


def test_roc_pr_auc_ap(spark):
    y = RNG.integers(0, 2, 300)
    s = np.round(RNG.uniform(0, 1, 300), 2)  # many ties
    pred = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    fpr, tpr, auc, ap = _sk_curves(y.astype(float), s)
    roc = EC.roc_curve(pred).orderBy("rank").collect()
    assert np.allclose([r.fpr for r in roc], fpr) and np.allclose([r.tpr for r in roc], tpr)
    assert abs(EC.roc_auc(pred).first().roc_auc - auc) < 1e-12
    assert abs(EC.average_precision(pred).first().average_precision - ap) < 1e-12
    pr = EC.pr_curve(pred).collect()
    assert len(pr) == len(np.unique(s)) + 1
    assert any(r.recall == 0.0 and r.precision == 1.0 for r in pr)


def test_global_rank_any_partition_count(spark):
    df = spark.range(5000).select("id", ((F.col("id") * 31) % 97).alias("v"), (F.col("id") % 4).alias("g"))
    expect = sorted(range(5000), key=lambda i: ((i * 31) % 97, i))
    for n in (1, 3, 11):
        r = global_rank(df, ["v", "id"], num_partitions=n, sum_cols=["v"]).orderBy("rank").collect()
        assert [x.id for x in r] == expect
        assert r[-1].cum_v == sum((i * 31) % 97 for i in range(5000))
    rg = global_rank(df, ["v", "id"], group_cols=["g"], num_partitions=5, size_col="n")
    assert rg.groupBy("g").agg(F.max("rank").alias("m"), F.max("n").alias("n")).where("m != n").count() == 0


def test_quantiles_linear_and_hazen(spark):
    x = np.round(RNG.exponential(100, 501), 3)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)], "sales double, k long")
    q = DI.exact_quantiles(df, "sales", [0.25, 0.5, 0.75]).first()
    assert np.allclose([q.q25, q.q50, q.q75], np.percentile(x, [25, 50, 75]), rtol=0, atol=1e-9)
    xs = np.sort(x)

    def hazen(p):
        h = min(max(p * len(xs) - 0.5, 0), len(xs) - 1)
        lo = int(math.floor(h))
        return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (h - lo)

    qh = DI.exact_quantiles(df, "sales", [0.25, 0.75], method="hazen").first()
    assert abs(qh.q25 - hazen(0.25)) < 1e-9 and abs(qh.q75 - hazen(0.75)) < 1e-9


def test_box_whiskers(spark):
    x = np.r_[np.arange(1.0, 21.0), 100.0]
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)], "sales double, k long")
    b = DI.box_stats(df, "sales", None).first()
    assert b.whisker_high == 20.0 and b.whisker_low == 1.0 and b.outliers == 1
    assert DI.box_outliers(df, "sales", None).first().sales == 100.0


def test_histogram_counts(spark):
    x = RNG.normal(0, 1, 1000)
    df = spark.createDataFrame([(float(v),) for v in x], "sales double")
    h = DI.histogram(df, "sales").orderBy("bin").collect()
    assert len(h) == 31 and sum(r["count"] for r in h) == 1000
    edges = np.linspace(x.min(), x.max(), 32)
    counts, _ = np.histogram(x, edges)
    assert np.abs(np.array([r["count"] for r in h]) - counts).sum() <= 2  # edge rounding only


def test_kde_matches_direct_sum(spark):
    x = np.round(RNG.normal(50, 10, 400), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "sales double")
    k = DI.kde(df, "sales", 500).orderBy("point").collect()
    h = np.std(x, ddof=1) * len(x) ** -0.2
    grid = x.min() + np.arange(500) * (x.max() - x.min()) / 500
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose([r.density for r in k], dens, atol=1e-12)


def test_qq_normal(spark):
    x = RNG.gamma(2.0, 3.0, 200)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(x)], "sales double, k long")
    qq = DI.qq_normal(df, "sales", ["k"]).orderBy("rank").collect()
    n = len(x)
    m = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    m[-1] = 0.5 ** (1 / n)
    m[0] = 1 - m[-1]
    osm = np.array([NormalDist().inv_cdf(p) for p in m])
    assert np.allclose([r.osm for r in qq], osm, atol=5e-9)
    assert np.allclose([r.osr for r in qq], np.sort(x))
    fit = DI.qq_fit(DI.qq_normal(df, "sales", ["k"])).first()
    slope, icpt = np.polyfit(osm, np.sort(x), 1)
    assert abs(fit.slope - slope) < 1e-6 * abs(slope) and abs(fit.intercept - icpt) < 1e-6 * abs(icpt)


def test_global_rank_hot_group_is_split(spark):
    """One group holds a third of the rows: its rows must spread over several
    range partitions and still get exact ranks."""
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1)
                                  .alias("g"), ((F.col("id") * 7) % 1000).alias("v"))
    r = global_rank(df, ["v", "id"], group_cols=["g"], num_partitions=8, size_col="n")
    hot = r.where("g = 0")
    assert hot.count() == 3000 and hot.agg(F.max("rank")).first()[0] == 3000
    expect = sorted(range(0, 9000, 3), key=lambda i: ((i * 7) % 1000, i))
    assert [x.id for x in hot.orderBy("rank").collect()] == expect
    spread = (df.repartitionByRange(8, "g", "v", "id").where("g = 0")
              .select(F.spark_partition_id().alias("p")).distinct().count())
    assert spread > 1
