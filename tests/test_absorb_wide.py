"""Linear and logistic models whose one-hot columns would not fit the driver."""

import numpy as np
import pytest

from ordertide.operators import supervised as SU
from ordertide.operators.absorb import INTERCEPT, fit_absorbed
from ordertide.sources.sales import ROW_KEY, sales_view
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def rows():
    """Levels of 40 that decide the category, which makes the columns collinear."""
    rng = np.random.default_rng(8)
    n = 400
    wide = np.minimum(rng.integers(0, 60, n), 40)
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(wide % 5 - 2 + x)))).astype(float)
    return [(f"w{a:02}", f"c{a % 3}", f"d{b}", float(v), float(t), float(1 + b)) for a, b, v, t in zip(wide, rng.integers(0, 4, n), x, y)]


def _design(rows):
    levels = [sorted({r[i] for r in rows}) for i in (0, 1, 2)]
    names = ["x", *(f"{c}_{v}" for c, ls in zip(("c", "d", "w"), (levels[1], levels[2], levels[0])) for v in ls)]
    x = np.array([[r[3] / 2.0, *(r[1] == v for v in levels[1]), *(r[2] == v for v in levels[2]), *(r[0] == v for v in levels[0])] for r in rows], float)
    return names, x, np.array([r[4] for r in rows]), np.array([r[5] for r in rows])


DDL = "w string, c string, d string, x double, y double, k double"


@pytest.mark.parametrize("hot", [1 << 18, 8])
def test_least_squares_are_the_shortest(spark, rows, hot):
    """Of the solutions for collinear columns the one of least length, whichever levels are hot."""
    names, x, y, _ = _design(rows)
    fitted = fit_absorbed(spark.createDataFrame(rows, DDL), "w", ["c", "d"], {"x": 2.0}, "y", 0.0, hot_rows=hot)
    want = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=1e-10)[0]
    got = {r["feature"]: r["value"] for r in fitted.coefficients().collect()}
    assert got.keys() == set(names) and np.allclose([got[n] for n in names], want, atol=1e-8)
    assert any(c == "w" for c, _ in fitted.narrow) == (hot == 8)


@pytest.mark.parametrize("hot", [1 << 18, 8])
def test_logistic_is_the_whole_system(spark, rows, hot):
    """The least penalised log loss over every one-hot column, by plain Newton steps."""
    names, x, y, k = _design(rows)
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.array([0.0] + [1.0] * len(names))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (k * (p - y)) + penalty * beta)
    train = spark.createDataFrame(rows, DDL)
    fitted = fit_absorbed(train, "w", ["c", "d"], {"x": 2.0}, "y", 1.0, logistic=True, weight="k", hot_rows=hot)
    got = {r["feature"]: r["value"] for r in fitted.coefficients().collect()}
    assert np.allclose([fitted.narrow[INTERCEPT, ""], *(got[n] for n in names)], beta, atol=1e-8)
    odds = {r[:4]: r["predicted"] for r in fitted.predict(train).collect()}
    assert np.allclose([odds[r[:4]] for r in rows], x @ beta, atol=1e-8)


def test_wide_models_absorb(spark, monkeypatch):
    """Above the bound no vocabulary is gathered, and predictions stay the same."""
    s = sales_view(spark, SF_SMALL)
    plain = SU.fit_regression(s, "ridge"), SU.fit_classifier(s)
    monkeypatch.setattr(SU, "ONEHOT_MAX_SLOTS", 100)
    wide = SU.fit_regression(s, "ridge"), SU.fit_classifier(s)
    assert not wide[0].get("feature_names") and not wide[1]["feature_names"]
    for (a, b), value, off in zip(zip(plain, wide), ("predicted", "score"), (1e-6, 2e-3)):
        a, b = ({tuple(r[c] for c in ROW_KEY): r[value] for r in f["predictions"].collect()} for f in (a, b))
        assert a.keys() == b.keys() and max(abs(a[c] - b[c]) for c in a) < off * max(map(abs, a.values()))
    assert plain[1]["summary"].collect() == wide[1]["summary"].collect()
