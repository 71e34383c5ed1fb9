import numpy as np
import pytest

from ordertide.operators import supervised as SU
from ordertide.operators.absorb import fit_absorbed
from ordertide.sources.sales import ROW_KEY, sales_view
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 300
    wide, cat, x = rng.integers(0, 60, n), rng.integers(0, 4, n), rng.normal(size=n)
    y = wide % 7 + 2.0 * (cat == 1) - x + rng.normal(size=n) * 0.1
    return [(f"w{a}", f"c{b}", float(v), float(t)) for a, b, v, t in zip(wide, cat, x, y)]


@pytest.mark.parametrize("alpha", [1.0, 0.25, 0.0])
def test_absorbed_is_the_whole_system(spark, rows, alpha):
    """The same fit as by the normal equations over every one-hot column."""
    train = spark.createDataFrame(rows, "w string, c string, x double, y double")
    fitted = fit_absorbed(train, "w", ["c"], {"x": 2.0}, "y", alpha)
    levels = [sorted({r[i] for r in rows}) for i in (0, 1)]
    full = np.array([[1.0, r[2] / 2.0, *(r[0] == v for v in levels[0]), *(r[1] == v for v in levels[1])] for r in rows], dtype=float)
    y = np.array([r[3] for r in rows])
    penalty = np.diag([0.0] + [alpha] * (full.shape[1] - 1))
    beta = np.linalg.pinv(full.T @ full + penalty) @ full.T @ y
    got = {(r["w"], r["c"], r["x"]): r["predicted"] for r in fitted.predict(train).collect()}
    assert np.allclose([got[r[:3]] for r in rows], full @ beta, atol=1e-8)
    if alpha:
        coefficients = {r["feature"]: r["value"] for r in fitted.coefficients().collect()}
        assert len(coefficients) == full.shape[1] - 1 and np.isclose(coefficients["w_w3"], beta[2 + levels[0].index("w3")])
    new = spark.createDataFrame([("none", "none", 0.0)], "w string, c string, x double")
    assert np.isclose(fitted.predict(new).first()["predicted"], fitted.narrow["\x00intercept", ""])


def test_absorbed_model_is_the_present_one(spark):
    """On the sales fact: ridge to 1e-6 of the label's size, against Spark's normal-equation solver."""
    s = sales_view(spark, SF_SMALL)
    fits = [SU.fit_regression(s, "ridge", solver=v) for v in ("normal", "absorb")]
    a, b = ({tuple(r[k] for k in ROW_KEY): r["predicted"] for r in f["predictions"].collect()} for f in fits)
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6 * max(map(abs, a.values()))
    top = [[(r["feature"], round(r["value"], 3)) for r in f["importances"].orderBy("rank").collect()] for f in fits]
    assert top[0] == top[1]


def test_only_group_bys(spark, rows):
    """No Python and no broadcast of what has a row for each wide level."""
    train = spark.createDataFrame(rows, "w string, c string, x double, y double")
    fitted = fit_absorbed(train, "w", ["c"], {"x": 1.0}, "y", 1.0)
    plan = fitted.predict(train)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
