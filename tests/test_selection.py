import numpy as np
import pytest

from ordertide.operators import dist as DI


@pytest.mark.parametrize("kind", ["magnitudes", "signs", "zeros", "usual"])
def test_rounds_are_bounded_whatever_the_values(spark, monkeypatch, kind):
    """Exact quantiles of values of all magnitudes and both signs, in at most 9 rounds."""
    rng = np.random.default_rng(2)
    x = {"magnitudes": 10.0 ** rng.uniform(-300, 300, 3000), "signs": rng.choice([-1, 1], 3000) * 10.0 ** rng.uniform(-300, 300, 3000),
         "zeros": np.concatenate([np.zeros(1500), 10.0 ** rng.uniform(-320, 3, 1499), [-1e308]]), "usual": rng.normal(50, 9, 3000)}[kind]
    stored = []
    real = DI.computed_once
    monkeypatch.setattr(DI, "computed_once", lambda d: stored.append(1) or real(d))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = DI.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.9, 1.0], names=list("abcde")).first()
    s = np.sort(x)
    for p, n in zip((0.0, 0.1, 0.5, 0.9, 1.0), "abcde"):
        at = p * (len(s) - 1)
        a, b = s[int(np.floor(at))], s[int(np.ceil(at))]
        want = a if at == np.floor(at) else a + (b - a) * (at - np.floor(at))
        assert np.isclose(got[n], want, rtol=1e-12, atol=0)
    assert len(stored) - 2 <= 9
