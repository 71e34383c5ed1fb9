import numpy as np
import pytest

from ordertide.operators import threshold as TH
from ordertide.operators.groups import top_n
from tests.conftest import make_sales


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("parts", [1, 5])
def test_threshold_is_top_n(spark, monkeypatch, parts):
    """The same rows in the same order, ties and NULLs too, from far fewer shuffled rows than keys."""
    rng = np.random.default_rng(3)
    heavy = [dict(product_name=f"H{i % 12}", sales=str(1000 + i % 7)) for i in range(240)]
    light = [dict(product_name=f"L{i}", sales=str(int(rng.integers(0, 5)))) for i in range(600)]
    df = make_sales(spark, [*heavy, *light, dict(product_name=None, sales="99999"), dict(product_name="H3", sales=None)]).repartition(parts, "line_number")
    shuffled = []
    real = TH._gather
    monkeypatch.setattr(TH, "_gather", lambda *a: (lambda r: shuffled.append(r[0].count()) or r)(real(*a)))
    assert rows_of(TH.top_n_threshold(df, "product_name", 5)) == rows_of(top_n(df, "product_name", 5))
    assert sum(shuffled) < 100
    assert rows_of(TH.top_n_threshold(df, "product_name", 2000)) == rows_of(top_n(df, "product_name", 2000))


def test_threshold_edges(spark):
    df = make_sales(spark, [dict(product_name="A", sales="5"), dict(product_name="A", sales="-9"), dict(product_name="B", sales="-1")])
    assert rows_of(TH.top_n_threshold(df, "product_name", 1)) == [("B", -1.0)]
    assert rows_of(TH.top_n_threshold(df.limit(0), "product_name", 1)) == []
    zero = make_sales(spark, [dict(product_name=x, sales="0") for x in "CAB"])
    assert rows_of(TH.top_n_threshold(zero, "product_name", 2)) == [("A", 0.0), ("B", 0.0)]
