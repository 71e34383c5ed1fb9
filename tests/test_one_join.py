"""Queries that label rows by a quantile run the star join once."""

import pytest

from ordertide.plans import catalog
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", ["label_high_value", "class_counts", "positive_rate", "split_stratified", "roc_auc_formula"])
def test_labels_read_the_join_once(spark, monkeypatch, name):
    catalog.clear_fits()
    scans, plain = [], catalog.computed_once

    def spied(df):
        scans.append("lineitem" in df._jdf.queryExecution().optimizedPlan().toString() or "l_orderkey" in df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df)

    monkeypatch.setattr(catalog, "computed_once", spied)
    out = catalog.REGISTRY[name].fn(spark, SF_SMALL)
    assert sum(scans) == 1 and "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()
    catalog.clear_fits()
