"""Invariants on the test tables at sf0.001."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ordertide.operators import evalcurves as EC
from ordertide.operators import groups as G
from ordertide.operators import kpis as K
from ordertide.operators import supervised as SU
from ordertide.sources.sales import ROW_KEY, sales_view


@pytest.fixture(scope="module")
def sales(spark):
    return sales_view(spark, SF_SMALL).cache()


def test_row_key_unique(sales):
    assert sales.select(*ROW_KEY).distinct().count() == sales.count()


@pytest.mark.parametrize("parent,child", list(G.HIERARCHIES.values()))
def test_rollup_parents_are_sums(sales, parent, child):
    h = G.sales_hierarchy(sales, parent, child)
    leaves = h.where("level = 0").groupBy("parent").agg(F.sum("sales").alias("s"))
    parents = h.where("level = 1").select("parent", F.col("sales").alias("p"))
    bad = leaves.join(parents, "parent").where(F.abs(F.col("s") - F.col("p")) > 1e-6 * F.abs("p"))
    assert bad.count() == 0
    root = h.where("level = 3").first().sales
    assert abs(root - K.kpi_totals(sales).first().total_sales) < 1e-6 * root


def test_shares_sum_to_one(sales):
    assert abs(G.region_share(sales).agg(F.sum("share")).first()[0] - 1) < 1e-12
    assert abs(G.product_share(sales).agg(F.sum("share")).first()[0] - 1) < 1e-12


def test_fused_and_join_pivot_agree(sales):
    a = G.top_products_pivot(sales, method="fused").collect()
    b = G.top_products_pivot(sales, method="join").collect()
    assert a == b


def test_split_disjoint_covering(sales):
    s = SU.split_random(sales.select(*ROW_KEY), 0.2, ROW_KEY)
    assert s.count() == sales.count()
    frac = s.where("is_test").count() / s.count()
    assert 0.15 < frac < 0.25


def test_stratified_split_exact_counts(sales):
    lab, _ = SU.high_value_labels(sales, ROW_KEY)
    s = SU.split_stratified(lab.select(*ROW_KEY, "label"), "label", 0.25, ROW_KEY)
    for r in s.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(F.col("is_test").cast("int")).alias("t")).collect():
        assert r.t == -(-r.n // 4)


def test_confusion_total_is_test_rows(spark, sales):
    c = SU.fit_classifier(sales)
    p = c["predictions"]
    assert EC.confusion_matrix(p).agg(F.sum("count")).first()[0] == p.count()
