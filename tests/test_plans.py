"""Physical-plan properties the scale design relies on."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ordertide.operators import dist as DI
from ordertide.operators import filters as FL
from ordertide.operators import groups as G
from ordertide.operators.ranking import global_rank
from ordertide.plans import catalog
from ordertide.sources.sales import ROW_KEY, sales_view


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_flagship_filters_reach_the_scans(spark):
    s = FL.filter_in_dims(FL.filter_date_range(sales_view(spark, SF_SMALL), *catalog.RANGE),
                          regions=catalog.REGIONS)
    text = _formatted(G.sales_by(s, "order_month"))
    assert "GreaterThanOrEqual(o_orderdate,1997-03-15T00:00)" in text
    assert "In(r_name, [ASIA,EUROPE])" in text
    # names and unused measures are never read for a monthly sum
    assert "c_name" not in text and "p_name" not in text and "l_tax" not in text


def _only_stats_go_single(plan: str) -> bool:
    """Every single-partition exchange sits directly on the per-partition
    statistics aggregate (at most one row per range partition)."""
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            if "keys=[_pid" not in lines[i + 1]:
                return False
    return True


def test_global_rank_rows_never_go_to_one_partition(spark):
    df = spark.range(20000).select("id", (F.col("id") % 97).alias("v"))
    plan = _plan(global_rank(df, ["v", "id"], sum_cols=["v"]))
    assert _only_stats_go_single(plan)


def test_top_n_is_per_partition_top_k(spark):
    plan = _plan(G.top_n_states(sales_view(spark, SF_SMALL)))
    assert "TakeOrderedAndProject" in plan


def test_kde_has_no_cross_product(spark):
    plan = _plan(DI.kde(sales_view(spark, SF_SMALL), "sales", 500))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_quantiles_never_gather_a_group(spark):
    plan = _plan(DI.exact_quantiles(sales_view(spark, SF_SMALL).withColumn("sales", F.col("sales").cast("double")),
                                    "sales", [0.5], ["category"]))
    assert "percentile" not in plan.lower() and _only_stats_go_single(plan)


def _ancestors(plan: str, table: str) -> list[str]:
    """Node names above the scan of ``table`` in a formatted plan tree."""
    import re
    lines = plan.split("\n")
    ids = [m.group(1) for i, l in enumerate(lines) if (m := re.match(r"\((\d+)\) Scan parquet", l))
           and any(f"{table}.parquet" in x for x in lines[i:i + 6])]
    assert ids, table
    tree = lines[1:lines.index("")]

    def indent(line):
        m = re.search(r"[A-Za-z]", line)
        return m.start() if m else 10 ** 6

    pos = next(i for i, l in enumerate(tree) if re.search(rf"Scan parquet\s+\({ids[0]}\)", l))
    level, out = indent(tree[pos]), []
    for line in reversed(tree[:pos]):
        if indent(line) < level:
            out.append(line.strip(" :+-"))
            level = indent(line)
    return out


def test_fact_is_streamed_not_broadcast(spark):
    """With realistic size estimates the fact scan is never under a
    BroadcastExchange (it is the streamed side of every join)."""
    plan = _formatted(sales_view(spark, "/root/testdata/sf0.1"))
    anc = _ancestors(plan, "lineitem")
    assert anc and not any(a.startswith("BroadcastExchange") for a in anc), anc


def test_quantiles_do_not_sort_rows(spark):
    """No range exchange anywhere: quantiles and the stratified split select."""
    from ordertide.operators import supervised as SU
    lab, _ = SU.high_value_labels(sales_view(spark, SF_SMALL), ROW_KEY)
    plan = _plan(SU.split_stratified(lab.select(*ROW_KEY, "label"), "label", 0.25, ROW_KEY))
    assert "rangepartitioning" not in plan


def test_filtered_ytd_prunes_dates(spark):
    from ordertide.operators import kpis as K
    s = sales_view(spark, SF_SMALL)
    text = _formatted(K.ytd_metrics_anchored(s, FL.time_predicate(s, year=1999, quarter="Q2")))
    assert "o_orderdate" in text.split("PushedFilters", 1)[1] and "GreaterThanOrEqual(o_orderdate" in text


def test_pages_are_top_k(spark):
    from ordertide.operators.table import raw_data
    s = sales_view(spark, SF_SMALL).select(*ROW_KEY, "sales")
    plan = _plan(raw_data(s, key=ROW_KEY, page_size=10, after=(500, 1, 1, 1, 1.0)))
    assert "TakeOrderedAndProject" in plan and "GlobalLimit" not in plan
