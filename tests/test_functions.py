"""Column functions, sinks, paging and small guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import make_sales
from ordertide.functions import dates as D
from ordertide.functions import fmt
from ordertide.functions.numeric import finite_or_null, finite_or_zero, to_numeric_coerce
from ordertide.operators import filters as FL
from ordertide.operators import groups as G
from ordertide.operators import series as SE
from ordertide.operators.table import raw_data
from ordertide.sources.sinks import write_model_result, write_result


def test_formats(spark):
    df = spark.createDataFrame([(1234.5, -0.1234, None, 7.9)], "a double, p double, n double, i double")
    r = df.select(fmt.currency0(F.col("a")).alias("c0"), fmt.currency2(F.col("n")).alias("c2n"),
                  fmt.currency2(F.col("a")).alias("c2"), fmt.safe_int(F.col("i")).alias("si"),
                  fmt.safe_int(F.col("n")).alias("sin"), fmt.safe_pct(F.col("p")).alias("sp"),
                  fmt.safe_pct(F.lit(float("inf"))).alias("spi"), fmt.pct1_or_dash(F.col("p")).alias("p1"),
                  fmt.pct1_or_dash(F.col("n")).alias("p1n"), fmt.int_cast(F.col("n")).alias("ic")).first()
    assert (r.c0, r.c2n, r.c2, r.si, r.sin) == ("$1,234", "$0.00", "$1,234.50", "7", "0")
    assert (r.sp, r.spi, r.p1, r.p1n, r.ic) == ("-12.34%", "0.00%", "-12.3%", "—", 0)


def test_numeric_guards(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "s string")
    vals = [r[0] for r in df.select(to_numeric_coerce(F.col("s"))).collect()]
    assert vals == [1.5, None, None]
    d = spark.createDataFrame([(float("nan"),), (float("-inf"),), (2.0,)], "x double")
    assert [r[0] for r in d.select(finite_or_null(F.col("x"))).collect()] == [None, None, 2.0]
    assert [r[0] for r in d.select(finite_or_zero(F.col("x"))).collect()] == [0.0, 0.0, 2.0]


def test_date_parts(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 29, 15, 30),), (None,)], "t timestamp_ntz")
    c = F.col("t")
    r = df.select(D.order_month(c).alias("m"), D.quarter_label(c).alias("q"), D.month_abbr(c).alias("b"),
                  D.year_month(c).alias("ym"), D.day_ordinal(c).alias("o"), D.date_text(c).alias("d"),
                  D.year_month_start(D.year_month(c)).alias("back")).collect()
    assert r[0].m == dt.datetime(2020, 2, 1) and r[0].q == "Q1" and r[0].b == "Feb" and r[0].ym == "2020-02"
    assert r[0].o == dt.date(2020, 2, 29).toordinal() and r[0].d == "2020-02-29" and r[0].back == dt.datetime(2020, 2, 1)
    assert r[1].q is None and r[1].ym is None  # NULL date -> NULL parts
    lo, hi = D.ts_literal(dt.datetime(2020, 3, 1)), D.ts_literal(dt.datetime(2020, 3, 10))
    cl = df.select(D.clamp_date(c, lo, hi).alias("x")).first().x
    assert cl == dt.datetime(2020, 3, 1)


def test_resolve_preset_and_options(spark):
    lo, hi = dt.datetime(2019, 1, 5, 10), dt.datetime(2020, 5, 31, 16)
    assert FL.resolve_preset("last_week", lo, hi) == (dt.date(2020, 5, 25), dt.date(2020, 5, 31))
    assert FL.resolve_preset("last_month", lo, hi) == (dt.date(2020, 5, 2), dt.date(2020, 5, 31))
    assert FL.resolve_preset("last_quarter", lo, hi) == (dt.date(2020, 2, 29), dt.date(2020, 5, 31))
    assert FL.resolve_preset("last_3_years", lo, hi) == (dt.date(2019, 1, 5), dt.date(2020, 5, 31))
    assert FL.resolve_preset("custom", lo, hi, ("a", "b")) == ("a", "b")
    assert FL.resolve_preset("bogus", lo, hi) is None
    df = make_sales(spark, [dict(order_date=dt.datetime(2020, m, 1), category=None if m == 2 else "K")
                            for m in (1, 2, 5, 11)])
    assert [r.quarter for r in FL.quarter_options(df, 2020).collect()] == ["Q1", "Q2", "Q4"]
    assert [(r.month_num, r.month) for r in FL.month_options(df, 2020, "Q1").collect()] == [(1, "Jan"), (2, "Feb")]
    assert FL.first_usable_group(df) == "category"
    assert FL.first_usable_group(df.withColumn("category", F.lit(None).cast("string"))) == "region"
    assert FL.row_guard(3, 4, "groups") == "Need at least 4 groups (found 3)."


def test_trend_needs_two_points(spark):
    one = make_sales(spark, [dict()])
    r = SE.trend_by_index(G.sales_by(one, "order_month")).first()
    assert r.trend is None


def test_raw_data_paging_and_user_sort(spark):
    """Pages follow each other without gap or overlap, NULLs and ties included."""
    rows = [dict(sales=None if i % 40 == 0 else i // 3, order_id=i, region=None if i % 7 == 0 else f"R{i % 5}") for i in range(250)]
    df = make_sales(spark, rows).select("order_id", "order_date", "region", F.col("sales").cast("double").alias("sales"))
    for sort in ([("sales", False)], [("sales", True)], [("region", True), ("sales", False)], []):
        order = dict(sort=sort, key=["order_id"], page_size=60)
        seen, after = [], None
        while page := raw_data(df, **order, after=after, display=False).collect():
            seen += [r.order_id for r in page]
            after = tuple(page[-1][c] for c in [*[c for c, _ in sort], "order_id"])
        whole = raw_data(df, **dict(order, page_size=1000)).collect()
        assert seen == [r.order_id for r in whole] and len(seen) == 250
    assert whole[0].order_date == "2020-01-01"
    with pytest.raises(ValueError):
        raw_data(df, sort=[("sales", False)])


def test_sinks_roundtrip(spark, tmp_path):
    df = make_sales(spark, [dict(), dict(order_id=2)])
    write_result(G.sales_by_region(df), str(tmp_path / "regions"))
    assert spark.read.parquet(str(tmp_path / "regions")).count() == 1
    write_model_result({"metrics": df.select("order_id"), "note": "skipped"}, str(tmp_path / "model"), fmt="json")
    assert spark.read.json(str(tmp_path / "model" / "metrics")).count() == 2


def test_dropna_subset(spark):
    df = make_sales(spark, [dict(region=None), dict()])
    assert FL.dropna_subset(df, ["region"]).count() == 1


def test_calendar_parts_ignore_session_time_zone(spark):
    """Month starts and lenient parses must not move with the session zone
    (Sao Paulo switched DST at midnight: 1999-10-03 00:00 did not exist)."""
    from ordertide.sources.files import parse_date
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        df = spark.createDataFrame([(dt.datetime(1999, 10, 3, 0, 0), "1999-10-03 00:00:00")],
                                   "t timestamp_ntz, s string")
        r = df.select(D.order_month(F.col("t")).alias("m"), D.day_ordinal(F.col("t")).alias("o"),
                      parse_date(F.col("s"), "lenient").alias("p"),
                      D.year_month_start(F.lit("1999-10")).alias("ym")).first()
        assert r.m == dt.datetime(1999, 10, 1) and r.p == dt.datetime(1999, 10, 3)
        assert r.ym == dt.datetime(1999, 10, 1) and r.o == dt.date(1999, 10, 3).toordinal()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
