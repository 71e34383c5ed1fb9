"""Every registered query against its DuckDB twin at sf0.001 (exact match
after sorting rows), and every rows-only query returns rows."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from tools.check_oracle import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dk = con.execute(SQL[name]).df()
    status, detail = compare(sp, dk)
    assert status == "EXACT", f"{name}: {status} {detail}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 1


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["order_month", "sales", "month_index", "trend"]
