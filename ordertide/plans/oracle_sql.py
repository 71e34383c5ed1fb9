"""DuckDB twins of the registered queries, written as plain SQL over the
pre-registered base tables. ``SALES`` is the fact view; every query text is
``WITH sales AS (...) SELECT ...``."""

from __future__ import annotations

SALES = """
select o_orderkey as order_id, o_orderdate as order_date, l_shipdate as ship_date,
       c_custkey as customer_id, c_name as customer_name, c_mktsegment as segment,
       r_name as region, n_name as state, p_type as category, p_brand as sub_category,
       p_name as product_name,
       cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) as sales,
       l_quantity as quantity, l_discount as discount,
       cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))
         - cast(l_quantity as decimal(6,0)) * cast(p_retailprice as decimal(12,2)) as decimal(18,4)) as profit,
       p_partkey as product_id, o_orderpriority as ship_mode, cast(c_nationkey as double) as postal_code,
       l_linenumber as line_number, l_suppkey as supplier_id, l_extendedprice as extended_price,
       date_trunc('month', o_orderdate) as order_month
from lineitem
join orders   on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
join nation   on c_nationkey = n_nationkey
join region   on n_regionkey = r_regionkey
join part     on l_partkey = p_partkey
"""

KEY = "order_id, line_number, product_id, supplier_id, extended_price"


def with_sales(body: str, extra_ctes: str = "") -> str:
    ctes = f"sales AS ({SALES})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"
