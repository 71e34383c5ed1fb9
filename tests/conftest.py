import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ordertide.session import local_session
    s = local_session(4, shuffle_partitions=4, app_name="ordertide-tests",
                      checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield s


SALES_DDL = ("order_id long, order_date timestamp_ntz, ship_date timestamp_ntz, customer_id long, "
             "customer_name string, segment string, region string, state string, category string, "
             "sub_category string, product_name string, sales decimal(18,4), quantity double, discount double, "
             "profit decimal(18,4), product_id long, ship_mode string, postal_code double, line_number int, "
             "supplier_id long, extended_price double")

DEFAULTS = dict(order_id=1, order_date=dt.datetime(2020, 1, 1), ship_date=dt.datetime(2020, 1, 3),
                customer_id=1, customer_name="C1", segment="S1", region="R1", state="ST1", category="K1",
                sub_category="SK1", product_name="P1", sales=Decimal("10"), quantity=1.0, discount=0.0,
                profit=Decimal("1"), product_id=1, ship_mode="M1", postal_code=1.0, line_number=1,
                supplier_id=1, extended_price=10.0)


def make_sales(spark, rows):
    """Sales-fact fixture: each row dict overrides the defaults."""
    from pyspark.sql import functions as F
    from ordertide.functions.dates import order_month
    cols = [c.split()[0] for c in SALES_DDL.split(", ")]
    data = []
    for i, r in enumerate(rows):
        d = dict(DEFAULTS, line_number=i + 1)
        d.update(r)
        for k in ("sales", "profit"):
            if d[k] is not None and not isinstance(d[k], Decimal):
                d[k] = Decimal(str(d[k]))
        data.append(tuple(d[c] for c in cols))
    df = spark.createDataFrame(data, SALES_DDL)
    return df.withColumn("order_month", order_month(F.col("order_date")))
