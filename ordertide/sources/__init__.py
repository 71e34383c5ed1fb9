from ordertide.sources.sales import (ROW_KEY, SALES_COLUMNS, materialize_sales_view,  # noqa: F401
                                     sales_view, sales_view_from_tables)
from ordertide.sources.tables import SCHEMAS, read_star, read_table  # noqa: F401
