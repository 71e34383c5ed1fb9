"""All sums of a dashboard page from one scan.

The filtered fact is aggregated once over the grouping sets of every panel; the
result, some hundred rows per set, is written, and each panel is a filter on its
grouping set. Parents and roots of the hierarchies are sums of their leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.operators.groups import HIERARCHIES
from ordertide.operators.joins import computed_once

KEYS = ("order_month", "region", "category", "sub_category", "state", "segment")


class Panels:
    """One scan's sums: ``totals``, ``by(key)`` and ``hierarchy(name)``."""

    def __init__(self, df: DataFrame):
        sets = [(), ("order_month",), ("region",), ("category",), *dict.fromkeys(HIERARCHIES.values())]
        grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *KEYS)
        self.sums = computed_once(grouped.agg(
            F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("row_count"),
            F.grouping_id().alias("grouping")))

    def _of(self, *keys: str) -> DataFrame:
        """The rows of one grouping set: grouping_id has a bit for each key that is not in it."""
        bits = sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)
        rows = self.sums.where(F.col("grouping") == bits)
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        return rows

    def totals(self) -> DataFrame:
        """One row: total_sales, total_profit, row_count (0 for no rows)."""
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return self._of().agg(zero("sales").cast("double").alias("total_sales"), zero("profit").cast("double").alias("total_profit"),
                              zero("row_count").alias("row_count"))

    def by(self, key: str) -> DataFrame:
        """Sum of sales per non-NULL value of order_month, region or category."""
        return self._of(key).select(key, F.coalesce("sales", F.lit(0)).cast("double").alias("sales"))

    def hierarchy(self, name: str) -> DataFrame:
        """parent, child, level, sales, as ``sales_hierarchy`` gives them."""
        parent, child = HIERARCHIES[name]
        leaves = self._of(parent, child).select(F.col(parent).alias("parent"), F.col(child).alias("child"), F.col("sales").alias("s"))
        return (leaves.rollup("parent", "child").agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("sales"), F.grouping_id().alias("level"))
                .select("parent", "child", "level", "sales"))
