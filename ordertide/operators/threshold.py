"""Top-k sums by key without shuffling every key (threshold algorithm).

Three phases over the tasks' local sums, for values that are not negative:
1. every task gives its k largest local sums; the k-th largest of their totals
   is a lower bound of the k-th largest sum;
2. every task gives the keys whose local sum reaches that bound's share of a
   task: a key that no task gives can't reach the bound;
3. the keys that still can are summed exactly.

Only k rows a task, the keys over a share, and the candidates' rows travel,
however many keys there are. Negative values break the bounds; where there are
any, the plain aggregation answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.operators.groups import sales_by, top_n
from ordertide.operators.joins import computed_once, join_small

#: Decimal digits that sums keep: local sums are whole numbers of 10^-DIGITS.
DIGITS = 4


def _local_sums(most: int | None, least: int):
    """mapInArrow body: this task's local sums by key, the ``most`` largest or
    all of at least ``least``; and a row without a key: the task's least value."""
    def run(batches: Iterator[pa.RecordBatch]):
        sums, low = None, None
        for b in batches:
            t = pa.table({"key": b.column(0), "v": b.column(1)})
            if not len(t):
                continue
            low = min(x for x in (low, pc.min(t["v"]).as_py()) if x is not None)
            part = t.group_by("key").aggregate([("v", "sum")]).rename_columns(["key", "v"])
            sums = part if sums is None else pa.concat_tables([sums, part]).group_by("key").aggregate([("v", "sum")]).rename_columns(["key", "v"])
        if sums is None:
            return
        if most is not None:
            sums = sums.take(pc.select_k_unstable(sums, most, [("v", "descending")])) if len(sums) > most else sums
        else:
            sums = sums.filter(pc.greater_equal(sums["v"], least))
        key = pa.chunked_array([*sums["key"].chunks, pa.array([None], sums["key"].type)], sums["key"].type)
        v = pa.chunked_array([*sums["v"].cast(pa.int64()).chunks, pa.array([low], pa.int64())], pa.int64())
        yield from pa.table({"key": key, "v": v}).combine_chunks().to_batches()
    return run


def _gather(rows: DataFrame, body) -> tuple[DataFrame, int, int | None]:
    """Totals by key of the local sums, the number of tasks, the least value."""
    kind = rows.schema["key"].dataType.simpleString()
    local = computed_once(rows.mapInArrow(body, f"key {kind}, v long"))
    tasks = local.where("key is null").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low")).first()
    return computed_once(local.where("key is not null").groupBy("key").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("seen"))), tasks["n"], tasks["low"]


def _kth(totals: DataFrame, k: int) -> int:
    top = totals.orderBy(F.desc("v")).limit(k).collect()
    return top[-1]["v"] if len(top) == k else 0


def top_n_threshold(df: DataFrame, key: str, n: int = 10, value: str = "sales") -> DataFrame:
    """``top_n``: the n largest sums of ``value`` by non-NULL ``key``, equal
    sums by key. NULL values count as 0."""
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.coalesce((F.col(value) * 10 ** DIGITS).cast("long"), F.lit(0).cast("long")).alias("v"))
    first, tasks, low = _gather(rows, _local_sums(n, 0))
    if not tasks or low < 0:
        return top_n(df, key, n, value)
    share = -(-_kth(first, n) // tasks)
    second, tasks, _ = _gather(rows, _local_sums(None, share))
    bound = _kth(second, n)
    if tasks * (share - 1) >= bound > 0:  # more tasks than before: a key that none gave might reach it
        return top_n(df, key, n, value)
    could = second.where(F.col("v") + (F.lit(tasks) - F.col("seen")) * F.lit(max(share - 1, 0)) >= F.lit(bound))
    wanted = computed_once(could.select(F.col("key").alias("__key")))
    exact = sales_by(join_small(df, wanted, F.col(key) == F.col("__key"), "left_semi"), key, value)
    return exact.orderBy(F.desc(value), F.asc(key)).limit(n)
