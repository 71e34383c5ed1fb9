"""Small tables that several plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.session import reliable_checkpoint

#: Largest table that gets a broadcast hint, in bytes of its values.
BROADCAST_MAX_BYTES = 16 << 20


def computed_once(small: DataFrame) -> DataFrame:
    """An aggregate or narrow table that later plans read more than once,
    computed now and kept on the shared checkpoint folder: nothing stays in
    executors' memory, and lost executors cost no second pass over the data.
    Its files go with the DataFrame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    return reliable_checkpoint(small)


def broadcast_if_small(stored: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``stored`` (of ``computed_once``) with a broadcast hint if its values,
    counted, take at most ``max_bytes``; else as it is, and the planner and AQE
    choose a shuffle join and split skewed keys."""
    texts = [c for c, t in stored.dtypes if t in ("string", "binary")]
    size = F.count(F.lit(1)) * (8 * len(stored.columns))
    for c in texts:
        size = size + F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0))
    return F.broadcast(stored) if stored.agg(size.alias("bytes")).first()["bytes"] <= max_bytes else stored


def join_small(big: DataFrame, stored: DataFrame, on, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join a stored per-group table onto row-level data, broadcast behind the
    size check."""
    return big.join(broadcast_if_small(stored, max_bytes), on, how)


def may_outgrow(side: DataFrame, table: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether the values of ``side``, which has at most ``table``'s rows, may
    take over ``max_bytes``: 8 bytes a value, 32 a text. Spark's own check is of
    the files' bytes, which compression makes many times smaller than the rows
    that a broadcast gathers on the driver. The count reads the files' footers."""
    width = sum(32 if t in ("string", "binary") else 8 for _, t in side.dtypes)
    return table.count() * width > max_bytes


def join_sized(many: DataFrame, many_table: DataFrame, few: DataFrame, few_table: DataFrame, on,
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Inner join in which neither side reaches the driver unless its rows,
    counted, are small: ``few`` is merged if it may outgrow a broadcast, and
    broadcast if only ``many`` may, whose files can look smaller than ``few``'s
    estimate. Each side has at most its table's rows."""
    if may_outgrow(few, few_table, max_bytes):
        few = few.hint("merge")
    elif may_outgrow(many, many_table, max_bytes):
        few = F.broadcast(few)
    return many.join(few, on)
