"""Reading corpus tables, storing intermediate tables on shared storage, and
ranks / prefix sums that split hot groups into buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordertide.session import ensure_checkpoint_dir

#: Fixed by the operators' contracts: ASCII white space, the complement of a word.
WHITE = "[\\x20\\x09-\\x0D]+"
#: The same six characters, for translate().
WHITE_CHARS = " \t\n\x0b\x0c\r"


def read_corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One corpus table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Select and rename the needed columns only, so that further columns of
    the input (whatever their names) can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: lineage is cut, executors may be lost afterwards, and later reads
    are pruned to the columns they need."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words (runs of other characters than ASCII white space)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def bucket_rank(df: DataFrame, groups: list[str], bucket: str, order: list, value: str | None = None,
                counts_from: DataFrame | None = None, per_group: DataFrame | None = None) -> DataFrame:
    """Add ``rank`` (from 0) and, with ``value``, ``before`` (the sum of
    ``value`` over the rows in front) to each row of its group.

    ``groups`` must not be null and ``bucket`` must rise with ``order`` (or
    order only within it): a group of any size is dealt over its buckets. The
    counts of a (group, bucket) are pre-aggregated before their shuffle, their
    prefix sums are a small table, and rows are sorted within one bucket only.
    ``counts_from``: cheaper rows with the same groups and buckets.
    ``per_group``: one row per group (the ``groups`` and further columns, which
    the result gets); it joins the small table, so a hot group's rows meet it
    bucket by bucket."""
    aggs = [F.count(F.lit(1)).alias("__n")] + ([F.sum(value).alias("__v")] if value else [])
    base = (counts_from if counts_from is not None else df).groupBy(*groups, bucket).agg(*aggs)
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*groups, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rank0"),
                       *([F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__sum0")] if value else []))
    if per_group is not None:
        base = base.join(per_group, groups)
    inside = Window.partitionBy(*groups, bucket).orderBy(*order)
    df = df.withColumn("__i", F.row_number().over(inside) - 1)
    if value:
        run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("__s", F.sum(value).over(run) - F.col(value))
    out = df.join(base, [*groups, bucket])
    out = out.withColumn("rank", F.col("__rank0") + F.col("__i"))
    if value:
        out = out.withColumn("before", F.col("__sum0") + F.col("__s"))
    return out.drop("__i", "__s", "__rank0", "__sum0")
