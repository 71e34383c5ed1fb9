"""Connected components of an edge table by alternating star contractions
(large-star / small-star, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.tables import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (columns a, b; same type, not
    null): root is the smallest vertex that it reaches, itself included for the
    roots. Loops and repeated or reversed edges are harmless; an empty table
    gives an empty result.

    Every round stores its tables on shared storage, so lineage stays short.
    Minimums are pre-aggregated before they shuffle, and a hub's edges meet its
    single row in a join whose large side can be split. The rounds grow with
    the logarithm of the longest path, and the driver sees a count and a hash."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
               .distinct(), "cc-edges")
    before = _state(e)
    while before[0]:
        least = stored(e.groupBy("hi").agg(F.min("lo").alias("m")), "cc-least").withColumnRenamed("hi", "of")
        # large star: the larger neighbours of u go to u's smallest neighbour
        e = stored(e.join(least, F.col("lo") == F.col("of"), "left")
                   .select("hi", F.coalesce("m", "lo").alias("lo")).distinct(), "cc-large")
        # small star: u and its smaller neighbours go to the smallest of them
        least = stored(e.groupBy("hi").agg(F.min("lo").alias("m")), "cc-least").withColumnRenamed("hi", "of")
        others = (e.join(least, F.col("hi") == F.col("of")).where("lo <> m")
                  .select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        e = stored(others.unionByName(least.select(F.col("of").alias("hi"), F.col("m").alias("lo"))).distinct(),
                   "cc-small")
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("lo").alias("v")).distinct()
    return e.select(F.col("hi").alias("v"), F.col("lo").alias("root")).unionByName(roots.withColumn("root", F.col("v")))
