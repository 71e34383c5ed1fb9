"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of regions and racks. A document descends region, rack,
shard; at each level every child draws -ln(u) / weight, with u from the MD5 of
the document's key, the level and the child's number (which any program can draw
again), and the least draw wins.
A child's draw depends on its own weight only, so a changed weight moves
documents only into or out of the subtrees whose weights change: growing by a
region of its own takes documents into the new shard and from nowhere to
anywhere else.

Scale: a document's shard needs its key alone (no shuffle, no state). Slots
are ranks within a shard, dealt over hash buckets, so 24 shards do not mean
24 tasks; the counts pass reads the id column only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.tables import bucket_rank, pick

#: A tree: regions of racks of (shard, weight).
Tree = list[list[list[tuple[int, float]]]]


def balanced_tree(shards: int, regions: int = 3, racks: int = 2) -> Tree:
    """Shards 0 .. shards - 1 of weight 1, dealt in order over regions * racks
    racks as evenly as can be; empty racks and regions are left out."""
    cuts = [round(i * shards / (regions * racks)) for i in range(regions * racks + 1)]
    flat = [[(s, 1.0) for s in range(a, b)] for a, b in zip(cuts, cuts[1:])]
    tree = [[rack for rack in flat[r * racks:(r + 1) * racks] if rack] for r in range(regions)]
    return [region for region in tree if region]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard (the next number), in a region of its own:
    no present subtree's weight changes, so documents move only into it."""
    new = 1 + max(s for region in tree for rack in region for s, _ in rack)
    return [*tree, [[(new, weight)]]]


def _draw(key: Column, level: int, child: Column, weight: Column) -> Column:
    """-ln(u) / weight, with u from 52 bits of the MD5 of "key:level:child"."""
    h = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(level)), child.cast("string")))
    return -F.log((F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))) / weight


def _least(key: Column, level: int, children: Column) -> Column:
    """The child struct (id, weight, ...) with the least draw; ties go to the
    smaller id."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, level, c["id"], c["weight"]).alias("d"),
                                                     c["id"].alias("id"), c["at"].alias("at")))
    return F.array_min(drawn)


def descend(key: Column, tree: Tree) -> Column:
    """The shard of ``key`` (a column whose values are hashed)."""
    def node(i, at, weight):
        return F.struct(F.lit(int(i)).alias("id"), F.lit(float(weight)).alias("weight"), F.lit(int(at)).alias("at"))

    total = lambda racks: sum(w for rack in racks for _, w in rack)
    regions, racks, shards = [], [], []
    for r, region in enumerate(tree):
        regions.append(node(r, len(racks) + 1, total(region)))
        mine = []
        for rack in region:
            n = sum(len(m) for m in racks) + len(mine)
            shards.append(F.array(*[node(s, s, w) for s, w in rack]))
            mine.append(node(n, n + 1, total([rack])))
        racks.append(mine)
    rack_lists = F.array(*[F.array(*m) for m in racks])
    region = _least(key, 1, F.array(*regions))
    rack = _least(key, 2, F.element_at(rack_lists, region["at"]))
    return _least(key, 3, F.element_at(F.array(*shards), rack["at"]))["id"]


def shard(docs: DataFrame, tree: Tree, buckets: int = 1024, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes of the text plus
    8; null text: 8), text_crc32, shard, slot (gapless from 0 within the
    shard), grown_shard (the shard with one more shard in the tree).

    The id alone decides the shard: rows with equal ids (null ids too) go to
    one shard; equal rows take any of their slots. Slots are the same at every
    run except among rows with equal id and text. Empty tables give empty
    results. Texts of any length are only measured and summed up by crc32. Other
    columns of ``docs`` are not read."""
    d = pick(docs, doc_id=id_col, text=text_col)
    placed = lambda x: x.withColumn("shard", descend(F.col("doc_id"), tree)).withColumn(
        "bucket", (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":slot"))), 1, 6),
                         16, 10).cast("int") % buckets).cast("int"))
    rows = placed(d).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)
    rows = rows.withColumn("text_crc32", F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))))
    rows = rows.withColumn("grown_shard", descend(F.col("doc_id"), grown(tree)))
    narrow = rows.select("doc_id", "size", "text_crc32", "shard", "bucket", "grown_shard")
    out = bucket_rank(narrow, ["shard"], "bucket",
                      [F.col("doc_id").asc_nulls_first(), "text_crc32", "size"],
                      counts_from=placed(pick(docs, doc_id=id_col)))
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as files, one folder ``shard=N`` per shard, spread
    over as many tasks as the session's shuffle partitions."""
    placed = docs.withColumn("shard", descend(F.col(f"`{id_col}`"), tree))
    placed.repartition(F.col("shard"), F.pmod(F.xxhash64(f"`{id_col}`", F.lit("file")), F.lit(16))) \
        .write.partitionBy("shard").parquet(path)
