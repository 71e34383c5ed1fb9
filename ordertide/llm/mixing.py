"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / weight (u from a hash of its
id and a seed; weight: its quality). Within a source, documents in ascending
key order are a weighted random permutation without replacement. A source's
target is some complete epochs over it (every document once per epoch) plus a
remainder; the remainder goes to the documents in front whose prefix sum of
sizes meets it (the one at the edge if that comes nearer to the target).

Scale: the text is read once into a narrow table (id, source, size, key).
Prefix sums go over buckets of ln(key), a few thousand per source, so one
source with a third of all rows is sorted in as many tasks as its buckets.
The table of sources holds one row per source; its targets are computed by
window sums over that table alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.llm.tables import bucket_rank, stored, words

#: Characters whose share lowers a document's default weight.
SYMBOLS = "#*$%&|<>"


def symbol_weight(text: str = "text") -> Column:
    """Quality weight from 0.05 to 1: one less four times the share of symbol
    characters; null and empty texts weigh 1."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    symbols = F.when(t.rlike(f"[{SYMBOLS}]"), n - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0)
    share = symbols / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * share)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of key and seed."""
    h = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def row_hash(id_col: str, text_col: str, source_col: str) -> Column:
    """64 bits of id, text and source, nulls apart from empty values."""
    c = [F.col(f"`{n}`").cast("string") for n in (id_col, text_col, source_col)]
    return F.xxhash64(*c, *[x.isNull() for x in c])


def source_targets(sizes: DataFrame, weights: tuple, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to one row per source (src_null, src, source_size).

    Weights repeat over the sources in code point order, null last. Shares of
    ``budget`` times all sizes that exceed ``max_epochs`` times their source
    stop there, and the excess is reshared by weight: the fixed point is
    target = min(cap, weight * level), found by ordering on cap / weight."""
    by_name = Window.orderBy("src_null", "src")
    every = Window.partitionBy()
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("all_words", F.sum("source_size").over(every) * F.lit(float(budget)))
    up = Window.orderBy(F.col("cap") / F.col("w"), "src_null", "src")
    s = s.withColumn("level", (F.col("all_words") - F.coalesce(
        F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    left = F.col("all_words") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0.0)).over(every)
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap"))
                     .otherwise(F.least(F.col("cap"), F.col("w") * (left / free))))
    return s.select("src_null", "src", "source_size", "target")


def mix(docs: DataFrame, weight: Column | None = None, source_weights: tuple = (5, 2, 1), budget: float = 1.5,
        max_epochs: float = 2.0, seed: int = 42, buckets_per_e: int = 256, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size,
    target (of its source), copies (times the mix takes it), taken (copies *
    size), row_hash (of id, source and text, for ``take``). ``weight``: a column expression over ``docs``, above zero (default:
    ``symbol_weight``); null or not positive counts as 0.05.

    Null texts have size 0; texts of any length are counted whole. Null
    sources are one source, ordered last. Rows with equal ids draw equal keys
    and are ordered by size and row_hash; rows equal in id, source and text
    are exchangeable. Empty tables give empty results. Other columns of
    ``docs`` are not read."""
    w = (symbol_weight(text_col) if weight is None else weight).cast("double")
    w = F.when(w > 0, w).otherwise(F.lit(0.05))
    src = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), src.isNull().cast("int").alias("src_null"),
                       F.coalesce(src, F.lit("")).alias("src"),
                       F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("size"),
                       row_hash(id_col, text_col, source_col).alias("row_hash"),
                       (-F.log(uniform(F.col(f"`{id_col}`"), seed)) / w).alias("key"))
    rows = rows.withColumn("bucket", F.floor(F.log("key") * buckets_per_e))
    rows = stored(rows, "mix-rows")
    sizes = rows.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, source_weights, budget, max_epochs)
    out = bucket_rank(rows, ["src_null", "src"], "bucket", ["key", F.col("doc_id").asc_nulls_first(), "size", "row_hash"],
                      value="size", per_group=targets)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = out.withColumn("epochs", whole.cast("long"))
    out = out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    end = F.col("before") + F.col("size")
    chosen = (F.col("before") < F.col("rest")) & (end - F.col("rest") <= F.col("rest") - F.col("before"))
    out = out.withColumn("copies", F.col("epochs") + chosen.cast("long"))
    return out.select("doc_id", F.when(F.col("src_null") == 0, F.col("src")).alias("source"), "size", "source_size",
                      "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_hash")


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mixed`` (a ``mix`` of
    the same columns) says.

    Rows are matched by id (null matches null) and row_hash. Rows equal in id,
    source and text share what any of them drew as evenly as whole copies
    allow; what is left over goes to the first by a hash of all columns. So a
    source's taken words are those of ``mixed``, whatever repeats. Empty tables
    give empty results."""
    drawn = mixed.groupBy(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")).agg(
        F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows")).where("total > 0")
    drawn = drawn.withColumn("even", F.floor(F.col("total") / F.col("rows")).cast("long"))
    drawn = stored(drawn.withColumn("more", F.col("total") - F.col("even") * F.col("rows")), "mix-drawn")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # names of ``docs`` can't clash within
    d = docs.select(F.col(f"`{id_col}`").alias("own_id"), row_hash(id_col, text_col, source_col).alias("own_hash"), row)
    d = d.join(drawn, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))
    even = d.where("even > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("even")))).select("row")
    if drawn.where("more > 0").isEmpty():  # no row repeats, or all that do were drawn alike
        return even.select("row.*")
    # equal rows that share an uneven draw are counted first, so a hot group is few rows
    alike = d.where("more > 0").groupBy("own_id", "own_hash", "more", "row").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("own_id", "own_hash").orderBy(F.xxhash64("row"), "row")
    first = F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = alike.withColumn("n", F.least(F.col("n"), F.col("more") - first)).where("n > 0")
    more = more.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row")
    return even.unionByName(more).select("row.*")
