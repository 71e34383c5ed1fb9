"""SimHash near-duplicates through pivot distance tables.

A document's fingerprint has a bit set where over half of its shingles' hashes
have it. Equal fingerprints collapse to one class first, so a large group of
copies is one row from there on.

Pivot table: the Hamming distances of every class to fixed reference
fingerprints - zero, the masks of 32 blocks of two neighbouring bits, and some
pseudo-random ones. By the triangle inequality two fingerprints at distance at
most k differ by at most k in every coordinate. Distances to zero and to a
block's mask give the set bits within that block, and k flipped bits change
at most k blocks: dealt over g > k groups of blocks, at least g - k groups of
coordinates agree entirely. Classes therefore meet in joins on the coordinates
of g - k groups, one for each choice of groups; pairs whose largest coordinate
difference over the other pivots exceeds k are discarded, survivors are
verified bit by bit. No pair within k bits is missed.

g rises with the number of classes, so that a key's classes stay few; any g
gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.llm.components import connected_components
from ordertide.llm.tables import pick, stored

SEED = 42
CHUNK = 1 << 15
BLOCKS = [3 << (2 * i) for i in range(32)]
#: Bits of information in a block's number of set bits (0, 1, 1 or 2).
BLOCK_BITS = 1.5
RANDOM_PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(7)]


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Unsigned fingerprint of the words' shingles (A-Z lower-cased, words cut
    at ASCII white space); fewer words than a shingle: their whole sequence;
    no word: zero."""
    w = (text or b"").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):  # long texts in bounded memory
        part = w[at:min(n, at + CHUNK) + shingle - 1]
        h = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(min(shingle, len(w)))))]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids, texts, hashes = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text", "text_hash"))
            fp = np.array([fingerprint(t, shingle) for t in texts.cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])
    return run


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def block_groups(classes: int, max_bits: int, per_key: int = 64) -> int:
    """The least number of groups (over ``max_bits`` + 1) for which a key of
    all but ``max_bits`` groups expects at most ``per_key`` classes."""
    g = max_bits + 2
    while g < 12 and classes / 2 ** (BLOCK_BITS * len(BLOCKS) * (1 - max_bits / g)) > per_key:
        g += 1
    return g


def pivot_links(classes: DataFrame, max_bits: int, groups: int) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` of
    ``classes`` that differ in 1 to ``max_bits`` bits."""
    def distance(p: int) -> Column:
        return F.bit_count(F.col("fp").bitwiseXOR(_signed(p))).cast("byte")

    table = classes.select("fp", distance(0).alias("zero"), F.array(*[distance(p) for p in BLOCKS]).alias("blocks"),
                           *[distance(p).alias(f"p{i}") for i, p in enumerate(RANDOM_PIVOTS)])
    # set bits within a block, from its distance and the distance to zero
    inside = [((F.col("zero") - F.col("blocks")[i] + 2) / 2).cast("byte") for i in range(len(BLOCKS))]
    keys = [F.xxhash64(F.lit(j), *[c for i, c in enumerate(inside) if i % groups in chosen])
            for j, chosen in enumerate(combinations(range(groups), groups - max_bits))]
    assert len(keys) == comb(groups, max_bits)
    coordinates = ["zero", *[f"p{i}" for i in range(len(RANDOM_PIVOTS))]]
    rows = table.select(F.explode(F.array(*keys)).alias("key"), "fp", *coordinates)
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in coordinates])
    flips = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (apart <= max_bits) \
        & (flips <= max_bits)
    return a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def grouped(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """doc_id, text_hash (of the text), fp, group (a fingerprint of the
    component) and component_id for the rows of ``docs`` (doc_id, text)."""
    id_type = dict(docs.dtypes)["doc_id"]
    prints = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
                    .mapInArrow(_fingerprints(shingle), f"doc_id {id_type}, text_hash long, fp long"), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    links = stored(pivot_links(classes, max_bits, block_groups(classes.count(), max_bits)), "simhash-links")
    members = connected_components(links)
    named = members.join(classes, F.col("v") == F.col("fp")).select("v", "root", "first_id")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = stored(members.join(ids, "root").select("v", "root", "component_id"), "simhash-linked")
    by_class = stored(classes.join(linked, F.col("fp") == F.col("v"), "left").select(
        F.col("fp").alias("class"), F.coalesce("root", "fp").alias("group"),
        F.when(F.col("v").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")),
        "simhash-components")
    return prints.join(by_class, F.col("fp") == F.col("class")).drop("class")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (the fingerprint as a signed
    long), component_id (smallest doc_id reachable over links of at most
    ``max_bits`` differing bits).

    Null, empty and blank texts have fingerprint zero and link like others.
    Null ids count as members, never as a component's id (all null: null).
    Repeated rows stay, one result row each. Empty tables give empty results.
    Other columns of ``docs`` are not read."""
    return grouped(pick(docs, doc_id=id_col, text=text_col), shingle, max_bits).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one
    with the smallest id (null last; then by a hash of the text), once."""
    found = grouped(pick(docs, doc_id=id_col, text=text_col), shingle, max_bits)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
                                       .alias("first"))
    zero = F.lit(0).cast(found.schema["doc_id"].dataType)
    first = first.select("first.no_id", F.coalesce("first.doc_id", zero).alias("id"), "first.text_hash")
    keys = ["no_id", "id", "text_hash"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # names of ``docs`` can't clash within
    d = docs.select(F.col(f"`{id_col}`").isNull().alias("no_id"), F.coalesce(F.col(f"`{id_col}`"), zero).alias("id"),
                    F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), row).join(first, keys)
    d = d.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    return d.where("n = 1").select("row.*")
