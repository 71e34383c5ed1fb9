"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame
functions only.

Tokens are words with runs of ASCII punctuation split off. Their unigrams and
bigrams are hashed into a fixed number of buckets. One multinomial over the
buckets is counted over the whole corpus, one over trusted documents; a
document's score is the sum of its n-grams' log ratios (trusted over corpus)
divided by their number, and every document is held to one threshold. Ratios
of seldom n-grams are drawn to 0, so scores hardly depend on the number of
buckets, and a new word says little.

Scale: the counts are one map-side aggregation (its shuffle holds at most
tasks * buckets rows); the ratios, one per bucket, are a constant of the
scoring plan, which has no shuffle. The target counts use all trusted
documents: their ids are broadcast if they are counted to be small, else they
meet the documents in a shuffle join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.tables import WHITE, pick, stored, words
from ordertide.operators.joins import BROADCAST_MAX_BYTES, broadcast_if_small

PUNCTUATION = "([!-/:-@\\[-`{-~]+)"
SYMBOLS = "#*$%&|<>"
ANY_SYMBOL = "[#*$%&|<>]"
WINDOW = 5
#: Decimals of a log ratio: sums of whole numbers don't depend on their order.
UNIT = 10_000


def _pairs(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def _head(array: str, n: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))


def _tail(array: str, start: int, n: Column) -> Column:
    return F.slice(array, F.lit(start), F.greatest(n, F.lit(0)))


def with_grams(df: DataFrame, buckets: int) -> DataFrame:
    """Add ``grams``: the buckets of all unigrams and bigrams of ``text``."""
    spaced = F.regexp_replace(F.coalesce("text", F.lit("")), PUNCTUATION, " $1 ")
    tokens = F.array_remove(F.split(spaced, WHITE), "")
    df = df.withColumn("tokens", F.transform(tokens, lambda x: F.xxhash64(x)))
    n = F.size("tokens") - 1
    df = df.withColumn("grams", F.concat("tokens", _pairs(_head("tokens", n), _tail("tokens", 2, n)))).drop("tokens")
    return df.withColumn("grams", F.transform("grams", lambda h: F.pmod(h, F.lit(buckets)).cast("int")))


def log_ratios(docs: DataFrame, trusted_ids: DataFrame, buckets: int, prior: float = 16.0,
               max_bytes: int = BROADCAST_MAX_BYTES) -> list[int]:
    """For each bucket, UNIT times the log of its share in the trusted
    documents over its share in all documents. Each bucket's trusted count is
    drawn to the corpus by ``prior`` n-grams at the mean ratio, so that seldom
    and unseen n-grams weigh little, however many buckets there are.
    ``trusted_ids``: distinct doc_id, any number; broadcast up to ``max_bytes``."""
    t = broadcast_if_small(stored(trusted_ids.select(F.col("doc_id").alias("__trusted")), "llr-trusted"), max_bytes)
    d = docs.join(t, F.col("doc_id") == F.col("__trusted"), "left")
    d = with_grams(d.select("text", F.col("__trusted").isNotNull().cast("long").alias("trusted")), buckets)
    # explode() would have the optimizer compute the n-grams again, for a filter on empty arrays
    counted = (d.select(F.explode_outer("grams").alias("bucket"), "trusted").groupBy("bucket")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("trusted").alias("t")).collect())  # <= buckets + 1 rows
    out, seen = [0] * buckets, [r for r in counted if r["bucket"] is not None]
    if not (n_trusted := sum(r["t"] for r in seen)):
        return out
    share = n_trusted / sum(r["n"] for r in seen)
    for r in seen:
        out[r["bucket"]] = round(UNIT * math.log((r["t"] + prior * share) / ((r["n"] + prior) * share)))
    return out


def _repeat_words(windows: str) -> Column:
    """Number of words within windows (array of hashes by start) that occur
    more than once."""
    by_hash = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(s):
        same = lambda e, other: F.coalesce(F.get(s, other)["x"] == e["x"], F.lit(False))
        return F.filter(F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"])),
                        lambda i: i.isNotNull())

    starts = F.array_sort(F.transform(F.array(by_hash), repeated)[0])
    none = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(starts, none, lambda acc, i: F.struct(
        (acc["covered"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("covered"), i.alias("last")))["covered"]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("long"))


def with_rules(df: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed, from ``text``."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn("w", words(F.col("text"))).withColumn("lines", lines)
    df = df.withColumns({
        "n_words": F.size("w").cast("long"), "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.when(text.rlike(ANY_SYMBOL), F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
                      .otherwise(0).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "h1": F.transform("w", lambda x: F.xxhash64(x))}).drop("w", "lines")
    n = F.size("h1")
    df = df.withColumn("h2", _pairs(_head("h1", n - 1), _tail("h1", 2, n - 1)))
    df = df.withColumn("h4", _pairs(_head("h2", n - 3), _tail("h2", 3, n - 3))).drop("h2")
    df = df.withColumn("h5", _pairs(_head("h4", n - 4), _tail("h1", 5, n - 4))).drop("h1", "h4")
    df = df.withColumn("n_repeat_words", _repeat_words("h5")).drop("h5")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def trusted(labels: DataFrame) -> DataFrame:
    """The distinct ids of all documents with quality 1."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def judge(docs: DataFrame, trusted_ids: DataFrame, buckets: int = 1 << 18, threshold: float = -0.15,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, score (mean log ratio of the
    n-grams), kept (rules passed and score >= ``threshold``).

    Null texts count as empty: no word, score 0, rules failed. Without trusted
    documents all ratios are 0, so the rules alone decide. Null ids are
    judged like others and never trusted; rows with equal ids are each trusted
    if one is. A text is read whole, as arrays of hashes in one row of one task:
    some 60 bytes a word. Empty tables give empty results; other columns are not
    read."""
    d = pick(docs, doc_id=id_col, text=text_col)
    ratios = log_ratios(d, trusted_ids, buckets)
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    d = with_grams(with_rules(d), buckets).drop("text")
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
    d = d.withColumn("score", total / (F.lit(float(UNIT)) * F.greatest(F.size("grams"), F.lit(1)))).drop("grams")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
