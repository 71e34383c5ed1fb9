"""Line de-duplication with two Bloom filters.

1. Every task hashes its documents' lines into a once-seen and a twice-seen
   filter (bloom.py); no line travels.
2. The twice-seen filter (its size is counted and bounded) goes to all tasks;
   a second scan emits digests only of lines that it suspects. These alone
   shuffle: exact counts per line and the choice of the kept occurrence.
3. Confirmed lines meet the suspects again; each document gets the digests it
   loses, and one join by id rewrites the texts.

A filter that is too small for its input suspects more lines and costs more
shuffle; the result is the same, as step 2 confirms every line by a 128-bit
digest of its key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.bloom import TwiceSeen, binary_column, twice_seen
from ordertide.llm.tables import stored


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def is_long(key: bytes, min_chars: int) -> bool:
    """At least ``min_chars`` code points."""
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def long_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    """Distinct long line keys of one text."""
    if not text:
        return set()
    return {k for k in (line_key(x) for x in text.split(b"\n")) if is_long(k, min_chars)}


def line_hashes(min_chars: int):
    """Hashes of a text's distinct long line keys."""
    def of(text: bytes | None) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in long_keys(text, min_chars)], dtype=np.uint64)
    return of


def _suspects(seen: TwiceSeen, min_chars: int):
    """mapInArrow body: (doc_id, digest) of each document's distinct long lines
    that the filter suspects."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            rows, keys = [], []
            for i, t in enumerate(binary_column(b, "text")):
                own = long_keys(t, min_chars)
                keys += own
                rows += [i] * len(own)
            if not keys:
                continue
            at = np.flatnonzero(seen.suspects(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.array(rows)[at])),
                 pa.array([hashlib.blake2b(keys[i], digest_size=16).digest() for i in at], pa.binary())],
                ["doc_id", "digest"])
    return run


def _rewrite(min_chars: int, carry: list[str]):
    """mapInArrow body: texts without the lines whose digest is in ``lost``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, lost in zip(binary_column(b, "text"), b.column(b.schema.get_field_index("lost")).to_pylist()):
                lines = (t or b"").split(b"\n")
                kept = lines
                if lost:
                    gone = set(lost)
                    kept = [x for x in lines if not (is_long(k := line_key(x), min_chars) and
                                                     hashlib.blake2b(k, digest_size=16).digest() in gone)]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            same = [b.column(b.schema.get_field_index(c)) for c in ["doc_id", *carry]]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64())],
                ["doc_id", *carry, "text", "n_lines", "n_dropped"])
    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: str = "last", bits_per_line: int = 16,
                max_bits: int = 1 << 30, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the ``carry`` columns, text (kept
    lines joined by \\n), n_lines, n_dropped.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines but those in the largest id (``keep`` =
    "first": the smallest). Null and empty texts are one empty line; texts of
    any length are split whole, in the memory of one text and its lines. Rows
    that share an id are one document: they count once, and share the fate
    of their lines. Rows without an id are one document, too; its id is
    smaller than all others ("first": larger). Empty tables give empty
    results. Names in ``carry`` must differ from the result's own; other
    columns of ``docs`` are not read.

    ``max_bits`` bounds the filter that is sent to all tasks (2^30 bits: 128
    MB); beyond it more lines are confirmed exactly, none is lost."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                    *[F.col(f"`{c}`") for c in carry])
    newlines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    lines = d.agg(F.sum(newlines + 1)).first()[0] or 0
    seen = twice_seen(d, line_hashes(min_chars), lines, bits_per_line, max_bits)
    id_type = dict(d.dtypes)["doc_id"]
    suspects = stored(d.select("doc_id", "text").mapInArrow(
        _suspects(seen, min_chars), f"doc_id {id_type}, digest binary"), "line-suspects")
    seen.release()
    best = F.max("doc_id") if keep == "last" else F.min("doc_id")
    confirmed = stored(suspects.groupBy("digest").agg(F.count_distinct(F.struct("doc_id")).alias("n"), best.alias("keeper"))
                       .where(F.col("n") >= min_docs).select("digest", "keeper"), "line-confirmed")
    lost = (suspects.join(confirmed, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("digest").alias("lost")))
    joined = d.join(lost, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", *carry, "text", "lost")
    types = dict(d.dtypes)
    schema = ", ".join([f"doc_id {id_type}", *[f"`{c}` {types[c]}" for c in carry], "text string",
                        "n_lines long", "n_dropped long"])
    return joined.mapInArrow(_rewrite(min_chars, list(carry)), schema)
