"""Two Bloom filters over hashes of parts of texts: once seen and twice seen.

Every task turns its texts' hashes into positions of both filters. Partial
filters travel as positions per segment of the bit space and are folded
segment by segment (once: OR; twice: OR, and what is set in two partial
once-filters), so no task holds more than its segments and no part of a text
travels. A hash seen twice has both its bits in the twice-seen filter; a
filter too small for its input suspects more, and misses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT_BITS = 1 << 20
FLUSH_HASHES = 1 << 20


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values as bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each 64-bit hash."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask], axis=1).astype(np.int64)


def filter_bits(expected: int, bits_per_hash: int, max_bits: int) -> int:
    """The power of two that holds ``bits_per_hash`` for each expected hash,
    from one segment up to ``max_bits``."""
    want = max(SEGMENT_BITS, min(max_bits, expected * bits_per_hash))
    return 1 << (want - 1).bit_length()


class TwiceSeen:
    """The twice-seen filter, broadcast to all tasks."""

    def __init__(self, broadcast, bits: int):
        self.broadcast, self.bits = broadcast, bits

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may have been seen twice."""
        pos = positions(hashes, self.bits)
        data = np.frombuffer(self.broadcast.value, np.uint8)
        return ((data[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1).all(axis=1)

    def release(self) -> None:
        self.broadcast.unpersist()


def _partial(bits: int, hashes_of: Callable[[bytes | None], np.ndarray]):
    """mapInArrow body: rows (segment, once, twice) with little-endian uint32
    offsets of the bits set once and twice or more by this task's hashes."""
    def rows(hashes: list[np.ndarray]) -> pa.RecordBatch:
        pos, n = np.unique(positions(np.concatenate(hashes), bits).ravel(), return_counts=True)
        seg, off = pos // SEGMENT_BITS, (pos % SEGMENT_BITS).astype("<u4")
        cuts = np.flatnonzero(np.diff(seg, prepend=-1))
        out = [(int(seg[a]), off[a:b].tobytes(), off[a:b][n[a:b] > 1].tobytes())
               for a, b in zip(cuts, [*cuts[1:], len(seg)])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()),
                                           pa.array([r[1] for r in out], pa.binary()),
                                           pa.array([r[2] for r in out], pa.binary())], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for b in batches:
            for t in binary_column(b, "text"):
                h = hashes_of(t)
                held.append(h)
                n += len(h)
                if n >= FLUSH_HASHES:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)
    return run


def _fold(batches: Iterator[pa.RecordBatch]):
    """mapInArrow body: fold the partial filters of this task's segments and
    give each segment's twice-seen bits."""
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for seg, once, twice in zip(*(c.to_pylist() for c in b.columns)):
            if seg not in seen:
                seen[seg] = (np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool))
            o, t = seen[seg]
            at = np.frombuffer(once, "<u4")
            t[at[o[at]]] = True
            t[np.frombuffer(twice, "<u4")] = True
            o[at] = True
    for seg, (_, t) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()),
                                          pa.array([np.packbits(t, bitorder="little").tobytes()], pa.binary())],
                                         ["segment", "bits"])


def twice_seen(texts: DataFrame, hashes_of: Callable[[bytes | None], np.ndarray], expected: int,
               bits_per_hash: int = 16, max_bits: int = 1 << 30) -> TwiceSeen:
    """The filter of hashes seen twice or more over the column ``text``.
    ``expected``: about how many hashes there are; ``max_bits`` bounds what is
    sent to all tasks (2^30 bits: 128 MB)."""
    bits = filter_bits(expected, bits_per_hash, max_bits)
    partial = texts.select("text").mapInArrow(_partial(bits, hashes_of), "segment int, once binary, twice binary")
    data = bytearray(bits // 8)
    step = SEGMENT_BITS // 8
    for seg, part in partial.repartition("segment").mapInArrow(_fold, "segment int, bits binary").toLocalIterator():
        data[seg * step:(seg + 1) * step] = part  # bits / 8 bytes in all
    return TwiceSeen(texts.sparkSession.sparkContext.broadcast(bytes(data)), bits)


class KeyFilter(TwiceSeen):
    """A Bloom filter of 64-bit keys, broadcast to all tasks."""

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may be among the filter's; false ones surely are not."""
        return self.suspects(keys)


def _key_bits(bits: int):
    """mapInArrow body: (segment, once): the bits that this task's keys set."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            pos = np.unique(positions(b.column(0).to_numpy().view(np.uint64), bits))
            cuts = np.flatnonzero(np.diff(pos // SEGMENT_BITS, prepend=-1)).tolist()
            rows = [(int(pos[i] // SEGMENT_BITS), (pos[i:j] % SEGMENT_BITS).astype("<u4").tobytes())
                    for i, j in zip(cuts, [*cuts[1:], len(pos)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                             ["segment", "once"])
    return run


def _fold_keys(batches: Iterator[pa.RecordBatch]):
    """mapInArrow body: each segment's bits."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for seg, once in zip(*(c.to_pylist() for c in b.columns)):
            held.setdefault(seg, np.zeros(SEGMENT_BITS, bool))[np.frombuffer(once, "<u4")] = True
    for seg, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                         ["segment", "bits"])


def key_filter(keys: DataFrame, expected: int, bits_per_key: int = 16, max_bits: int = 1 << 30) -> KeyFilter:
    """The filter of the 64-bit hashes in the one column of ``keys``."""
    bits = filter_bits(expected, bits_per_key, max_bits)
    partial = keys.mapInArrow(_key_bits(bits), "segment int, once binary")
    data = bytearray(bits // 8)
    step = SEGMENT_BITS // 8
    for seg, part in partial.repartition("segment").mapInArrow(_fold_keys, "segment int, bits binary").toLocalIterator():
        data[seg * step:(seg + 1) * step] = part
    return KeyFilter(keys.sparkSession.sparkContext.broadcast(bytes(data)), bits)
