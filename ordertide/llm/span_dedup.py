"""Substring de-duplication by sliding sentence spans.

Texts are cut behind sentence marks, clause marks and line ends of any script,
where these are far apart behind long words, and where those are far apart,
too, behind words (within endless words: code points) that a hash of the place
picks - rules that look at the place alone, so that a passage pasted into the
middle of another sentence is cut alike in all its copies. Runs of the same
word, which no hash tells apart, are cut every few words. From every cut the shortest run of several consecutive sentences
with enough words is one span, and to every cut the shortest such run that
ends there: whatever longer run is repeated, these lie in it and cover it, so
exactly the sentences of all repeated runs go. Span hashes are differences of
running polynomial hashes, so a text costs one pass whatever the spans'
lengths.

Spans join globally by a 128-bit hash. Those seen only once - nearly all -
never shuffle: two Bloom filters leave the suspects (bloom.py). Only spans
from a cut are in the filters: one that ends at a cut holds the span from its
own start, and is repeated only if that is. Suspects are
counted with map-side aggregation, so a passage of a third of all documents
is one row per task there, and meet the repeated ones in a join whose large
side can be split. Of a repeated span the first occurrence (smallest doc_id,
then place) stays; sentences covered by any other occurrence go. A Bloom
filter of the texts that lose something keeps all others out of the last join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.bloom import KeyFilter, TwiceSeen, binary_column, key_filter, twice_seen
from ordertide.llm.tables import stored

#: A sentence or clause with its marks and the white space behind them: texts without other scripts' marks.
UNIT = re.compile(rb"[^.!?,;:\n]*(?:[.!?,;:\n]+[\x20\x09-\x0D]*|\Z)")
#: The same marks and those of other scripts (Armenian, Arabic, Devanagari, Myanmar, Ethiopic, Khmer, ellipsis, CJK).
MARKS = (rb"(?:[.!?,;:\n]|\xd6\x89|\xd8[\x8c\x9b\x9f]|\xdb\x94|\xe0\xa5[\xa4\xa5]|\xe1\x81[\x8a\x8b]|"
         rb"\xe1\x8d[\xa1-\xa8]|\xe1\x9f[\x94\x95]|\xe2\x80\xa6|\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x8e\x9a\x9b\x9f]|"
         rb"\xef\xbd[\xa1\xa4])")
OTHER_LEADS = re.compile(rb"[\xd6\xd8\xdb\xe0-\xe3\xef]")
WIDE_UNIT = re.compile(rb"(?s:.)*?(?:" + MARKS + rb"+[\x20\x09-\x0D]*|\Z)")
#: Code points of scripts without spaces: CJK, kana, Thai, Lao, Tibetan, Myanmar, Khmer.
SPACELESS = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbf][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|"
                       rb"\xf0[\xa0-\xaf][\x80-\xbf]{2}")
SPACELESS_LEADS = re.compile(rb"[\xe0\xe1\xe3-\xe9\xf0]")
#: So many code points of these count as one word.
SPACELESS_WORD = 2
#: Bytes between two cuts, for the size of the filter only.
BYTES_A_CUT = 32
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SEED = 42


#: Where a stretch of over LONG_UNIT bytes has no mark, it is cut behind long words.
LONG_UNIT = 96
LONG_WORD = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{11,}+[\x20\x09-\x0D]+")  # from word starts only: linear
#: Where a piece is that long still, about every CUT_EVERY-th word is cut behind, and FARTHEST words are never exceeded.
WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")
CUT_EVERY, FARTHEST = 4, 8
#: The same for the code points of a word of over LONG_UNIT bytes.
POINT = re.compile(rb"[\x00-\x7f\xc0-\xff][\x80-\xbf]*|[\x80-\xbf]+")
CUT_POINTS, FARTHEST_POINTS = 8, 16


def _picked(parts: list[bytes], every: int, farthest: int) -> Iterator[bytes]:
    """The parts joined up to each whose hash, with the one before, is 0 modulo
    ``every``, and no more than ``farthest`` at once."""
    held, before = [], None
    for p in parts:
        held.append(p)
        key = p.lower().strip()
        if len(held) >= farthest or before is not None and xxhash.xxh64_intdigest(before + b" " + key, SEED) % every == 0:
            yield b"".join(held)
            held = []
        before = key
    if held:
        yield b"".join(held)


def _pieces(u: bytes) -> Iterator[bytes]:
    """A stretch of over LONG_UNIT bytes without a mark, cut at words and code points."""
    words = WORD.findall(u)
    if max(map(len, words)) <= LONG_UNIT:
        yield from _picked(words, CUT_EVERY, FARTHEST)
        return
    held = []
    for w in words:
        if len(w.rstrip()) <= LONG_UNIT:
            held.append(w)
            continue
        yield from _picked(held, CUT_EVERY, FARTHEST)
        held = []
        yield from _picked(POINT.findall(w), CUT_POINTS, FARTHEST_POINTS)
    yield from _picked(held, CUT_EVERY, FARTHEST)


def units(text: bytes) -> list[bytes]:
    """The text's sentences and clauses; joined they are the text."""
    out = []
    for u in (WIDE_UNIT if OTHER_LEADS.search(text) else UNIT).findall(text):
        if len(u) <= LONG_UNIT:
            if u:
                out.append(u)
            continue
        at = 0
        for end in [*(m.end() for m in LONG_WORD.finditer(u)), len(u)]:
            if end - at > LONG_UNIT:
                out.extend(_pieces(u[at:end]))
            elif end > at:
                out.append(u[at:end])
            at = end
    return out


def n_words(words: list[bytes]) -> int:
    """The number of words; SPACELESS_WORD code points of a script without
    spaces are one."""
    n = len(words)
    for w in words:
        if len(w) > 3 and not w.isascii() and SPACELESS_LEADS.search(w):
            n += max(0, -(-len(SPACELESS.findall(w)) // SPACELESS_WORD) - 1)
    return n


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1), modulo 2^64."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]), dtype=np.uint64)


def spans(parts: list[bytes], sentences: int, min_words: int) -> tuple[np.ndarray, ...]:
    """start, end (exclusive), two 64-bit hashes and the place among the spans
    of the one that starts alike, for each span: from every unit with a word
    the shortest run of at least ``sentences`` units with a word and at least
    ``min_words`` words, in order; then the shortest such runs back from every
    unit, without those that are there already. Case of A-Z and white space
    don't count. Units without a word belong to no count and no hash."""
    words = [u.lower().split() for u in parts]
    at = np.array([i for i, w in enumerate(words) if w], dtype=np.int64)
    n = len(at)
    none = np.zeros(0, dtype=np.uint64)
    if n < sentences:
        return at[:0], at[:0], none, none, at[:0]
    texts = [b" ".join(words[i]) for i in at]
    upto = np.concatenate([[0], np.cumsum([n_words(words[i]) for i in at])])
    first = np.arange(n)
    last = np.maximum(first + sentences, np.searchsorted(upto, upto[:-1] + min_words))
    end = first + 1
    begin = np.minimum(end - sentences, np.searchsorted(upto, upto[1:] - min_words, side="right") - 1)
    begin, end = begin[begin >= 0], end[begin >= 0]
    new = last[begin] != end
    # ``last`` rises: the spans from units are those of the first units, so a unit is the place of its span
    first = np.concatenate([first[last <= n], begin[new]])
    last = np.concatenate([last[last <= n], end[new]])
    out = []
    for seed, base in zip((SEED, SEED + 1), BASES):
        h = np.array([xxhash.xxh64_intdigest(t, seed) for t in texts], dtype=np.uint64)
        run = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(base, n), dtype=np.uint64)])
        # sum of h[i] * base^i over the span, divided by base^start (odd numbers have inverses modulo 2^64)
        out.append((run[last] - run[first]) * _powers(np.uint64(pow(int(base), -1, 1 << 64)), n)[first])
    return at[first], at[last - 1] + 1, out[0], out[1], first


def span_hashes(sentences: int, min_words: int):
    """Hashes of a text's spans from a cut."""
    def of(text: bytes | None) -> np.ndarray:
        _, _, h, _, alike = spans(units(text or b""), sentences, min_words)
        return h[alike == np.arange(len(h))]
    return of


def _suspects(seen: TwiceSeen, sentences: int, min_words: int):
    """mapInArrow body: the spans that may occur twice, with their document."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            rows, texts, cols = [], [], [[], [], [], []]
            for i, t in enumerate(binary_column(b, "text")):
                *found, alike = spans(units(t or b""), sentences, min_words)
                hit = seen.suspects(found[2])[alike]
                if hit.any():
                    for c, x in zip(cols, found):
                        c.append(x[hit])
                    rows.append(np.full(int(hit.sum()), i))
                    texts.append(np.full(int(hit.sum()), xxhash.xxh64_intdigest(t, SEED), dtype=np.uint64))
            if rows:
                start, end, h1, h2 = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(texts).view(np.int64)),
                     pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                     pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    ["doc_id", "text_hash", "start", "end", "h1", "h2"])
    return run


def _sure(inside: KeyFilter, maybe: bool):
    """mapInArrow body: the rows whose key is (``maybe``), or is surely not,
    among the filter's."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keys = b.column(b.schema.get_field_index("__key")).to_numpy().view(np.uint64)
            yield b.filter(pa.array(inside.holds(keys) == maybe))
    return run


def _rewrite(carry: list[str]):
    """mapInArrow body: texts without the units covered by ``lost`` spans."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts, n_removed = [], []
            for t, lost in zip(binary_column(b, "text"), b.column(b.schema.get_field_index("lost")).to_pylist()):
                if not lost:
                    texts.append(t)
                    n_removed.append(0)
                    continue
                parts = units(t or b"")
                gone = np.zeros(len(parts) + 1, dtype=np.int64)
                for s in lost:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                kept = [u for u, g in zip(parts, np.cumsum(gone)) if g == 0]
                texts.append(b"".join(kept))
                n_removed.append(len(parts) - len(kept))
            same = [b.column(b.schema.get_field_index(c)) for c in ["doc_id", *carry]]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_removed, pa.int64())],
                ["doc_id", *carry, "text", "n_removed"])
    return run


def dedup_spans(docs: DataFrame, sentences: int = 2, min_words: int = 30, bits_per_span: int = 8,
                max_bits: int = 1 << 30, across: bool = True, id_col: str = "doc_id", text_col: str = "text",
                carry: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the ``carry`` columns, text (without
    repeated spans), n_removed (sentences).

    ``across``: a span is repeated if at least two texts hold it; a text that
    only repeats itself stays as it is. Else any second occurrence counts.

    Null texts stay null, texts without a span stay as they are, and so do
    the first occurrences, even where a span overlaps itself: of such runs
    only what lies behind the first one goes. Occurrences are ordered by doc_id
    (null first), then a hash of the text, then place; rows that agree in id
    and text are one occurrence and are treated alike. Very long texts are cut
    and hashed in one pass, whole; a text's spans are some numbers each. Empty
    tables give empty results. Names in ``carry`` must differ from the
    result's own; other columns of ``docs`` are not read."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                    *[F.col(f"`{c}`") for c in carry])
    types = dict(d.dtypes)
    expected = d.agg(F.sum(F.octet_length("text") / BYTES_A_CUT)).first()[0] or 0
    seen = twice_seen(d, span_hashes(sentences, min_words), int(expected), bits_per_span, max_bits)
    suspects = stored(d.select("doc_id", "text").mapInArrow(
        _suspects(seen, sentences, min_words),
        f"doc_id {types['doc_id']}, text_hash long, start int, end int, h1 long, h2 long"), "span-suspects")
    seen.release()
    place = F.struct("doc_id", "text_hash", "start", "end")
    in_first = lambda i, h: F.col(i).eqNullSafe(F.col("first.doc_id")) & (F.col(h) == F.col("first.text_hash"))
    repeated = suspects.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # written, so that Spark can split what the suspects of a hot span meet
    repeated = stored(repeated.where(~in_first("last.doc_id", "last.text_hash") if across else
                                     ~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"), "span-repeated")
    same_text = in_first("doc_id", "text_hash")
    others = suspects.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    others = others.withColumn("start", F.when(same_text, F.greatest("start", "first.end")).otherwise(F.col("start")))
    lost = stored(others.where("start < end").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "start", "end")
                  .distinct().groupBy("__id", "__hash").agg(F.collect_list(F.struct("start", "end")).alias("lost")), "span-lost")
    # texts that surely lose nothing don't travel to the spans of others
    d = d.withColumn("__hash", F.xxhash64("text")).withColumn("__key", F.xxhash64("doc_id", "__hash"))
    inside = key_filter(lost.select(F.xxhash64("__id", "__hash").alias("key")), lost.count(), max_bits=max_bits)
    schema = d.schema
    whole = d.mapInArrow(_sure(inside, False), schema).select("doc_id", *carry, "text", F.lit(0).cast("long").alias("n_removed"))
    cut = d.mapInArrow(_sure(inside, True), schema).withColumnRenamed("__hash", "__text")
    joined = cut.join(lost, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left")
    out = ", ".join([f"doc_id {types['doc_id']}", *[f"`{c}` {types[c]}" for c in carry], "text string", "n_removed long"])
    return joined.select("doc_id", *carry, "text", "lost").mapInArrow(_rewrite(list(carry)), out).unionByName(whole)
