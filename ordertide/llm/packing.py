"""Best-fit packing of tokenised documents by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the corpus' histogram has at
most ``capacity`` rows however many documents there are; only it reaches the
driver. On it the packing is planned: the large lengths, in descending order,
are cut into groups of equal cardinality and rounded up to their group's
largest; configurations over these few sizes are optimised (linear program by
column generation); whole configurations are filled with the actual lengths;
what is left and the small lengths go where they fit best, longest first. All
of it works on runs of equal sequences, so the plan's size is bounded by the
capacity, too.

Documents take part once more at the end: the n-th piece of a length finds
its sequence and offset in the plan. Ranks within a length are dealt over
hash buckets, so a very common length (full pieces) is not one task.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.tables import bucket_rank, pick, stored

ID_BYTES = 4
CACHE_WORDS = 200_000
#: Pieces per result batch hold about this many bytes of ids.
BATCH_BYTES = 8 << 20
_TOKENIZERS: dict[int, tuple] = {}


class WordCache:
    """Ids of white-space separated words as bytes, in two generations of at
    most CACHE_WORDS words: frequent ones stay, memory is bounded.

    Unknown words are encoded together. The tokenizer cuts between letters and
    marks, so a word that is letters and then marks is the ids of both parts;
    runs of letters are cut apart at the tokens that end a word, other words
    by a mark between them that is one id."""

    MARK = "\x01"
    #: Lower-case letters of ASCII and Latin-1 in UTF-8, then ASCII marks.
    LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?*#$%&|]*)\Z")
    WORD_END = "</w>"

    def __init__(self, tokenizer):
        self.tokenizer, self.young, self.old = tokenizer, {}, {}
        self.mark = np.array(self._encode(self.MARK), dtype="<u4")
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.WORD_END)]] = True

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def ids(self, text: bytes) -> bytes:
        w = text.lower().split()
        missing = set(w).difference(self.young)
        if missing:
            if len(self.young) + 2 * len(missing) > CACHE_WORDS:
                self.old, self.young = self.young, {}
                missing = set(w)
            self._learn(missing)
        return b"".join(map(self.young.__getitem__, w))

    def _learn(self, missing: set[bytes]) -> None:
        young, old, letters, others, cut = self.young, self.old, set(), set(), []
        for x in missing:
            if (known := old.get(x)) is not None:
                young[x] = known
                continue
            m = self.LETTERS.match(x)
            if m is None:
                others.add(x)
                continue
            word, marks = m.groups()
            if marks:
                cut.append((x, word, marks))
            for part, new in ((word, letters), (marks, others)):
                if part and part not in young:
                    if (known := old.get(part)) is not None:
                        young[part] = known
                    else:
                        new.add(part)
        if letters:
            new = list(letters)
            ids = np.array(self._encode(b" ".join(new).decode()), dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(new):
                self._keep(new, ids, [0, *ends[:-1].tolist()], ends.tolist())
            else:
                others |= letters
        if others:
            new = list(others)
            texts = [x.decode("utf-8", "replace") for x in new]
            ids = np.array(self._encode(f" {self.MARK} ".join(texts)), dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark[0]).tolist() if len(self.mark) == 1 else []
            if len(cuts) == len(new) - 1:
                self._keep(new, ids, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)])
            else:  # a word holds the mark itself
                young.update((x, np.array(self._encode(t), dtype="<u4").tobytes()) for x, t in zip(new, texts))
        for x, word, marks in cut:
            young[x] = young[word] + young[marks]

    def _keep(self, new: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        data = ids.tobytes()
        self.young.update(zip(new, (data[a * ID_BYTES:b * ID_BYTES] for a, b in zip(starts, ends))))


def _word_cache(shared) -> WordCache:
    from tokenizers import Tokenizer
    if shared.id not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[shared.id] = WordCache(Tokenizer.from_str(shared.value))
    return _TOKENIZERS[shared.id]


class _Shared:
    """A broadcast value with a key that is equal in every task of the job."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def _pieces(shared: _Shared, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        cache = _word_cache(shared)
        for b in batches:
            ids, texts = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text"))
            rows, piece, start, data, held = [], [], [], [], 0

            def result():
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(x) // ID_BYTES for x in data], pa.int64()), pa.array(data, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

            for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
                all_ids = cache.ids(t or b"") + end
                for p, at in enumerate(range(0, len(all_ids), capacity * ID_BYTES)):
                    rows.append(i)
                    piece.append(p)
                    start.append(at // ID_BYTES)
                    data.append(all_ids[at:at + capacity * ID_BYTES])
                held += len(all_ids)
                if held >= BATCH_BYTES:
                    yield result()
                    rows, piece, start, data, held = [], [], [], [], 0
            if rows:
                yield result()
    return run


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Pieces of the tokenised documents: doc_id, piece (from 0), start (ids in
    front within the document), length, ids (little-endian unsigned 32-bit).

    A document's ids are the tokenizer's, without special tokens, then
    ``end_id``; null and empty texts are ``end_id`` alone. Documents longer
    than ``capacity`` are cut every ``capacity`` ids. Words are encoded one by
    one, so the tokenizer must drop white space, cut at it and lower-case, as
    this kind does. The tokenizer's file is read on the driver and sent once.
    Repeated rows and null ids are kept; other columns are not read."""
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(text), hash(tokenizer_path))
    d = pick(docs, doc_id=id_col, text=text_col)
    return d.mapInArrow(_pieces(shared, capacity, end_id),
                        f"doc_id {dict(d.dtypes)['doc_id']}, piece int, start long, length long, ids binary")


def _best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the counts of sizes within capacity with the largest
    sum of values."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = sizes <= c
        gain = np.where(fit, values + best[c - np.minimum(sizes, c)], 0.0)
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], last[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if last[c] >= 0:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
        else:
            c -= 1
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(configuration, times) over few sizes: the linear program that covers
    all counts with the fewest sequences, by column generation, rounded down."""
    s, n = np.array(sizes), np.array(counts, dtype=float)
    basis = np.diag([capacity // x for x in sizes]).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, duals = inverse @ n, inverse.sum(axis=0)
        a = _best_configuration(np.maximum(duals, 0), s, capacity)
        if duals @ a <= 1 + 1e-7:
            break
        d = inverse @ a
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = a
    x = np.linalg.inv(basis) @ n
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-6))) for j in range(len(sizes)) if x[j] >= 1 - 1e-6]


class _Descending:
    """Lengths with counts, taken from the front."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.runs, self.at = [list(r) for r in runs], 0

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n and self.at < len(self.runs):
            length, have = self.runs[self.at]
            k = min(n, have)
            out.append((length, k))
            self.runs[self.at][1] -= k
            n -= k
            self.at += self.runs[self.at][1] == 0
        return out

    def left(self) -> int:
        return sum(c for _, c in self.runs[self.at:])


class _Open:
    """Runs of equal sequences (count, contents) by the room they have left."""

    def __init__(self):
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, tuple]]] = {}

    def put(self, room: int, count: int, contents: tuple) -> None:
        if count:
            if room not in self.runs:
                bisect.insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((count, contents))

    def total(self) -> int:
        return sum(count for runs in self.runs.values() for count, _ in runs)

    def tightest(self, length: int) -> tuple[int, int, tuple] | None:
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        count, contents = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.rooms[at]
        return room, count, contents


def plan(histogram: dict[int, int], capacity: int, groups: int = 48,
         large_from: tuple[float, ...] = (1 / 3, 1 / 2)) -> dict[str, np.ndarray]:
    """Where pieces go: for each length, runs of ranks with the run's first
    sequence and its offset, as arrays length, rank, sequence, offset sorted
    by (length, rank). Lengths above a share of the capacity are large; of the
    shares in ``large_from`` the one that needs the fewest sequences is taken."""
    tried = [_grouped_plan(histogram, capacity, groups, share) for share in large_from]
    return _layout(min(tried, key=_Open.total))


def _grouped_plan(histogram: dict[int, int], capacity: int, groups: int, large_from: float) -> _Open:
    large = [(n, c) for n, c in sorted(histogram.items(), reverse=True) if c and n > capacity * large_from]
    rest = {n: c for n, c in histogram.items() if c and n <= capacity * large_from}
    total = sum(c for _, c in large)
    sequences = _Open()
    if total:
        k = max(1, min(groups, total // 4))
        source, cuts = _Descending(large), [round(i * total / k) for i in range(k + 1)]
        members = [source.take(b - a) for a, b in zip(cuts, cuts[1:])]
        by_size: dict[int, list] = {}
        for m in members:  # groups that round to the same size are one
            by_size.setdefault(m[0][0], []).extend(m)
        sizes = list(by_size)
        pools = [_Descending(by_size[s]) for s in sizes]
        for a, times in configurations(sizes, [p.left() for p in pools], capacity):
            used = np.flatnonzero(a)
            times = min([times, *[pools[j].left() // int(a[j]) for j in used]])
            slots = [pools[j].take(times) for j in used for _ in range(int(a[j]))]
            ends = sorted({e for s in slots for e in np.cumsum([c for _, c in s]).tolist()})
            steps = [(np.cumsum([c for _, c in s]).tolist(), [n for n, _ in s]) for s in slots]
            for a0, b0 in zip([0, *ends], ends):
                contents = tuple(lengths[bisect.bisect_right(upto, a0)] for upto, lengths in steps)
                sequences.put(capacity - sum(contents), b0 - a0, contents)
        for p in pools:
            for n, c in p.take(p.left()):
                rest[n] = rest.get(n, 0) + c
    for n, c in sorted(rest.items(), reverse=True):
        while c:
            found = sequences.tightest(n)
            room, count, contents = found or (capacity, -(-c // (capacity // n)), ())
            each = min(room // n, c)
            full = min(count, c // each)
            sequences.put(room - each * n, full, contents + (n,) * each)
            c -= full * each
            if found:
                sequences.put(room, count - full, contents)
    return sequences


def _layout(sequences: _Open) -> dict[str, np.ndarray]:
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for room in sequences.rooms:
        for count, contents in sequences.runs[room]:
            offset = 0
            for n in contents:
                rows.append((n, ranks.get(n, 0), first, offset))
                ranks[n] = ranks.get(n, 0) + count
                offset += n
            first += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


RANK_BITS = 45


def _place(shared, columns: list[str]):
    """mapInArrow body: sequence and offset of pieces by length and rank."""
    def run(batches: Iterator[pa.RecordBatch]):
        p = shared.value
        keys = (p["length"] << RANK_BITS) + p["rank"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                            for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)) for c in columns],
                 pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])],
                [*columns, "sequence_id", "offset"])
    return run


def pack(pieces: DataFrame, capacity: int = 4096, buckets: int = 1024) -> DataFrame:
    """Add sequence_id (from 0) and offset to ``pieces`` (doc_id, piece, length
    from 1 to ``capacity``; further columns are carried, names other than
    rank, bucket, sequence_id and offset). Sequences hold at most ``capacity``
    ids without gaps. Rows that agree in doc_id and piece take any of their
    places; an empty table gives an empty result."""
    rows = stored(pieces, "pack-pieces")
    columns = rows.columns
    histogram = {n: c for n, c in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))  # bounded by the capacity
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    ranked = bucket_rank(rows, ["length"], "bucket", [F.col("doc_id").asc_nulls_first(), "piece"])
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes if c in columns] + ["sequence_id long", "offset long"])
    return ranked.select(*columns, "rank").mapInArrow(_place(shared, columns), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and ids (binary), for ``packed``
    pieces that carry their ids. A group is one sequence, so its size is
    bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
