"""Ranked lexical search with hashed max-sketches.

The index has one row per document: its length, its terms' 64-bit hashes with
their frequencies, and a sketch: every term is hashed to one of ``width``
coordinates, which hold the largest frequency that falls there. A term's
impact rises with its frequency alone once the document's length is given, so
a coordinate's frequency bounds the impact of any term that is hashed to it.
The width follows from the number of distinct terms, so a sketch is as loose
for a long document as for a short one.

A search looks up all queries at once: the impacts of a block of sketches
times a matrix of (coordinate, query) term weights gives the upper bounds of
all its documents and queries. For each query a task rescores its documents
exactly, by falling bounds, until no bound reaches the k-th score that the
task has found so far. Every task gives at most k documents a query, in
whichever order blocks come, and the k best of these are the result: nothing
is cut off that could be among them.

Statistics (numbers of documents and terms, document frequencies of the query
terms) are sums over the whole index. Queries come to the driver and go to
all tasks in blocks of a bounded number of terms; each block reads the index
once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordertide.llm.bloom import binary_column
from ordertide.llm.tables import pick, stored

#: Fixed by the contract: terms are runs of ASCII letters and digits and of everything beyond ASCII; A-Z count as a-z.
TERM_BYTES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in bytes(range(256)).lower())
#: Impacts: (UNIT * tf) div (1000 * tf + 8 * m), so none reaches TOP.
UNIT, TOP = 1_000_000_000, 1_000_000
SEED = 42
#: Coordinates for each distinct term, from MIN_WIDTH up; a coordinate's largest value stands for itself and all above.
PER_TERM, MIN_WIDTH, FULL = 4, 64, 255
#: Cells of a block of sketches, and of a block of bounds, that a task holds at once.
BLOCK_CELLS = 1 << 21
#: Terms, with repeats in different queries, and queries of one block.
QUERY_TERMS, QUERIES = 1 << 17, 2048


def terms(text: bytes | None) -> list[bytes]:
    """The text's terms, in order."""
    return (text or b"").translate(TERM_BYTES).split()


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, SEED)


def width_of(distinct: int) -> int:
    """A power of two, at least PER_TERM times the distinct terms."""
    return max(MIN_WIDTH, 1 << max(0, PER_TERM * distinct - 1).bit_length())


def _index(batches: Iterator[pa.RecordBatch]):
    """mapInArrow body: (doc_id, n, width, hashes, tf, sketch)."""
    for b in batches:
        rows = []
        for t in binary_column(b, "text"):
            found = Counter(terms(t))
            h = np.array([term_hash(x) for x in found], dtype="<u8")
            tf = np.array(list(found.values()), dtype="<i8")
            order = np.argsort(h)
            h, tf = h[order], tf[order]
            width = width_of(len(h))
            sketch = np.zeros(width, dtype=np.uint8)
            np.maximum.at(sketch, (h % np.uint64(width)).astype(np.int64), np.minimum(tf, FULL).astype(np.uint8))
            rows.append((int(tf.sum()), width, h.tobytes(), tf.astype("<i4").tobytes(), sketch.tobytes()))
        n, width, hashes, tf, sketch = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(width, pa.int32()),
             pa.array(hashes, pa.binary()), pa.array(tf, pa.binary()), pa.array(sketch, pa.binary())],
            ["doc_id", "n", "width", "hashes", "tf", "sketch"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, written to shared storage: doc_id, n (terms
    with repeats), hashes, tf and sketch (little-endian arrays). Null and empty
    texts have no terms; other columns are not read."""
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return stored(d.mapInArrow(_index, f"doc_id {kind}, n long, width int, hashes binary, tf binary, sketch binary"),
                  "search-index")


def _frequencies(wanted):
    """mapInArrow body: in how many of this task's documents each wanted term
    is (place, df)."""
    def run(batches: Iterator[pa.RecordBatch]):
        hashes = wanted.value
        df = np.zeros(len(hashes), dtype=np.int64)
        for b in batches:
            flat = b"".join(x for x in b.column(0).to_pylist() if x)
            found = np.frombuffer(flat, "<u8")
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            df += np.bincount(at[hashes[at] == found], minlength=len(hashes))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["place", "df"])
    return run


class Queries:
    """A block of queries: their terms' hashes and weights, for tasks."""

    def __init__(self, items: list[tuple], df: dict[int, int], documents: int, length: int, k: int):
        self.k, self.documents, self.length = k, documents, length
        self.ids = [i for i, _ in items]
        self.hashes = [sorted(h for h in hs if h in df) for _, hs in items]
        self.weight = {h: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for h, n in df.items()}

    def matrix(self, width: int) -> np.ndarray:
        """(coordinate, query): the sum of the query's weights there."""
        out = np.zeros((width, len(self.ids)))
        for q, hs in enumerate(self.hashes):
            for h in hs:
                out[h % width, q] += self.weight[h]
        return out

    def normal(self, n: np.ndarray | int):
        """m of documents of n terms."""
        return 100 - 90 + (90 * n * self.documents) // self.length


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Impacts of each row's frequencies; FULL bounds all that are as large."""
    tf = tf.astype(np.int64)
    out = (UNIT * tf) // np.maximum(1000 * tf + 8 * m[:, None], 1)
    return np.where(tf == FULL, TOP, out).astype(np.float64)


class _Best:
    """The k best documents of each query so far, in one task."""

    def __init__(self, queries: Queries):
        self.queries = queries
        self.found: list[list[tuple]] = [[] for _ in queries.ids]  # (-score, id is null, id)

    def least(self) -> np.ndarray:
        """The score that a document needs, for each query."""
        return np.array([-f[-1][0] if len(f) >= self.queries.k else 1 for f in self.found], dtype=np.float64)

    def rescore(self, ids: list, n: np.ndarray, hashes: list[bytes], tfs: list[bytes], bounds: np.ndarray) -> None:
        """Take in documents with their bounds by (document, query)."""
        held: dict[int, tuple[dict, int]] = {}
        q = self.queries
        hopeful = bounds >= self.least()
        for j in np.flatnonzero(hopeful.any(axis=0)):
            at = np.flatnonzero(hopeful[:, j])
            best = self.found[j]
            for d in at[np.argsort(-bounds[at, j], kind="stable")]:
                if len(best) >= q.k and bounds[d, j] < -best[-1][0]:
                    break  # no later one has a larger bound
                if d not in held:
                    held[d] = (dict(zip(np.frombuffer(hashes[d], "<u8").tolist(), np.frombuffer(tfs[d], "<i4").tolist())),
                               8 * int(q.normal(int(n[d]))))
                tf, m = held[d]
                score = sum(q.weight[h] * ((UNIT * tf[h]) // (1000 * tf[h] + m)) for h in q.hashes[j] if h in tf)
                new = (-score, ids[d] is None, ids[d] if ids[d] is not None else 0)
                if score > 0 and (len(best) < q.k or new < best[-1]):
                    best.append(new)
                    best.sort()
                    del best[q.k:]


def _search(shared):
    """mapInArrow body: (query, doc_id, score) of the k best of this task."""
    def run(batches: Iterator[pa.RecordBatch]):
        queries = shared.value
        best, matrices, kind = _Best(queries), {}, None
        for b in batches:
            kind = b.column(0).type
            n, width = b.column(1).to_numpy(), b.column(2).to_numpy()
            for w in np.unique(width).tolist():
                if w not in matrices:
                    matrices = {k: m for k, m in matrices.items() if k < 4096}  # wide ones are rare and large
                    matrices[w] = queries.matrix(w)
                at = np.flatnonzero(width == w)
                step = max(1, BLOCK_CELLS // max(w, len(queries.ids)))
                for part in (at[i:i + step] for i in range(0, len(at), step)):
                    ids, hashes, tf, sketch = (b.column(c).take(pa.array(part)).to_pylist() for c in (0, 3, 4, 5))
                    table = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(part), w)
                    bounds = _impacts(table, queries.normal(n[part])) @ matrices[w]
                    best.rescore(ids, n[part], hashes, tf, bounds)
        rows = [(q, None if none else i, -s) for q, f in enumerate(best.found) for s, none, i in f]
        if rows:
            query, ids, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, kind), pa.array(score, pa.int64())],
                                             ["query", "doc_id", "score"])
    return run


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, distinct term hashes) of the queries that have a term."""
    block, n = [], 0
    for r in queries.toLocalIterator():
        hs = {term_hash(t) for t in terms((r["text"] or "").encode())}
        if not hs:
            continue
        if block and (n + len(hs) > QUERY_TERMS or len(block) >= QUERIES):
            yield block
            block, n = [], 0
        block.append((r["item_id"], hs))
        n += len(hs)
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring rows of
    ``docs`` with a score above 0 for each row of ``queries`` (all, if fewer),
    equal scores by ascending doc_id, null last.

    Scores: for each distinct term of the query that some document holds,
    floor(1000 ln((2N + 2) / (2 df + 1))) * ((10^9 tf) div (1000 tf + 8 m)),
    m = 10 + (90 n N) div L; N documents with a term, L terms in all, n of the
    document. Queries and documents without a term (null, empty, punctuation
    alone) are in no result and no count. Repeated rows of ``docs`` are ranked
    one by one, repeated rows of ``queries`` get results of their own. Texts of
    any length are read whole. Empty tables give an empty result; other columns
    are not read."""
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col)
    kind = index.schema["doc_id"].dataType.simpleString()
    q = pick(queries, item_id=item_col, text=item_text_col)
    item_kind = q.schema["item_id"].dataType.simpleString()
    total = index.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    results = []
    for block in _blocks(q) if total["documents"] else ():
        wanted = np.array(sorted({h for _, hs in block for h in hs}), dtype=np.uint64)
        shared = spark.sparkContext.broadcast(wanted)  # at most QUERY_TERMS, or one query's terms
        counted = (index.where("n > 0").select("hashes").mapInArrow(_frequencies(shared), "place int, df long")
                   .groupBy("place").agg(F.sum("df").alias("df")).collect())  # a row for each query term
        df = {int(wanted[r["place"]]): r["df"] for r in counted}
        held = spark.sparkContext.broadcast(Queries(block, df, total["documents"], total["length"], k))
        found = index.where("n > 0").mapInArrow(_search(held), f"query int, doc_id {kind}, score long")
        first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"query int, item_id {item_kind}")
        results.append(stored(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"),
                              "search-result"))
    if not results:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    out = results[0]
    for r in results[1:]:
        out = out.unionAll(r)
    return out
