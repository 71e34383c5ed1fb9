"""Embedding near-duplicates with a forest of random-projection trees.

Equal vectors of a label collapse to one class with a multiplicity. Trees are
grown per label on a bounded sample: a node projects on a random direction and
cuts near the middle where the fewest vectors lie; vectors within the spill
margin of the cut go to both sides. The margin follows from the similarity:
unit vectors with cosine c differ by sqrt(2 - 2c), and by about that over
sqrt(dimension) along a random direction. It shrinks from level to level, so
that a tree copies a vector a few times however deep it is (a constant margin
copies it a power of the rows); in return deeper forests have more trees, as
many as find ``recall`` of the pairs at the threshold if vectors point
everywhere alike. A node whose vectors would mostly spill (a dense group of
near copies) is not cut any further.

All classes descend all trees; within a leaf every pair is compared by cosine
in double precision. A pair that meets in several leaves counts in the first
of them only: each vector carries the list of its leaves. A leaf gives a
count per vector and a star of edges per linked group, never its pairs. Leaves
above a block's size are dealt in blocks, one task per pair of blocks, so no
group is collected whole.

The forest is bounded by its sample. Where the sample ends before leaves are
small enough, further levels cut at the label's medians along directions that
depend on tree and level alone, so nothing that is sent grows with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.components import connected_components
from ordertide.llm.tables import pick, stored

MIN_SAMPLE = 32
#: A direction is refused if more than this share of a node's sample would spill.
MAX_SPILL = 0.5
TRIES = 8
MIN_TREES = 3


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (any finite non-zero rows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _direction(dim: int, *key: int) -> np.ndarray:
    d = np.random.default_rng(key).standard_normal(dim)
    return d / np.linalg.norm(d)


def trees_for(rows: int, leaf_rows: int, threshold: float, spill: float, decay: float, recall: float) -> int:
    """Trees that leave at most 1 - ``recall`` of the pairs at the threshold
    without a common leaf, for vectors that point everywhere alike: a cut at the
    middle parts a pair if its difference spans the margin on both sides."""
    spread, together, margin = math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(2 * math.pi), 1.0, spill
    while rows > leaf_rows and together > 1e-3:
        beyond = math.exp(-2 * margin ** 2) / math.sqrt(2 * math.pi) - margin * math.erfc(math.sqrt(2) * margin)
        together *= 1 - 2 * spread * beyond
        rows *= 0.5 + spread * margin
        margin *= decay
    if together > 1 - 1e-9:
        return MIN_TREES
    return max(MIN_TREES, math.ceil(math.log(1 - recall) / math.log(1 - together)))


class Tree:
    """One random-projection tree over one label's sample."""

    def __init__(self, sample: np.ndarray, population: int, tree: int, leaf_rows: int, margin: float, decay: float, seed: int):
        self.tree, self.margin, self.decay, self.seed, self.dim = tree, margin, decay, seed, sample.shape[1]
        self.leaf_rows, self.per_row = leaf_rows, population / len(sample)
        self.medians: list[float] = []
        for level in range(64):
            self.medians.append(float(np.median(sample @ self._level(level))))
        self.nodes: list[tuple] = []
        self._grow(sample, margin)

    def _level(self, level: int) -> np.ndarray:
        return _direction(self.dim, self.seed, self.tree, 1, level)

    def _grow(self, s: np.ndarray, margin: float) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        rows = len(s) * self.per_row
        if rows <= self.leaf_rows:
            self.nodes[at] = (0,)
        elif len(s) < 2 * MIN_SAMPLE:
            self.nodes[at] = (math.ceil(math.log2(rows / self.leaf_rows)),)
        elif (found := self._cut(s, at, margin)) is None:
            self.nodes[at] = (0,)
        else:
            attempt, cut = found
            p = s @ _direction(self.dim, self.seed, self.tree, 0, at, attempt)
            left = self._grow(s[p < cut + margin], margin * self.decay)
            right = self._grow(s[p > cut - margin], margin * self.decay)
            self.nodes[at] = (attempt, cut, left, right)
        return at

    def _cut(self, s: np.ndarray, at: int, margin: float) -> tuple[int, float] | None:
        best = None
        for attempt in range(TRIES):
            p = np.sort(s @ _direction(self.dim, self.seed, self.tree, 0, at, attempt))
            for cut in p[(np.linspace(0.35, 0.65, 13) * (len(p) - 1)).astype(int)]:
                spill = (np.searchsorted(p, cut + margin) - np.searchsorted(p, cut - margin, "right")) / len(p)
                if best is None or spill < best[0]:
                    best = (spill, attempt, float(cut))
        return best[1:] if best[0] <= MAX_SPILL else None

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf code) of every leaf that the rows of ``x`` fall in. A code
        is 31 bits of a hash: leaves that share one are compared as one."""
        rows, codes = [], []

        def emit(at: np.ndarray, *path: int) -> None:
            code = xxhash.xxh64_intdigest(np.array(path, dtype=np.int64).tobytes(), self.tree) >> 33
            rows.append(at)
            codes.append(np.full(len(at), code, dtype=np.int32))

        def further(at: np.ndarray, levels: int, margin: float, *path: int) -> None:
            if not levels or not len(at):
                if len(at):
                    emit(at, *path)
                return
            p, cut = x[at] @ self._level(levels), self.medians[levels]
            further(at[p < cut + margin], levels - 1, margin * self.decay, *path, 0)
            further(at[p > cut - margin], levels - 1, margin * self.decay, *path, 1)

        stack = [(0, np.arange(len(x)), self.margin)]
        while stack:
            node, at, margin = stack.pop()
            if not len(at):
                continue
            if len(self.nodes[node]) == 1:
                further(at, self.nodes[node][0], margin, node)
                continue
            attempt, cut, left, right = self.nodes[node]
            p = x[at] @ _direction(self.dim, self.seed, self.tree, 0, node, attempt)
            stack += [(left, at[p < cut + margin], margin * self.decay), (right, at[p > cut - margin], margin * self.decay)]
        return np.concatenate(rows), np.concatenate(codes)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def _route(shared):
    """mapInArrow body: the classes with ``codes``, their distinct leaf codes
    in rising order."""
    def run(batches):
        forest = shared.value
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            groups = np.array([f"{a}/{d}" for a, d in zip(get("label").to_pylist(), get("dim").to_pylist())])
            codes: list[np.ndarray] = [np.zeros(1, dtype=np.int32)] * len(groups)
            for g in np.unique(groups) if len(groups) else []:
                if str(g) not in forest:
                    continue
                at = np.flatnonzero(groups == g)
                x = unit(_matrix(get("embedding").take(pa.array(at))))
                found = [t.leaves(x) for t in forest[str(g)]]
                row, code = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(code) != 0)])
                row, code = row[new], code[new]
                for i, part in enumerate(np.split(code, np.flatnonzero(np.diff(row)) + 1)):
                    codes[at[i]] = part
            flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*b.schema.names, "codes"])
    return run


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    lengths = np.diff(c.offsets.to_numpy())
    out = np.full((len(c), int(lengths.max())), np.iinfo(np.int32).max, dtype=np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = c.flatten().to_numpy()
    return out


def _met_before(codes: np.ndarray, i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Which pairs share a leaf with a lesser code than ``leaf``."""
    out = np.zeros(len(i), dtype=bool)
    for a in range(codes.shape[1]):
        own = codes[i, a]
        live = np.flatnonzero((own < leaf) & ~out)
        if not len(live):
            continue
        for b in range(codes.shape[1]):
            out[live] |= own[live] == codes[j[live], b]
    return out


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row reachable over the pairs from each of n rows."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float, step: int = 1024):
    """applyInArrow body for a pair of blocks of one leaf: for each class with
    links that count here, their number of vectors and its group's first.
    Products in single precision decide what lies clear of the threshold by
    more than their rounding; the pairs between are multiplied in double."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leaf, lo, hi = (k.as_py() for k in key[-3:])
        cid = table["cid"].to_numpy()
        order = np.argsort(cid)
        table, cid = table.take(pa.array(order)), cid[order]
        weight, block = table["members"].to_numpy(), table["block"].to_numpy()
        x, codes = unit(_matrix(table["embedding"])), _padded(table["codes"])
        narrow, slack = x.astype(np.float32), 4 * x.shape[1] * float(np.finfo(np.float32).eps)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        count = np.zeros(len(cid), dtype=np.int64)
        pairs = []
        for a in range(0, len(left), step):
            for b in range(0, len(right), step):
                ra, rb = left[a:a + step], right[b:b + step]
                near = narrow[ra] @ narrow[rb].T
                i, j = np.nonzero(near >= threshold - slack)
                open_ = near[i, j] < threshold + slack
                i, j = ra[i], rb[j]
                ok = ~open_
                ok[open_] = np.einsum("ij,ij->i", x[i[open_]], x[j[open_]]) >= threshold
                i, j = i[ok], j[ok]
                if lo == hi:
                    i, j = i[i < j], j[i < j]
                new = ~_met_before(codes, i, j, leaf)
                i, j = i[new], j[new]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                if len(i):  # keep what connects, not every pair
                    star = _stars(len(cid), i, j)
                    tied = np.flatnonzero(star != np.arange(len(cid)))
                    pairs.append((tied, star[tied]))
        if not pairs:
            return pa.table({"cid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()),
                             "root": pa.array([], pa.int64())})
        star = _stars(len(cid), *(np.concatenate(c) for c in zip(*pairs)))
        at = np.flatnonzero(count)
        return pa.table({"cid": cid[at], "links": count[at], "root": cid[star[at]]})
    return run


def _usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda v: v != 0)


def fit_forest(classes: DataFrame, trees: int | None, sample_rows: int, leaf_rows: int, threshold: float, spill: float,
               decay: float, recall: float, seed: int) -> dict[str, list[Tree]]:
    """Trees by "label/dimension", for labels with over ``leaf_rows`` classes,
    from at most ``sample_rows`` classes."""
    sample = (classes.orderBy(F.xxhash64("cid", F.lit(seed)), "cid").limit(sample_rows)
              .select("cid", "label", "dim", "embedding").toArrow())
    names = np.array([f"{a}/{d}" for a, d in zip(sample["label"].to_pylist(), sample["dim"].to_pylist())])
    present = sorted({(a, d) for a, d in zip(sample["label"].to_pylist(), sample["dim"].to_pylist())}, key=str)
    if not present:
        return {}
    here = classes.sparkSession.createDataFrame(present, classes.select("label", "dim").schema)
    counts = (classes.join(F.broadcast(here), ["label", "dim"]).groupBy("label", "dim").count()
              .where(F.col("count") > leaf_rows).collect())  # at most sample_rows rows
    out = {}
    for label, dim, n in sorted(counts, key=str):
        at = np.flatnonzero(names == f"{label}/{dim}")
        at = at[np.argsort(sample["cid"].to_numpy()[at])]
        x = unit(_matrix(sample["embedding"].take(pa.array(at))))
        margin = spill * math.sqrt(max(0.0, 2 - 2 * threshold) / dim)
        own = trees or trees_for(n, leaf_rows, threshold, spill, decay, recall)
        out[f"{label}/{dim}"] = [Tree(x, n, t, leaf_rows, margin, decay, seed) for t in range(own)]
    return out


def link(vectors: DataFrame, threshold: float = 0.93, trees: int | None = None, leaf_rows: int = 2048, spill: float = 1.0,
         decay: float = 0.75, recall: float = 0.99, sample_rows: int = 20_000, block_rows: int = 4096, seed: int = 42, id_col: str = "vec_id",
         vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other rows linked
    directly), component_id (smallest vec_id reachable, itself included).

    Rows link if their labels are equal and not null and their cosine is at
    least ``threshold``; vectors of unlike lengths don't. Null, empty and zero
    vectors, and those with null or non-finite components, link with nothing,
    equal ones neither. Repeated rows are rows of their own that link with
    each other. Null ids count as links, never as a component's id unless all
    are null. Empty tables give empty results; other columns are not read.

    ``trees``: per label; by default as many as ``recall`` asks for at the
    label's size (``trees_for``). The spill margin starts at ``spill``
    deviations of a linked pair and shrinks by ``decay`` a level."""
    v = pick(vectors, vec_id=id_col, embedding=vector_col, label=label_col)
    usable = F.col("label").isNotNull() & _usable(F.col("embedding"))
    # two 64-bit hashes stand for an equal vector; 0.0 + 0.0 and -0.0 + 0.0 are one
    same = F.transform("embedding", lambda c: c + F.lit(0.0).cast("float"))
    rows = stored(v.select("vec_id", "label", F.when(usable, F.col("embedding")).alias("embedding"),
                           F.when(usable, F.xxhash64(same)).alias("h1"),
                           F.when(usable, F.xxhash64(F.lit(1), same)).alias("h2")), "forest-rows")
    grouped = rows.where("h1 is not null").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("members"), F.first("embedding").alias("embedding"))
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id())
                     .withColumn("dim", F.size("embedding")), "forest-classes")
    forest = fit_forest(classes, trees, sample_rows, leaf_rows, threshold, spill, decay, recall, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # bounded by sample_rows
    routed = classes.select("cid", "label", "members", "embedding", "dim")
    schema = ", ".join([*[f"{c} {t}" for c, t in routed.dtypes], "codes array<int>"])
    codes = stored(routed.mapInArrow(_route(shared), schema), "forest-codes")
    placed = codes.withColumn("leaf", F.explode("codes"))
    large = (codes.select("label", "dim", F.explode("codes").alias("leaf"))
             .groupBy("label", "dim", "leaf").count().where(F.col("count") > block_rows)
             .select("label", "dim", "leaf", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    placed = placed.join(stored(large, "forest-large"), ["label", "dim", "leaf"], "left")
    n = F.coalesce("blocks", F.lit(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), n).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    placed = placed.select("label", "dim", "leaf", F.least("block", "other").alias("lo"),
                           F.greatest("block", "other").alias("hi"), "block", "cid", "members", "embedding", "codes")
    compared = stored(placed.groupBy("label", "dim", "leaf", "lo", "hi").applyInArrow(
        _compare(threshold), "cid long, links long, root long"), "forest-links")
    links = compared.groupBy("cid").agg(F.sum("links").alias("links"))
    members = connected_components(compared.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    firsts = members.join(classes, F.col("v") == F.col("cid")).groupBy("root").agg(F.min("first_id").alias("component_id"))
    tied = members.join(firsts, "root").select(F.col("v").alias("cid"), "component_id")
    by_class = stored(
        classes.join(links, "cid", "left").join(tied, "cid", "left").select(
            F.col("label").alias("c_label"), F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"),
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component_id", "first_id").alias("component_id")), "forest-result")
    matches = (F.col("label") == F.col("c_label")) & (F.col("h1") == F.col("c_h1")) & (F.col("h2") == F.col("c_h2"))
    out = rows.select("vec_id", "label", "h1", "h2").join(by_class, matches, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
