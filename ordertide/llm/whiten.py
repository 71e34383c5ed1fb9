"""Embedding whitening from a bit-sliced scatter matrix.

Entries become whole numbers x = floor(scale * c) + offset. Each task slices
its rows: a dimension's numbers, shifted by the block's least one, become bit
planes, and each plane is packed across the rows into 64-bit words. The
product sum of two dimensions is the weighted sum of the set bits that their
planes share: sum over planes a, b of 2^(a+b) * popcount(A_a & B_b). Shifting
back is whole-number arithmetic, too, so the sums are exact whatever the
order of rows, tasks and blocks.

Tasks give the sums in limbs of 32 bits, which Spark adds up: at most
(dimensions + 1)^2 numbers in a few limbs reach the driver. There they are
centred as whole numbers, n * P_ij - S_i * S_j, before they become the
covariance whose eigenvectors (eigh) are the components. Rows are then
projected in a pass of their own; the covariance of what that gives is
measured, not assumed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.tables import pick, stored

LIMB = 32
#: Rows that are sliced at once (a multiple of 64), and words of one AND.
BLOCK_ROWS, AND_WORDS = 1 << 13, 1 << 20
#: Components whose variance is at most this share of the largest one have none.
NO_VARIANCE = 1e-13
#: Limbs of the exact deviation, and where 64-bit sums of their products end.
DIGIT, DIGITS_DIMS = 26, 2048
#: Entries beyond it, whose squares no double holds, count as not finite.
LARGEST = 1e150


def integers(e: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * c) of double entries; beyond 2^52 Python's whole numbers."""
    with np.errstate(over="ignore"):
        f = np.floor(e * float(scale))
    if not f.size or np.abs(f).max() < 2.0 ** 52:
        return f.astype(np.int64)
    return np.array([[math.floor(v) if math.isfinite(v) else int(c) * scale for v, c in zip(fr, er)]
                     for fr, er in zip(f, e.tolist())], dtype=object)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole numbers >= 0 (rows, dimensions): the packed planes (plane,
    word) that are not empty, each one's dimension and its bit."""
    n, dims = y.shape
    words, dim, bit = [], [], []
    for d in range(dims):
        column = y[:, d]
        top = int(column.max())
        for b in range(top.bit_length()):
            plane = ((column >> b) & 1).astype(bool)
            if plane.any():
                packed = np.packbits(plane, bitorder="little")
                words.append(np.pad(packed, (0, -len(packed) % 8)).view("<u8"))
                dim.append(d)
                bit.append(b)
    return (np.array(words, dtype=np.uint64).reshape(len(words), -(-n // 64)), np.array(dim, dtype=np.int64),
            np.array(bit, dtype=np.int64))


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact sums over rows of y_i * y_j, as whole numbers of any size."""
    dims = y.shape[1]
    planes, dim, bit = bit_planes(y)
    wide = len(bit) and 2 * int(bit.max()) + 2 + len(y).bit_length() > 62
    sums = np.zeros((dims, dims), dtype=object if wide else np.int64)
    step = max(1, AND_WORDS // max(1, planes.size))
    for at in range(0, len(planes), step):
        rows = planes[at:at + step]
        shared = np.bitwise_count(rows[:, None, :] & planes[None, :, :]).sum(axis=2, dtype=np.int64)
        i, j = np.broadcast_arrays(dim[at:at + step, None], dim[None, :])
        power = bit[at:at + step, None] + bit[None, :]
        if wide:
            shared = shared.astype(object)
            power = power.astype(object)
        np.add.at(sums, (i.ravel(), j.ravel()), (shared << power).ravel())
    return sums.astype(object)


def _limbs(i: int, j: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    sign, value, k = (1 if value >= 0 else -1), abs(value), 0
    while value:
        yield i, j, k, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        k += 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scatter(scale: int):
    """mapInArrow body: (i, j, limb, value) of this task's sums of x_i * x_j
    (i <= j), of x_j (i = -1) and of rows (i = j = -1), without the offset."""
    def run(batches: Iterator[pa.RecordBatch]):
        n, total, products = 0, None, None
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.column(0).slice(at, BLOCK_ROWS)
                if not len(part):
                    continue
                x = integers(_matrix(part), scale)
                least = x.min(axis=0)
                y = x - least
                low, s, m = least.astype(object), y.sum(axis=0).astype(object), len(x)
                p = cross_products(y) + np.outer(low, s) + np.outer(s, low) + m * np.outer(low, low)
                n, total = n + m, (s + m * low if total is None else total + s + m * low)
                products = p if products is None else products + p
        if n:
            dims = len(total)
            rows = [*_limbs(-1, -1, n), *(r for j in range(dims) for r in _limbs(-1, j, int(total[j]))),
                    *(r for i in range(dims) for j in range(i, dims) for r in _limbs(i, j, int(products[i, j])))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["i", "j", "limb", "value"])
    return run


class Fit:
    """The fit list's exact sums and the components of its covariance."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, components: int, scale: int, offset: int):
        self.n, self.sums, self.scale, self.offset = n, sums, scale, offset
        s = np.array(sums, dtype=object)
        centred = n * products - np.outer(s, s)
        # whole numbers divide to the nearest double
        self.covariance = np.array([[v / (n * n) for v in row] for row in centred.tolist()], dtype=np.float64)
        e, v = np.linalg.eigh(self.covariance)
        order = np.argsort(-e, kind="stable")[:components]
        self.values = np.maximum(e[order], 0.0)
        # one sign for all rows and runs: a component's largest entry is positive
        v = v[:, order]
        self.vectors = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        trace = float(np.trace(self.covariance))
        self.varies = self.values > NO_VARIANCE * max(float(self.values.max(initial=0.0)), 0.0)
        self.explained = [float(x) / trace if trace > 0 else None for x in self.values]


def fit(vectors: DataFrame, components: int, scale: int, offset: int) -> Fit | None:
    """The fit of all rows of ``vectors`` (embedding); None without a row."""
    parts = (vectors.select("embedding").mapInArrow(_scatter(scale), "i int, j int, limb int, value long")
             .groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect())  # (dimensions + 1)^2 / 2 sums
    sums: dict[tuple[int, int], int] = {}
    for r in parts:
        sums[r["i"], r["j"]] = sums.get((r["i"], r["j"]), 0) + (r["value"] << (LIMB * r["limb"]))
    n = sums.get((-1, -1), 0)
    if not n:
        return None
    dims = vectors.select(F.size("embedding").alias("d")).first()["d"]
    total = [sums.get((-1, j), 0) for j in range(dims)]
    products = np.zeros((dims, dims), dtype=object)
    for (i, j), v in sums.items():
        if i >= 0:
            products[i, j] = products[j, i] = v
    # the offset adds to each x: exact, too
    t = np.array(total, dtype=object)
    products = products + offset * (t[:, None] + t[None, :]) + n * offset * offset
    return Fit(n, [s + n * offset for s in total], products, components, scale, offset)


def _deviations(x: np.ndarray, model: Fit) -> tuple[np.ndarray, list[int]]:
    """x - S / n in doubles, and the exact sums of (n x - S)^2."""
    n, s = model.n, np.array(model.sums, dtype=object)
    q, r = s // n - model.offset, s % n
    small = x.dtype != object and max(map(abs, q.tolist()), default=0) < 1 << 52
    z = x - q.astype(np.int64) if small else x.astype(object) - q  # x near its mean
    most = int(np.abs(z).max(initial=0)) * n + n
    if z.dtype == object or most >= 1 << (2 * DIGIT) or z.shape[1] > DIGITS_DIMS:
        d = n * z.astype(object) - r
        return (d / n).astype(np.float64), [int(v) for v in (d * d).sum(axis=1)]
    d = n * z.astype(np.int64) - r.astype(np.int64)
    a = np.abs(d)
    low, high = a & ((1 << DIGIT) - 1), a >> DIGIT
    exact = [int(u) + (int(v) << (DIGIT + 1)) + (int(w) << (2 * DIGIT)) for u, v, w in
             zip((low * low).sum(axis=1), (low * high).sum(axis=1), (high * high).sum(axis=1))]
    return d / n, exact


def _project(shared):
    """mapInArrow body: (vec_id, deviation in two limbs, whitened)."""
    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        roots = np.sqrt(np.where(model.varies, model.values, 1.0))
        for b in batches:
            if not b.num_rows:
                continue
            centred, exact = _deviations(integers(_matrix(b.column(1)), model.scale), model)
            w = centred @ model.vectors / roots
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([str(v) for v in exact], pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))],
                ["vec_id", "deviation", "whitened"])
    return run


def _usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` and component: vec_id, component
    (from 1, by falling variance), n, deviation (decimal(38,0): the exact sum
    over dimensions of (n x - S)^2, null beyond 38 digits), whitened, explained
    (its share of the variance) and identity_error (one value: the largest
    absolute entry of the whitened rows' covariance minus the identity).

    Null and empty vectors, and those with null or non-finite entries, are
    dropped (entries beyond 1e150 count as such); so are vectors of another length than the most frequent one (of
    equally frequent ones the longest). Repeated rows and null ids are rows
    like others and count in the fit. A component without variance (equal
    rows, one row, fewer dimensions than ``components``) has whitened null and
    no part in identity_error; without any variance explained and
    identity_error are null. Empty tables give an empty result; other columns
    are not read."""
    v = pick(vectors, vec_id=id_col, embedding=vector_col)
    v = v.where(_usable(F.col("embedding"))).withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = v.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = (v.groupBy(F.size("embedding").alias("d")).count()
               .agg(F.max(F.struct("count", "d")).alias("m")).first()["m"])
    if lengths is None:
        return v.sparkSession.createDataFrame([], schema)
    v = v.where(F.size("embedding") == lengths["d"])
    model = fit(v, components, scale, offset)
    shared = v.sparkSession.sparkContext.broadcast(model)  # dimensions x components, whatever the rows
    rows = stored(v.mapInArrow(_project(shared), f"vec_id {kind}, deviation string, whitened array<double>"), "whitened")
    live = [i for i in range(len(model.values)) if model.varies[i]]
    error = None
    if live:
        w = [F.col("whitened")[i] for i in live]
        pairs = [(a, b) for a in range(len(live)) for b in range(a, len(live))]
        sums = rows.agg(*[F.avg(c).alias(f"m{a}") for a, c in enumerate(w)],
                        *[F.avg(w[a] * w[b]).alias(f"p{a}_{b}") for a, b in pairs]).first()
        error = max(abs(sums[f"p{a}_{b}"] - sums[f"m{a}"] * sums[f"m{b}"] - (a == b)) for a, b in pairs)
    facts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(bool(model.varies[i])).alias("varies"),
                               F.lit(model.explained[i]).cast("double").alias("explained"))
                      for i in range(len(model.values))])
    out = rows.select("vec_id", "deviation", "whitened", F.explode(facts).alias("c"))
    return out.select(
        "vec_id", F.col("c.component").alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        F.when(F.col("c.varies"), F.get("whitened", F.col("c.component") - 1)).alias("whitened"),
        F.col("c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
