"""Random regression forest of unlimited depth, grown level by level.

Every tree sees the training rows with Poisson(1) weights, drawn from a hash of
the row's key, the tree and a seed, so a bootstrap is an expression and can be
drawn again. A split is the best over all columns: numbers are cut between two
values; the levels of a categorical column are ordered by their mean label in
the node and cut like numbers, which finds the best of all subsets of levels
for squared error (Fisher 1958) with one sorted scan of level sums. A column of
thousands of levels costs as many sums and no one-hot columns.

Where no tree has over ``local_rows`` training rows, the rows are coded and
packed once into arrays that each task of trees reads: it draws its trees'
rows, grows them and leaves sums of what they predict, so no row is shuffled
per tree.

Else large nodes (over ``local_rows`` training rows) are split by Spark: one
aggregation of (tree, node, column, value) sums with map-side combine, running
sums over a node's ordered values, the best cut per node, and a join that sends
the rows on. The table of sums is bounded by nodes x distinct values, numbers
being binned there; one column's values of one node meet in one task, so a
column of very many levels wants hashing into fewer first. Nodes that are small enough are dealt by (tree, node) and
finished in one task each, all nodes of a level at a time in numpy, on exact
values. No model is gathered: test rows travel with the training rows to their
leaves, so predictions and importances are all that leaves a task, and neither
the driver nor a broadcast holds anything that grows with the rows. Trees are
grown in batches, which bounds what a pass writes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.operators.joins import computed_once, join_small

#: Training rows of a node that one task finishes, bins of a number in larger nodes, (row, tree) pairs of a batch.
LOCAL_ROWS, BINS, BATCH_ROWS = 1 << 21, 256, 1 << 28
#: Trees of a task over packed rows, test rows whose predictions are one value of its output, bytes of a piece of a packed array (a multiple of 8).
TREES_A_TASK, CHUNK_ROWS, PIECE_BYTES = 2, 1 << 14, 1 << 22
#: A gain counts if it is more than this share of the node's squared error.
LEAST_GAIN = 1e-12
#: Training rows of a level's block; a table of nodes by values has at most so many cells a row.
BLOCK_ROWS, DENSE_CELLS = 1 << 17, 4
POISSON_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)]).tolist()


def bootstrap_weight(key: Column, tree: Column, seed: int) -> Column:
    """Poisson(1) weight of a row in a tree, from a hash."""
    u = F.shiftrightunsigned(F.xxhash64(key, tree, F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = F.lit(0)
    for p in POISSON_CDF:
        out = out + (u >= F.lit(p)).cast("int")
    return out


def _xxhash64(seed, value: np.ndarray, long: bool) -> np.ndarray:
    """Spark's xxhash64 of a long or an int column after ``seed``, the hash of the columns before it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, n):
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        if long:
            h = seed + p5 + np.uint64(8)
            h = turned(h ^ (turned(value * p2, 31) * p1), 27) * p1 + p4
        else:
            h = seed + p5 + np.uint64(4)
            h = turned(h ^ (value * p1), 23) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def drawn_weights(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """``bootstrap_weight`` of an array of long keys."""
    h = _xxhash64(np.uint64(42), key.view(np.uint64), True)
    for x in (tree, seed):
        h = _xxhash64(h, np.array([x & 0xFFFFFFFF], np.uint64), False)
    return np.searchsorted(POISSON_CDF, (h >> np.uint64(11)).astype(np.float64) / float(1 << 53), "right")


def _code_type(levels: int) -> type:
    return np.uint8 if levels <= 1 << 8 else np.uint16 if levels <= 1 << 16 else np.int32


class LocalTree:
    """A tree over rows in memory, grown level by level for many nodes at once.
    ``columns``: arrays of numbers, or of category codes where ``categorical``;
    rows of weight 0 take no part but find their leaf (``value``); weights are
    whole numbers. Nodes of more than ``BLOCK_ROWS`` training rows in all go on
    in separate blocks, which bounds what a level needs.

    Rows lie in the order of their node and, within it, of the widest column,
    which a stable partition keeps, so that column's sums are those of runs.
    The others' are counted in a table of nodes by values, or sorted where that
    is too large; a column whose level another one's decides (a state its
    region, a product its brand) adds up that one's sums instead of rows. A
    row's 1 and its weight are one number, so one sum gives both."""

    def __init__(self, columns: Iterable[np.ndarray], categorical: list[bool], y: np.ndarray, w: np.ndarray, min_leaf: int,
                 max_depth: int | None = None):
        values, codes = zip(*(np.unique(c, return_inverse=True) for c in columns))
        codes = [c.astype(_code_type(len(v))) for v, c in zip(values, codes)]
        train, test = np.flatnonzero(w > 0), np.flatnonzero(w == 0)
        self._grow(values, categorical, [c[train] for c in codes], y[train], w[train],
                   np.stack([c[test] for c in codes], axis=1).astype(np.int32), min_leaf, max_depth)
        self.value = np.zeros(len(y))
        self.value[test] = self.leaves

    @classmethod
    def of_codes(cls, values: Sequence[np.ndarray], categorical: list[bool], codes: list[np.ndarray], y: np.ndarray, w: np.ndarray,
                 tests: np.ndarray, min_leaf: int, max_depth: int | None = None) -> LocalTree:
        """The tree of training rows whose columns are places in ``values``
        (each column's distinct values in order); ``leaves`` are the leaf means
        of ``tests``, which has a row of such places each."""
        tree = cls.__new__(cls)
        tree._grow(values, categorical, codes, y, w, tests, min_leaf, max_depth)
        return tree

    def _grow(self, values, categorical, codes, y, w, tests, min_leaf, max_depth) -> None:
        self.values, self.categorical, self.min_leaf = values, categorical, min_leaf
        self.widest = max(range(len(values)), key=lambda c: len(values[c]))
        if (codes[self.widest][1:] < codes[self.widest][:-1]).any():
            order = np.argsort(codes[self.widest], kind="stable")
            codes, y, w = [c[order] for c in codes], y[order], w[order]
        self._relate(codes)
        # against a centre, for the sums' last digits
        centre = float((w * y).sum() / w.sum())
        self.sse = float((w * (y - centre) ** 2).sum())
        self.unit = 2.0 ** int(w.sum()).bit_length()  # above any weight: a sum of rows * unit + weight is exact
        self.gains, self.leaves = np.zeros(len(values)), np.zeros(len(tests))
        work = [([None if d else c for c, d in zip(codes, self.decider)], self.unit + w, w * (y - centre), np.array([len(y)]),
                 tests, np.arange(len(tests)), np.arange(len(tests)), np.zeros(len(tests), np.int64), 0)]
        while work:
            *rows, depth = work.pop()
            grown = self._level(*rows, max_depth is not None and depth >= max_depth)
            work += [(*block, depth + 1) for block in self._blocks(*grown)]
        self.leaves += centre

    def _relate(self, codes: list[np.ndarray]) -> None:
        """``decider``: for a column the narrowest one among the wider whose
        levels have one level of it each, and that level; ``base``: the column
        that the rows carry for it, and the levels by its."""
        self.order = sorted(range(len(codes)), key=lambda c: (-len(self.values[c]), c))
        self.decider: list = [None] * len(codes)
        self.base = [(c, None) for c in range(len(codes))]
        few = slice(None, None, max(1, len(codes[0]) >> 12))
        for i, c in enumerate(self.order):
            for a in reversed(self.order[:i]):
                level = np.zeros(len(self.values[a]), codes[c].dtype)
                for x in (few, slice(None)):
                    level[codes[a][x]] = codes[c][x]
                    if (level[codes[a][x]] != codes[c][x]).any():
                        break
                else:
                    carried, levels = self.base[a]
                    self.decider[c], self.base[c] = (a, level), (carried, level if levels is None else level[levels])
                    break

    def _blocks(self, cols, p, wy, size, tests, ids, s, sn) -> list[tuple]:
        """The nodes in blocks of about ``BLOCK_ROWS`` training rows, each with
        its own rows' values, which a processor's cache holds."""
        if len(p) <= BLOCK_ROWS or len(size) == 1:
            return [(cols, p, wy, size, tests, ids, s, sn)] if len(p) else []
        end = np.cumsum(size)
        first = np.flatnonzero(np.diff((end - size) // BLOCK_ROWS, prepend=-1))
        out = []
        for i, j in zip(first, [*first[1:], len(size)]):
            rows, own = slice(end[i] - size[i], end[j - 1]), slice(*np.searchsorted(sn, [i, j]))
            out.append(([None if c is None else c[rows] for c in cols], p[rows], wy[rows], size[i:j],
                        tests[s[own]], ids[s[own]], np.arange(own.stop - own.start), sn[own] - i))
        return out

    def _level(self, cols, p, wy, size, tests, ids, s, sn, last: bool) -> tuple:
        """Split the nodes, whose training rows lie one node behind the other,
        ``size`` of each, with the values ``cols``, the 1s and weights ``p`` and
        the weighted labels ``wy``; the test rows ``s`` of ``tests`` are in the
        nodes ``sn``, in their order. What goes on, in the same form."""
        start = np.cumsum(size) - size
        weight, total = np.add.reduceat(p, start) - size * self.unit, np.add.reduceat(wy, start)
        open_ = (size >= 2 * self.min_leaf) & (not last)
        s, sn = self._go_on(ids, s, sn, open_, total / weight)
        if not open_.all():
            rows = np.flatnonzero(np.repeat(open_, size))
            cols, p, wy = [None if c is None else c[rows] for c in cols], p[rows], wy[rows]
            size, weight, total = size[open_], weight[open_], total[open_]
        k = len(size)
        if not k:
            return cols, p, wy, size, tests, ids, s, sn
        node = np.repeat(np.arange(k), size)
        cells: list = [None] * len(cols)
        for c in self.order:
            cells[c] = self._cells(c, cells, cols, p, wy, size, node)
        best, column = np.full(k, -np.inf), np.full(k, -1)
        finish = []
        for c in range(len(cols)):
            top, finish_c = self._scan(c, *cells[c], weight, total, size)
            better = top > best + LEAST_GAIN * self.sse
            best[better], column[better] = top[better], c
            finish.append(finish_c)
        split = (column >= 0) & (best > LEAST_GAIN * self.sse)
        np.add.at(self.gains, column[split], best[split])
        s, sn = self._go_on(ids, s, sn, split, total / weight)
        column[~split] = -1
        number = np.cumsum(split) - 1
        of_row, of_test, old = column.astype(np.int8)[node], column[split].astype(np.int8)[sn], np.flatnonzero(split)
        left, test_left, n_left = np.zeros(len(p), bool), np.zeros(len(s), bool), np.zeros(len(old), np.int64)
        for c in np.unique(column[split]):
            rows, at, taken = np.flatnonzero(of_row == c), np.flatnonzero(of_test == c), column == c
            n_left[number[taken]], left[rows], test_left[at] = finish[c](taken, rows, node, cols, old[sn[at]], tests[s[at], c])
        go = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left & (of_row >= 0))])
        stay = np.flatnonzero(~test_left)
        to = np.flatnonzero(test_left)
        return ([None if c is None else c[go] for c in cols], p[go], wy[go], np.concatenate([n_left, size[split] - n_left]),
                tests, ids, s[np.concatenate([to, stay])], np.concatenate([sn[to], sn[stay] + len(old)]))

    def _go_on(self, ids, s, sn, those: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The test rows of ``those`` nodes, numbered anew; the others get their leaf's ``mean``."""
        if those.all():
            return s, sn
        on = those[sn]
        self.leaves[ids[s[~on]]] = mean[sn[~on]]
        return s[on], (np.cumsum(those) - 1)[sn[on]]

    def _cells(self, c: int, cells: list, cols, p, wy, size, node) -> tuple[np.ndarray, ...]:
        """The pairs of nodes and values of column ``c`` that there are, in
        order: their node and value, packed weights and summed labels, and of
        the widest column the pair of each row."""
        n, k = len(self.values[c]), len(size)
        if c == self.widest:
            new = np.ones(len(p), bool)
            np.not_equal(cols[c][1:], cols[c][:-1], out=new[1:])
            new[np.cumsum(size)[:-1]] = True
            at = np.flatnonzero(new)
            return node[at], cols[c][at], np.add.reduceat(p, at), np.add.reduceat(wy, at), np.diff(at, append=len(p))
        if self.decider[c]:
            a, level = self.decider[c]
            owner, code, p, wy = cells[a][:4]
            code = level[code]
        else:
            owner, code = node, cols[c]
        cell = owner * n
        cell += code
        if k * n <= DENSE_CELLS * len(cell):
            p = np.bincount(cell, p, k * n)
            at = np.flatnonzero(p)
            p, wy = p[at], np.bincount(cell, wy, k * n)[at]
        else:
            order = np.argsort(cell)
            cell = cell[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            p, wy, at = np.add.reduceat(p[order], first), np.add.reduceat(wy[order], first), cell[first]
        owner = at // n
        return owner, at - owner * n, p, wy, None

    def _scan(self, c: int, owner, code, p, wy, runs, weight, total, rows) -> tuple:
        """Each node's best gain by column ``c``, and what finds the sides of the nodes that take it."""
        n, k = len(self.values[c]), len(rows)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        order = None
        if self.categorical[c]:
            order = _by_mean(owner, wy / (p - np.floor(p / self.unit) * self.unit), k)
            p, wy = p[order], wy[order]
        size = np.diff(first, append=len(owner))
        lp, ly = np.cumsum(p), np.cumsum(wy)
        lp -= np.repeat(lp[first] - p[first], size)
        ly -= np.repeat(ly[first] - wy[first], size)
        ln = np.floor(lp / self.unit)
        lw = lp - ln * self.unit
        rn, rw, ry = rows[owner] - ln, weight[owner] - lw, total[owner] - ly
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ly ** 2 / lw + ry ** 2 / rw - (total ** 2 / weight)[owner]
        gain[(ln < self.min_leaf) | (rn < self.min_leaf)] = -np.inf
        top = np.maximum.reduceat(gain, first)

        def finish(taken, train, node, cols, test_node, test_code):
            """The training rows on the left of each ``taken`` node, and whether
            those among the rows ``train`` and the test rows go there."""
            own = np.flatnonzero(taken[owner])
            equal = own[gain[own] == top[owner[own]]]
            where = np.zeros(k, np.int64)
            where[owner[equal[::-1]]] = equal[::-1]  # the first
            cut = where[taken]
            left = np.empty(len(own), bool)
            number = np.cumsum(taken) - 1
            to_left = own <= where[owner[own]]
            if order is None:
                left = to_left
            else:  # the pairs of a node are the same ones in another order
                inside = np.zeros(len(owner), bool)
                inside[order[own[to_left]]] = True
                left = inside[own]
            want = None
            if runs is not None:
                train_left = np.repeat(left, runs[own])
            else:
                carried, level = self.base[c]
                at = cols[carried][train]
                want = (number[node[train]], at if level is None else level[at])
            if order is None:  # half-way to the next value
                here, after = self.values[c][code[cut]], self.values[c][code[cut + 1]]
                half = here + (after - here) / 2
                last = np.searchsorted(self.values[c], np.where(half < after, half, here), "right")  # neighbouring doubles have no middle
                test_left = test_code < last[number[test_node]]
                train_left = want[1] < last[want[0]] if want else train_left
                return ln[cut].astype(np.int64), train_left, test_left
            larger = lw[cut] >= weight[taken] - lw[cut]  # where unseen levels go
            m = number[owner[own]] * n + code[own]
            if len(cut) * n <= DENSE_CELLS * len(train):
                table = np.repeat(larger, n)
                table[m] = left
                test_left = table[number[test_node] * n + test_code]
                train_left = table[want[0] * n + want[1]] if want else train_left
            else:
                def side(of, values):
                    key = of * n + values
                    place = np.minimum(np.searchsorted(m, key), len(m) - 1)
                    return np.where(m[place] == key, left[place], larger[of])
                test_left = side(number[test_node], test_code)
                train_left = side(*want) if want else train_left
            return ln[cut].astype(np.int64), train_left, test_left
        return top, finish


def _by_mean(owner: np.ndarray, mean: np.ndarray, nodes: int) -> np.ndarray:
    """The order by (owner, mean), equal ones as they are; ``owner`` rises."""
    if nodes > 1 << 16:
        return np.lexsort((mean, owner))
    order = np.argsort(mean)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]  # a radix sort
    mean = mean[order]
    same = (mean[1:] == mean[:-1]) & (owner[1:] == owner[:-1])
    if same.any():
        tied = np.append(same, False) | np.append(False, same)
        run = np.cumsum(~np.append(False, same))[tied]
        order[tied] = order[tied][np.lexsort((order[tied], run))]
    return order


LEAVES = "tree int, row long, value double, feature int"


def _finish(names: list[str], categorical: list[bool], min_leaf: int):
    """applyInArrow body: a node's rows grown to leaves; the test rows' values
    and the columns' gains."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, w = table["tree"][0].as_py(), table["w"].to_numpy()
        test = table["is_test"].to_numpy(zero_copy_only=False)
        if not (w > 0).any():
            return pa.table({n: pa.array([], t) for n, t in zip(("tree", "row", "value", "feature"),
                                                               (pa.int32(), pa.int64(), pa.float64(), pa.int32()))})
        order = np.argsort(table["row"].to_numpy())  # the same sums in whichever order rows come
        grown = LocalTree((table[c].to_numpy()[order] for c in names), categorical, table["y"].to_numpy()[order], w[order], min_leaf,
                          table["levels_left"][0].as_py())
        rows, n = table["row"].to_numpy()[order][test[order]], len(names)
        of_row = np.arange(len(rows) + n) < len(rows)
        return pa.table({
            "tree": pa.array(np.full(len(rows) + n, tree), pa.int32()),
            "row": pa.array(np.append(rows, np.zeros(n, np.int64)), mask=~of_row),
            "value": pa.array(np.concatenate([grown.value[test[order]], grown.gains])),
            "feature": pa.array(np.append(np.zeros(len(rows)), np.arange(n)).astype(np.int32), mask=of_row)})
    return run


def _below(bounds: list[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < value)) if bounds else F.lit(0)


def _split_large(nodes: DataFrame, names: list[str], categorical: list[bool], cuts: dict[str, list[float]], min_leaf: int) -> tuple[DataFrame, DataFrame]:
    """The best split of each (tree, node) of the rows ``nodes`` - tree, node,
    gain, best_column, threshold (a bin), larger_left, mean, square - and, for
    splits on a category, the levels' sides."""
    train = nodes.where("w > 0")
    cells = []
    for i, c in enumerate(names):
        if categorical[i]:
            code = F.col(c)
        else:  # the bin: how many cuts lie below
            code = _below(cuts[c], F.col(c))
        cells.append(F.struct(F.lit(i).alias("column"), code.cast("long").alias("code")))
    sums = (train.select("tree", "node", "w", (F.col("w") * F.col("y")).alias("wy"), F.explode(F.array(*cells)).alias("c"))
            .groupBy("tree", "node", "c.column", "c.code")
            .agg(F.sum("w").cast("double").alias("w"), F.sum("wy").alias("wy"), F.count(F.lit(1)).alias("n")))
    is_cat = F.array(*[F.lit(c) for c in categorical])
    place = F.when(F.get(is_cat, F.col("column")), F.col("wy") / F.col("w")).otherwise(F.col("code").cast("double"))
    sums = computed_once(sums.withColumn("place", place))
    run = Window.partitionBy("tree", "node", "column").orderBy("place", "code")
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("tree", "node", "column")
    scan = sums
    for x in ("w", "wy", "n"):
        scan = scan.withColumn(f"l_{x}", F.sum(x).over(upto)).withColumn(f"r_{x}", F.sum(x).over(whole) - F.col(f"l_{x}"))
    scan = scan.withColumn("at", F.row_number().over(run)).where(
        f"l_n >= {min_leaf} and r_n >= {min_leaf} and r_w > 0")
    gain = (F.col("l_wy") ** 2 / F.col("l_w") + F.col("r_wy") ** 2 / F.col("r_w")
            - (F.col("l_wy") + F.col("r_wy")) ** 2 / (F.col("l_w") + F.col("r_w")))
    best = scan.groupBy("tree", "node").agg(F.max(F.struct(
        gain.alias("gain"), (-F.col("column")).alias("c"), (-F.col("at")).alias("a"), "code", (F.col("l_w") >= F.col("r_w")).alias("larger_left"))).alias("b"))
    best = best.select("tree", "node", "b.gain", (-F.col("b.c")).alias("best_column"), (-F.col("b.a")).alias("best_at"),
                       F.col("b.code").alias("threshold"), "b.larger_left")
    means = train.groupBy("tree", "node").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"),
                                              F.sum(F.col("w") * F.col("y") * F.col("y")).alias("square"))
    best = computed_once(means.join(best.withColumnRenamed("tree", "t").withColumnRenamed("node", "o"),
                                    (F.col("tree") == F.col("t")) & (F.col("node") == F.col("o")), "left").drop("t", "o"))
    ranked = sums.withColumn("at", F.row_number().over(run))
    sides = ranked.join(best.select("tree", "node", F.col("best_column").alias("column"), "best_at"), ["tree", "node", "column"])
    return best, computed_once(sides.where(F.get(is_cat, F.col("column"))).select(
        F.col("tree").alias("s_tree"), F.col("node").alias("s_node"), F.col("code").alias("s_code"), (F.col("at") <= F.col("best_at")).alias("left_side")))


def _drawn(n: int, bootstrap: bool) -> float:
    """The most of ``n`` rows that a tree sees (by chance, less than once in 10^20 trees more)."""
    return n * (1 - math.exp(-1)) + 5 * math.sqrt(n) if bootstrap else n


def grow(rows: DataFrame, names: list[str], categorical: list[bool], trees: range, min_leaf: int, seed: int = 0,
         local_rows: int = LOCAL_ROWS, bins: int = BINS, max_depth: int | None = None, bootstrap: bool = True) -> DataFrame:
    """Leaf values of the test rows and gains of the columns for ``trees``.

    ``rows``: row (long, unique), key (long: what the bootstrap hashes), y,
    is_test and the columns ``names`` without nulls, categories as long codes.
    Returns tree, row, value, feature: a test row's leaf mean (feature null),
    or a column's summed gain in squared error (row null). A level that a node
    has not seen goes to its larger side."""
    w = bootstrap_weight(F.col("key"), F.col("tree"), seed) if bootstrap else F.lit(1)
    nodes = rows.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in trees])))
    nodes = nodes.withColumn("w", F.when(F.col("is_test"), 0).otherwise(w)).where("w > 0 or is_test").withColumn("node", F.lit(1).cast("decimal(38,0)"))
    leaves, depth, cuts = [], 0, None
    while max_depth is None or depth < max_depth:
        sizes = nodes.where("w > 0").groupBy("tree", "node").count().where(F.col("count") > local_rows)
        if depth == 0 and _drawn(rows.where("not is_test").count(), bootstrap) <= local_rows:
            break  # no tree has that many
        sizes = computed_once(sizes.select(F.col("tree").alias("t"), F.col("node").alias("o")))
        if not sizes.take(1):
            break
        if cuts is None:
            cuts = _bin_cuts(rows, [n for n, c in zip(names, categorical) if not c], bins)
        marked = join_small(nodes, sizes, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("o")), "left")
        large = computed_once(marked.where("t is not null").drop("t", "o"))
        small = marked.where("t is null").drop("t", "o")
        best, sides = _split_large(large, names, categorical, cuts, min_leaf)
        b = best.select(F.col("tree").alias("t"), F.col("node").alias("o"), "gain", "best_column", "threshold", "larger_left", "mean", "square")
        large = join_small(large, b, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("o")), "left").drop("t", "o")
        none = F.col("gain").isNull() | (F.col("gain") <= LEAST_GAIN * F.col("square"))
        leaves.append(computed_once(large.where(none & F.col("is_test")).select(
            "tree", "row", F.col("mean").alias("value"), F.lit(None).cast("int").alias("feature"))))
        leaves.append(best.where(~none).select("tree", F.lit(None).cast("long").alias("row"), F.col("gain").alias("value"),
                                               F.col("best_column").cast("int").alias("feature")))
        code = F.lit(None).cast("long")
        left = F.lit(None).cast("boolean")
        for i, c in enumerate(names):
            here = F.col("best_column") == i
            if categorical[i]:
                code = F.when(here, F.col(c)).otherwise(code)
            else:
                bounds = F.array(*[F.lit(x) for x in cuts[c]]) if cuts[c] else F.array().cast("array<double>")
                left = F.when(here, F.col(c) <= F.get(bounds, F.col("threshold").cast("int"))).otherwise(left)
        large = large.where(~none).withColumn("code", code).withColumn("left", left)
        large = join_small(large, sides, (F.col("tree") == F.col("s_tree")) & (F.col("node") == F.col("s_node")) & (F.col("code") == F.col("s_code")), "left")
        go_left = F.coalesce("left", "left_side", "larger_left")
        large = large.withColumn("node", (F.col("node") * 2 + F.when(go_left, 0).otherwise(1)).cast("decimal(38,0)"))
        columns = ["row", "key", "y", "is_test", *names, "tree", "w", "node"]
        nodes = computed_once(small.select(*columns).unionByName(large.select(*columns)))
        depth += 1
    left_levels = F.lit(None if max_depth is None else max_depth - depth).cast("int")
    done = nodes.select("tree", "node", "row", "y", "is_test", "w", *names, left_levels.alias("levels_left"))
    out = done.groupBy("tree", "node").applyInArrow(_finish(names, categorical, min_leaf), LEAVES)
    for part in leaves:
        out = out.unionByName(part)
    return out


PACKED, GROWN = "name string, at int, data binary", "tree int, trees int, chunk int, data binary"


def _pack(names: list[str]):
    """mapInArrow body: all rows as arrays - a column's distinct values (``v0``,
    ``v1``, ...) and the rows' places among them (``c0``, ...), y and key of the
    training rows, which come first and in the order of the widest column, and
    the test rows' numbers in CHUNK_ROWS of them - cut into pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        values, codes = [], []
        for c in names:
            x = table[c].to_numpy()
            coded = pa.array(x + 0.0 if x.dtype.kind == "f" else x).dictionary_encode()  # one zero
            v = coded.dictionary.to_numpy(zero_copy_only=False)
            order = np.argsort(v)
            place = np.empty(len(v), _code_type(len(v)))
            place[order] = np.arange(len(v))
            values.append(v[order])
            codes.append(place[coded.indices.to_numpy()])
        test, row = table["is_test"].to_numpy(zero_copy_only=False), table["row"].to_numpy()
        train = np.flatnonzero(~test)
        train = train[np.lexsort((row[train], max(zip(values, codes), key=lambda x: len(x[0]))[1][train]))]
        test = np.flatnonzero(test)
        test = test[np.argsort(row[test])]
        arrays = {f"v{i}": v for i, v in enumerate(values)} | {f"c{i}": c[np.concatenate([train, test])] for i, c in enumerate(codes)}
        arrays |= {"y": table["y"].to_numpy()[train], "key": table["key"].to_numpy()[train]}
        for name, x in arrays.items():
            data = x.tobytes()
            for at in range(0, max(len(data), 1), PIECE_BYTES):
                yield pa.RecordBatch.from_pydict({"name": [f"{name} {x.dtype.str}"], "at": pa.array([at], pa.int32()), "data": [data[at:at + PIECE_BYTES]]})
        for i, at in enumerate(range(0, len(test), CHUNK_ROWS)):
            yield pa.RecordBatch.from_pydict({"name": ["rows"], "at": pa.array([i], pa.int32()), "data": [row[test[at:at + CHUNK_ROWS]].tobytes()]})
    return run


def _grow_packed(categorical: list[bool], min_leaf: int, seed: int, max_depth: int | None, bootstrap: bool):
    """mapInArrow body: the packed arrays and the trees of a task, from
    ``first`` up to ``past``; the sums of what the trees predict for the test
    rows, in chunks, and each tree's gains (chunk -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, first, past = {}, 0, 0
        for b in batches:
            for name, at, data, first, past in zip(*(b.column(i) for i in range(5))):
                pieces.setdefault(name.as_py(), []).append((at.as_py(), data.as_buffer()))
            first, past = first.as_py(), past.as_py()
        arrays = {}
        for name in list(pieces):
            name_of, kind = name.split(" ")
            arrays[name_of] = np.concatenate([np.frombuffer(data, kind) for _, data in sorted(pieces.pop(name), key=lambda x: x[0])])
        if not len(arrays.get("y", ())):
            return
        y, key, n = arrays["y"], arrays["key"], len(arrays["y"])
        values, codes = ([arrays[f"{x}{i}"] for i in range(len(categorical))] for x in "vc")
        tests = np.stack([c[n:] for c in codes], axis=1).astype(np.int32)
        total, trees = np.zeros(len(tests)), 0
        for tree in range(first, past):
            w = drawn_weights(key, tree, seed) if bootstrap else np.ones(n, np.int64)
            rows = np.flatnonzero(w)
            if not len(rows):
                continue
            grown = LocalTree.of_codes(values, categorical, [c[rows] for c in codes], y[rows], w[rows], tests, min_leaf, max_depth)
            total += grown.leaves
            trees += 1
            yield _grown(tree, 1, -1, grown.gains)
        for i, at in enumerate(range(0, len(total) if trees else 0, CHUNK_ROWS)):
            yield _grown(first, trees, i, total[at:at + CHUNK_ROWS])
    return run


def _grown(tree: int, trees: int, chunk: int, data: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array([x], pa.int32()) for x in (tree, trees, chunk)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array([data.tobytes()], pa.binary())], ["tree", "trees", "chunk", "data"])


def _add_up(table: pa.Table) -> pa.Table:
    """applyInArrow body: a chunk's test rows (of no tree) with their mean over
    the trees, or each tree's gains."""
    table = table.sort_by("tree")
    data = [np.frombuffer(x.as_buffer(), np.float64) for x in table["data"].combine_chunks()]
    tree = table["tree"].to_numpy()
    if table["chunk"][0].as_py() < 0:
        n = len(data[0])
        columns = np.repeat(tree, n), np.zeros(n * len(tree), np.int64), np.concatenate(data), np.tile(np.arange(n), len(tree))
        empty = (False, True, False, False)
    else:
        row = data[0].view(np.int64)
        n = len(row) if len(tree) > 1 else 0
        columns = np.zeros(n), row[:n], sum(data[1:]) / max(table["trees"].to_numpy().sum(), 1) + np.zeros(n), np.zeros(n)
        empty = (True, False, False, True)
    types = (pa.int32(), pa.int64(), pa.float64(), pa.int32())
    return pa.table({name: pa.array(c.astype(t.to_pandas_dtype()), mask=np.full(len(c), e))
                     for name, c, t, e in zip(("tree", "row", "value", "feature"), columns, types, empty)})


def _packed_forest(rows: DataFrame, names: list[str], categorical: list[bool], num_trees: int, min_leaf: int, seed: int = 0,
                   max_depth: int | None = None, bootstrap: bool = True) -> DataFrame:
    """The test rows' predictions (row, value) and the columns' gains by tree
    (tree, feature, value) of a forest whose trees a task can grow: the rows
    are packed once, each task reads them and leaves its trees' sums."""
    packed = computed_once(rows.select("row", "key", "y", "is_test", *names).repartition(1).mapInArrow(_pack(names), PACKED))
    spark = rows.sparkSession
    tasks = -(-num_trees // TREES_A_TASK)
    trees = spark.range(0, tasks, 1, tasks).select((F.col("id") * TREES_A_TASK).alias("first"), F.least(F.col("id") * TREES_A_TASK + TREES_A_TASK, F.lit(num_trees)).alias("past"))
    # a task for each row of trees, none of them broadcast
    each = packed.where("name != 'rows'").hint("shuffle_replicate_nl").crossJoin(trees)
    grown = each.mapInArrow(_grow_packed(categorical, min_leaf, seed, max_depth, bootstrap), GROWN)
    numbers = packed.where("name = 'rows'").select(F.lit(-1).alias("tree"), F.lit(0).alias("trees"), F.col("at").alias("chunk"), "data")
    return computed_once(grown.unionByName(numbers).groupBy("chunk").applyInArrow(_add_up, LEAVES))


def _bin_cuts(rows: DataFrame, numeric: list[str], bins: int) -> dict[str, list[float]]:
    """At most ``bins`` cut points of each number, at its quantiles over the
    training rows (between ranks that are off by at most 1 / (10 bins))."""
    if not numeric:
        return {}
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    r = rows.where("not is_test").agg(*[F.percentile_approx(c, at, 10 * bins).alias(c) for c in numeric]).first()
    return {c: sorted(set(r[c] or [])) for c in numeric}


def forest(rows: DataFrame, names: list[str], categorical: list[bool], num_trees: int, min_leaf: int, seed: int = 0,
           **options) -> tuple[DataFrame, DataFrame]:
    """(row, predicted) for the test rows, the mean over ``num_trees`` trees;
    (feature, value): the columns' importances, each tree's gains scaled to 1,
    averaged, adding to 1 (no row where no tree has a split)."""
    n, trained = rows.agg(F.count(F.lit(1)), F.count(F.when(~F.col("is_test"), F.lit(1)))).first()
    most = options.get("local_rows", LOCAL_ROWS)
    if _drawn(trained, options.get("bootstrap", True)) <= most and n <= 2 * most:
        leaves = _packed_forest(rows, names, categorical, num_trees, min_leaf, seed,
                                **{k: v for k, v in options.items() if k in ("max_depth", "bootstrap")})
        predicted = leaves.where("feature is null").select("row", F.col("value").alias("predicted"))
    else:
        step = max(1, min(num_trees, BATCH_ROWS // max(n, 1)))
        # a row's values are summed over the batch's trees, a column's gains by tree
        tree = F.when(F.col("row").isNull(), F.col("tree")).alias("tree")
        parts = [computed_once(grow(rows, names, categorical, range(t, min(t + step, num_trees)), min_leaf, seed, **options)
                               .groupBy(tree, "row", "feature").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("trees")))
                 for t in range(0, num_trees, step)]
        leaves = parts[0]
        for p in parts[1:]:
            leaves = leaves.unionByName(p)
        predicted = leaves.where("feature is null").groupBy("row").agg((F.sum("value") / F.sum("trees")).alias("predicted"))
    gains = leaves.where("feature is not null").groupBy("tree", "feature").agg(F.sum("value").alias("value"))
    share = gains.withColumn("value", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("tree")))).where("value is not null")
    share = share.groupBy("feature").agg(F.sum("value").alias("value"))  # one row a column
    total = share.agg(F.sum("value").alias("total"))
    place = F.array(*[F.lit(c) for c in names])
    return predicted, share.crossJoin(F.broadcast(total)).select(
        F.get(place, F.col("feature")).alias("feature"), (F.col("value") / F.col("total")).alias("value"))
