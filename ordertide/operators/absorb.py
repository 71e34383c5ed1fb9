"""Least squares and logistic regression with a wide factor absorbed.

A categorical column with very many levels makes a diagonal block of the
normal equations: the rows of a level meet no other level. That block is
eliminated exactly (its Schur complement is taken), so what is left is a
system over the intercept, the numbers and the levels of the other columns:

    A - sum over levels g of s_g s_g' / (h_g + alpha)

with A the other columns' cross products, s_g their sums and h_g the weight
within level g. The rows are dealt by level once and written in its order; a
pass then finds each level's own best coefficient for the small coefficients at
hand, in numpy over whole blocks of levels, and adds up the system that is left
- so a pass gives what Newton's method needs of the whole problem, and no
coefficient of the wide column is ever sent anywhere. Least squares take one
step (and one that refines it), logistic regression a few. The driver solves
the small system; the wide coefficients are a table that meets the rows to
predict in a join.

A level with very many rows (``HOT_ROWS``, or a 1,024th of all) gets a feature
of the small system instead, and its rows are dealt by hash: no task holds more
rows of one level than that.

``alpha`` penalises every coefficient but the intercept, as ridge regression
does; 0 is ordinary least squares, whose solution for collinear columns is the
shortest one (the intercept not counted), the limit of ridge regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.operators.joins import computed_once

#: Most features of the small system, which the driver solves.
MAX_NARROW = 4096
#: The intercept's name among the features; the wide column's frequent levels come under its own.
INTERCEPT = "\x00intercept"
#: A level with more rows than this, and than a 1,024th of all rows, joins the small system.
HOT_ROWS, HOT_SHARE = 1 << 18, 1024
#: Numbers in a block's table of levels by features, and most rows of a block.
BLOCK_CELLS, BLOCK_ROWS = 1 << 22, 1 << 18
#: Most Newton steps; a step below this share of the largest coefficient is the last, as the next would be its square.
MAX_STEPS, TOLERANCE = 100, 1e-6
#: Eigenvalues below this share of the largest belong to collinear columns.
RCOND = 1e-12


class Absorbed:
    """A fit: ``narrow`` {(column, level): coefficient} with numbers and the
    intercept under level '', ``wide_table`` (level, coefficient)."""

    def __init__(self, narrow: dict, wide: str, wide_table: DataFrame, cats: list[str], nums: dict[str, float]):
        self.narrow, self.wide, self.wide_table, self.cats, self.nums = narrow, wide, wide_table, cats, nums

    def predict(self, df: DataFrame, col: str = "predicted") -> DataFrame:
        """``df`` with predictions (of the log odds, for a logistic model); a
        level that training has not seen adds 0."""
        spark = df.sparkSession
        score = F.lit(self.narrow[INTERCEPT, ""])
        for c, s in self.nums.items():
            score = score + F.lit(self.narrow[c, ""]) * F.col(c) / F.lit(s)
        out, added = df, []
        for i, c in enumerate(self.cats):
            levels = [(x, float(v)) for (k, x), v in self.narrow.items() if k == c]
            known = F.broadcast(spark.createDataFrame(levels, f"__l{i} string, __c{i} double"))  # at most MAX_NARROW
            out = out.join(known, F.col(c) == F.col(f"__l{i}"), "left")
            score = score + F.coalesce(f"__c{i}", F.lit(0.0))
            added += [f"__l{i}", f"__c{i}"]
        wide = self.wide_table.select(F.col("level").alias("__level"), F.col("coefficient").alias("__coefficient"))
        out = out.withColumn("__score", score).join(wide, F.col(self.wide) == F.col("__level"), "left")
        return (out.withColumn(col, F.col("__score") + F.coalesce("__coefficient", F.lit(0.0)))
                .drop("__score", "__level", "__coefficient", *added))

    def coefficients(self) -> DataFrame:
        """(feature, value) of all coefficients but the intercept."""
        small = [(f"{c}_{x}" if x else c, float(v)) for (c, x), v in self.narrow.items() if c not in (INTERCEPT, self.wide)]
        own = self.wide_table.select(F.concat(F.lit(f"{self.wide}_"), "level").alias("feature"), F.col("coefficient").alias("value"))
        return own.unionByName(self.wide_table.sparkSession.createDataFrame(small, "feature string, value double")) if small else own


@dataclass
class _Pass:
    """A pass over the rows dealt by level: the small coefficients ``beta``
    (intercept, numbers, levels), how many numbers and categorical columns a
    row has, the penalty and the kind of model."""

    beta: np.ndarray
    n_nums: int
    n_cats: int
    alpha: float
    logistic: bool

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The partition's rows in blocks of whole levels. Rows come in the
        order of their level, null first; null is no level."""
        most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // len(self.beta)))
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                rows = pa.Table.from_batches(held).combine_chunks()
                end = n - (pc.sum(pc.equal(rows["level"], rows["level"][n - 1])).as_py() or 0)  # the last one may go on
                if end:
                    yield rows.slice(0, end)
                held, n = rows.slice(end).to_batches(), n - end
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def solved(self, rows: pa.Table) -> tuple:
        """For a block: numbers (the intercept's 1 among them) and codes of the
        rows, how many rows have no level, the first row of each level and the
        rows' levels, each level's coefficient and second derivative, the rows'
        first and second derivatives, and the loss."""
        p = len(self.beta)
        nums = np.stack([np.ones(len(rows)), *(rows[f"n{i}"].to_numpy() for i in range(self.n_nums))])
        codes = np.stack([rows[f"c{i}"].to_numpy() for i in range(self.n_cats)]) if self.n_cats else np.zeros((0, len(rows)), np.int32)
        y, w = rows["y"].to_numpy(), rows["w"].to_numpy()
        score = self.beta[:1 + self.n_nums] @ nums + np.append(self.beta, 0.0)[codes].sum(axis=0)
        loose = rows["level"].null_count
        level = rows["level"].combine_chunks().slice(loose)
        new = np.ones(len(level), bool)
        if len(level) > 1:
            new[1:] = pc.not_equal(level.slice(1), level.slice(0, len(level) - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(new) + loose
        group = np.cumsum(new) - 1
        by_level = lambda x: np.add.reduceat(x, start) if len(start) else np.zeros(0)

        def derivatives(u):
            t = score.copy()
            t[loose:] += u[group]
            if not self.logistic:
                return t, w * (t - y), w
            with np.errstate(over="ignore"):
                chance = 1.0 / (1.0 + np.exp(-t))
            return t, w * (chance - y), w * chance * (1.0 - chance)

        u = np.zeros(len(start))
        low, high = np.full(len(start), -np.inf), np.full(len(start), np.inf)
        for _ in range(MAX_STEPS if self.logistic else 1):  # least squares take one step
            _, first, second = derivatives(u)
            slope, bend = by_level(first) + self.alpha * u, by_level(second) + self.alpha
            low, high = np.where(slope < 0, u, low), np.where(slope > 0, u, high)
            step = u - slope / bend
            with np.errstate(invalid="ignore"):
                step = np.where((step <= low) & (slope > 0) | (step >= high) & (slope < 0), (low + high) / 2, step)
            moved = np.abs(step - u).max(initial=0.0)
            u = step
            if moved <= 1e-13 * (1.0 + np.abs(u).max(initial=0.0)):
                break
        t, first, second = derivatives(u)
        loss = (w * (np.logaddexp(0.0, t) - y * t)).sum() if self.logistic else (w * (t - y) ** 2).sum() / 2
        return nums, codes, loose, start, group, u, by_level(second) + self.alpha, first, second, loss + self.alpha / 2 * (u @ u)

    def _by_level(self, nums, codes, loose, start, group, second) -> np.ndarray:
        """Sums of each feature by level, weighted with ``second``."""
        p = len(self.beta)
        sums = np.zeros((len(start), p + 1))  # the last column: codes of no feature
        if len(start):
            sums[:, :len(nums)] = np.add.reduceat(nums * second, start, axis=1).T
        for c in codes:
            np.add.at(sums.reshape(-1), group * (p + 1) + c[loose:], second[loose:])
        return sums[:, :p]

    def system(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow body: (i, j, s): the part of the Hessian (i <= j), the
        gradient (i -1) and the loss (i -2), the levels' coefficients being
        solved for."""
        p = len(self.beta)
        whole, taken, gradient, loss = np.zeros((p + 1, p + 1)), np.zeros((p, p)), np.zeros(p + 1), 0.0
        for rows in self.blocks(batches):
            nums, codes, loose, start, group, _, bend, first, second, lost = self.solved(rows)
            d = len(nums)
            loss += lost
            gradient[:d] += nums @ first
            whole[:d, :d] += (nums * second) @ nums.T
            for i, c in enumerate(codes):
                gradient += np.bincount(c, first, p + 1)
                for k in range(d):
                    whole[k] += np.bincount(c, second * nums[k], p + 1)
                for other in codes[i:]:
                    np.add.at(whole.reshape(-1), np.minimum(c, other) * (p + 1) + np.maximum(c, other), second)
            sums = self._by_level(nums, codes, loose, start, group, second)
            taken += sums.T @ (sums / bend[:, None])
        left = np.triu(whole[:p, :p] - taken)
        yield from _cells(left, gradient[:p], loss)

    def lengths(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow body: as ``system``, of the levels' squared coefficients
        (their sum over two is the loss), which the small ones move."""
        p = len(self.beta)
        square, slope, loss = np.zeros((p, p)), np.zeros(p), 0.0
        for rows in self.blocks(batches):
            nums, codes, loose, start, group, u, bend, _, second, _ = self.solved(rows)
            moved = self._by_level(nums, codes, loose, start, group, second) / -bend[:, None]
            square += moved.T @ moved
            slope += u @ moved
            loss += u @ u / 2
        yield from _cells(np.triu(square), slope, loss)

    def levels(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """mapInArrow body: (level, coefficient)."""
        for rows in self.blocks(batches):
            start, u = (self.solved(rows)[i] for i in (3, 5))
            yield pa.RecordBatch.from_arrays([rows["level"].combine_chunks().take(pa.array(start)), pa.array(u)], ["level", "coefficient"])


def _cells(upper: np.ndarray, vector: np.ndarray, number: float) -> Iterator[pa.RecordBatch]:
    i, j = np.nonzero(upper)
    k = np.flatnonzero(vector)
    columns = (np.concatenate([i, np.full(len(k), -1), [-2]]), np.concatenate([j, k, [0]]), np.concatenate([upper[i, j], vector[k], [number]]))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "s"])


def _summed(dealt: DataFrame, body, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The symmetric matrix, vector and number that the tasks' cells add up to."""
    cells = dealt.mapInArrow(body, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()  # at most size^2 / 2
    i, j, s = (cells[c].to_numpy() for c in ("i", "j", "s"))
    matrix, vector = np.zeros((size, size)), np.zeros(size)
    inner = i >= 0
    matrix[i[inner], j[inner]] = s[inner]
    vector[j[i == -1]] = s[i == -1]
    return matrix + np.triu(matrix, 1).T, vector, float(s[i == -2].sum())


def _deal(train: DataFrame, wide: str, cats: list[str], nums: dict[str, float], label: str, weight: str | None,
          hot_rows: int) -> tuple[DataFrame, list[tuple[str, str]], int]:
    """The rows with coded columns, dealt by level and in its order; the
    features of the small system; how many categorical columns a row has."""
    spark = train.sparkSession
    sizes = computed_once(train.groupBy(F.col(wide).alias("level")).agg(F.count(F.lit(1)).alias("n")))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r["level"] for r in sizes.where(F.col("n") > max(hot_rows, n // HOT_SHARE)).orderBy("level").collect()]  # below HOT_SHARE
    seen = []
    if cats:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("l")) for i, c in enumerate(cats)]))
        seen = train.select(each.alias("x")).select("x.c", "x.l").distinct().limit(MAX_NARROW + 1).collect()
    names = [(INTERCEPT, ""), *[(c, "") for c in nums], *sorted((cats[r["c"]], r["l"]) for r in seen), *[(wide, x) for x in hot]]
    if len(names) > MAX_NARROW:
        raise ValueError(f"{len(names)} features beside {wide}; at most {MAX_NARROW}")
    columns = [*cats, *([wide] if hot else [])]
    out, at = train, {x: i for i, x in enumerate(names)}
    for i, c in enumerate(columns):
        codes = spark.createDataFrame([(x, at[k, x]) for k, x in names if k == c], f"__l{i} string, c{i} int")
        out = out.join(F.broadcast(codes), F.col(c) == F.col(f"__l{i}"), "left")
    level = F.when(F.col(f"c{len(cats)}").isNull(), F.col(wide)) if hot else F.col(wide)
    out = out.select(level.alias("level"), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
                     *[(F.col(c) / F.lit(s)).cast("double").alias(f"n{i}") for i, (c, s) in enumerate(nums.items())],
                     *[F.coalesce(f"c{i}", F.lit(len(names))).alias(f"c{i}") for i in range(len(columns))])
    spread = F.when(F.col("level").isNull(), F.xxhash64(*out.columns)).otherwise(F.xxhash64("level"))
    return computed_once(out.repartition(spread).sortWithinPartitions("level")), names, len(columns)


def fit_absorbed(train: DataFrame, wide: str, cats: list[str], nums: dict[str, float], label: str, alpha: float,
                 logistic: bool = False, weight: str | None = None, hot_rows: int = HOT_ROWS) -> Absorbed:
    """Fit ``label`` on the string columns ``wide`` and ``cats`` and the numbers
    ``nums`` (column: its scale), none with nulls: least squares or, for labels
    0 and 1, ``logistic`` regression, of rows weighted by ``weight`` (positive;
    default 1). The loss is the weighted sum of half the squared residuals, or
    of the log losses, plus ``alpha`` / 2 times the squared coefficients."""
    if logistic and not alpha > 0:
        raise ValueError("logistic regression needs a penalty: separable levels have no finite coefficient")
    dealt, names, n_cats = _deal(train, wide, cats, nums, label, weight, hot_rows)
    size = len(names)
    penalty = np.array([0.0 if x[0] == INTERCEPT else alpha for x in names])
    now = _Pass(np.zeros(size), len(nums), n_cats, alpha, logistic)
    best, start, step = np.inf, None, np.zeros(size)
    for _ in range(MAX_STEPS):
        left, gradient, loss = _summed(dealt, now.system, size)
        loss += float(penalty @ now.beta ** 2) / 2
        start = loss if start is None else start
        if loss > best + 1e-12 * start:  # too far
            step = step / 2
            now = replace(now, beta=now.beta - step)
            continue
        best = loss
        values, vectors = np.linalg.eigh(left + np.diag(penalty))
        free = values <= RCOND * max(values[-1], 0.0)
        inverse = np.divide(1.0, values, out=np.zeros(size), where=~free)
        step = -(vectors * inverse) @ (vectors.T @ (gradient + penalty * now.beta))
        now = replace(now, beta=now.beta + step)
        if np.abs(step).max() <= TOLERANCE * np.abs(now.beta).max(initial=1e-300):
            break
    if not alpha and free.any():  # of all solutions the shortest
        square, slope, _ = _summed(dealt, now.lengths, size)
        z = vectors[:, free]
        kept = z * np.array([[x[0] != INTERCEPT] for x in names])
        move = -np.linalg.pinv(kept.T @ kept + z.T @ square @ z, hermitian=True) @ (kept.T @ now.beta + z.T @ slope)
        now = replace(now, beta=now.beta + z @ move)
    narrow = {x: float(v) for x, v in zip(names, now.beta)}
    own = dealt.mapInArrow(now.levels, "level string, coefficient double")
    if hot := [(x, v) for (c, x), v in narrow.items() if c == wide]:
        own = own.unionByName(train.sparkSession.createDataFrame(hot, "level string, coefficient double"))
    return Absorbed(narrow, wide, computed_once(own), cats, nums)
