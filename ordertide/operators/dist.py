"""Distribution summaries: quantiles, histogram, box, Q-Q and density.

Exact quantiles are selected by counting (no sort, no group in one task);
ranks of every row (Q-Q) come from ``global_rank``. No group's values are
collected. Scalars that size the computation (n, min, max, std) are one-row
aggregates turned into literals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.functions.normal import probit
from ordertide.functions.numeric import is_finite
from ordertide.operators.joins import computed_once, join_small
from ordertide.operators.ranking import global_rank


# Histogram bin count clamp(floor(sqrt n), 10, 60); density on
# 500 grid points; box fences at 1.5 IQR; Filliben's order-statistic medians
# (i - 0.3175) / (n + 0.365), with the ends 1 - 0.5^(1/n) and 0.5^(1/n).
MIN_BINS, MAX_BINS = 10, 60
KDE_POINTS = 500
FENCE_IQR = 1.5
FILLIBEN_A, FILLIBEN_B = 0.3175, 0.365


def finite_values(df: DataFrame, value: str = "sales", keep=()) -> DataFrame:
    """Rows with a finite numeric ``value`` (as double) plus ``keep`` columns."""
    v = F.col(value).try_cast("double")
    return df.select(*keep, v.alias(value)).where(is_finite(F.col(value)))


def _position(p: float, n, method: str):
    """0-based fractional position of quantile ``p`` in a sorted sample of n."""
    if method == "linear":        # type 7 (pandas / numpy default, quantile_cont)
        return F.lit(p) * (n - 1)
    if method == "hazen":         # p*n - 1/2, clamped to the sample
        return F.least(F.greatest(F.lit(p) * n - F.lit(0.5), F.lit(0.0)), n - 1)
    raise ValueError(method)


#: Bins per group and round of the selection below.
SELECT_BINS = 1024


def _order_of(x: Column) -> Column:
    """A number that rises with ``x`` as the power of two of its size does; 0 for 0."""
    least = 5e-324  # the smallest double above 0
    return F.signum(x) * (F.log2(F.greatest(F.abs(x), F.lit(least))) + 1075)


def order_statistics(v: DataFrame, value: str, groups: list[str], wants: Column) -> DataFrame:
    """(group columns, n, want, value): exact order statistics of the non-NULL
    doubles in ``value``. ``wants``: an array of structs (want int, k long) made
    from the group's size ``n``, k the 0-based position. NULL keys are a group.

    Selection, not a sort: each wanted position has a range of values that
    holds it. A round counts the values of the range in SELECT_BINS equal bins,
    with map-side combine, and the bin with the position gives the next range -
    its own least and greatest value. Ranges over several orders of magnitude
    are cut into bins of equal orders instead, so values of any size take a
    few rounds: at most two by order, then one for each 10 bits. A range of one
    value is the answer, after two or three rounds as a rule. ``v`` is read by
    every round, so it should be a narrow stored table."""
    keys = [f"_g{i}" for i in range(len(groups))]
    v = v.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).alias("x")).where("x IS NOT NULL")
    state = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = computed_once(state.where("n > 0").withColumn("e", F.explode(wants)).select(
        *keys, "n", "e.want", "e.k", "lo", "hi", F.lit(0).cast("long").alias("below")))
    carried = ["want", "k", "n", "lo", "hi", "below"]
    while state.where("lo < hi").limit(1).count():
        open_ = state.where("lo < hi")
        if keys:
            s = open_.select(*[F.col(k).alias(f"s{k}") for k in keys], *carried)
            same = F.col("x").between(F.col("lo"), F.col("hi"))
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"s{k}"))
            tagged = join_small(v, s, same)
        else:  # one group: its few ranges are constants
            types = dict(open_.dtypes)
            ranges = F.array(*[F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in carried]) for r in open_.collect()])
            tagged = v.select("x", F.explode(F.filter(ranges, lambda e: F.col("x").between(e["lo"], e["hi"]))).alias("e"))
            tagged = tagged.select("x", "e.*")
        # halves: hi - lo may exceed the largest double
        even = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        lo, hi = F.abs("lo"), F.abs("hi")
        wide = (F.col("lo") <= 0) & (F.col("hi") >= 0) | (F.greatest(lo, hi) / SELECT_BINS > F.least(lo, hi))
        by_order = F.try_divide(_order_of(F.col("x")) - _order_of(F.col("lo")), _order_of(F.col("hi")) - _order_of(F.col("lo")))
        share = F.when(wide, by_order).otherwise(even)
        bins = (tagged.groupBy(*keys, "want", F.floor(share * SELECT_BINS).alias("bin"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("b_lo"), F.max("x").alias("b_hi"),
                     *[F.first(c).alias(c) for c in ("n", "k", "below")]))
        run = Window.partitionBy(*keys, "want").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("below") + F.coalesce(F.sum("c").over(run), F.lit(0)))
        hit = bins.where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c")))
        hit = hit.select(*keys, "n", "want", "k", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"),
                         F.col("before").alias("below"))
        state = computed_once(state.where("lo = hi").unionByName(hit))
    return state.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], "n", "want", F.col("lo").alias("value"))


def exact_quantiles(df: DataFrame, value: str, probs, group_cols=(), method: str = "linear",
                    names=None, stored: bool = False) -> DataFrame:
    """One row per group (NULL keys are a group) with ``n`` and the exact
    interpolated quantiles of the non-NULL doubles in ``value``. The narrow
    (group, value) table is written once; ``stored`` says that ``df`` is one."""
    groups = list(group_cols)
    names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
    v = df if stored else computed_once(df.select(*groups, value))
    ends = F.array(*[F.struct(F.lit(2 * i + side).alias("want"), end(_position(p, F.col("n"), method)).cast("long").alias("k"))
                     for i, p in enumerate(probs) for side, end in ((0, F.floor), (1, F.ceil))])
    found = order_statistics(v, value, groups, ends)
    g = found.groupBy(*groups).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("want") == i, F.col("value"))).alias(f"_v{i}")
                                                            for i in range(2 * len(probs))])
    outs = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = _position(p, F.col("n"), method)
        lo_v, hi_v, fr = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), h - F.floor(h)
        outs.append(F.when(fr == 0, lo_v).otherwise(lo_v + (hi_v - lo_v) * fr).alias(name))
    return g.select(*groups, "n", *outs)


def sales_quantile(df: DataFrame, p: float = 0.75, value: str = "sales") -> DataFrame:
    """The ``p`` quantile (linear interpolation) of finite ``value``."""
    return exact_quantiles(finite_values(df, value), value, [p], names=["quantile"])


# --- histogram ------------------------------------------------------------------

def auto_bins(n: int, lo: int = MIN_BINS, hi: int = MAX_BINS) -> int:
    return max(lo, min(hi, int(math.isqrt(max(n, 0)))))


def histogram(df: DataFrame, value: str = "sales", bins: int | None = None) -> DataFrame:
    """Equal-width bins from min to max (the max is folded into the last
    bin); default count clamp(floor(sqrt n), 10, 60). Every bin is listed,
    empty ones with count 0. (Plotting libraries may pick rounder edges.)"""
    v = finite_values(df, value)
    st = v.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    spark = df.sparkSession
    if not st["n"]:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, count long")
    k = bins or auto_bins(st["n"])
    lo, hi = float(st["lo"]), float(st["hi"])
    width = (hi - lo) / k
    x = F.col(value)
    b = (F.lit(0) if width == 0 else
         F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(k - 1))).cast("int")
    counts = v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(k).select(F.col("id").cast("int").alias("bin"))  # k <= a few dozen
    return (edges.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def rug(df: DataFrame, value: str = "sales", keep=()) -> DataFrame:
    """The raw finite values drawn beside the histogram."""
    return finite_values(df, value, keep)


# --- box ---------------------------------------------------------------------------

def _fences(q: DataFrame) -> DataFrame:
    iqr = F.col("q3") - F.col("q1")
    return (q.withColumn("iqr", iqr).withColumn("lower_fence", F.col("q1") - F.lit(FENCE_IQR) * iqr)
            .withColumn("upper_fence", F.col("q3") + F.lit(FENCE_IQR) * iqr))


def _boxes(df: DataFrame, value: str, group_col: str | None, keep, method: str) -> tuple[DataFrame, DataFrame]:
    """The finite rows with their group as ``_box`` (one box without a group
    column), written once, and the boxes' quartiles and fences."""
    v = finite_values(df, value, dict.fromkeys([*([group_col] if group_col else []), *keep]))
    v = v.where(F.col(group_col).isNotNull()) if group_col else v
    v = computed_once(v.withColumn("_box", F.col(group_col) if group_col else F.lit(0)))
    q = exact_quantiles(v, value, [0.25, 0.5, 0.75], ["_box"], method, ["q1", "median", "q3"], stored=True)
    return v, computed_once(_fences(q))


def box_stats(df: DataFrame, value: str = "sales", group_col: str | None = None, method: str = "hazen") -> DataFrame:
    """Per group: quartiles (Hazen positions by default, as box plots draw
    them), fences at 1.5 IQR, whiskers at the furthest values inside the
    fences and the outlier count. ``group_col`` None -> one overall box."""
    v, q = _boxes(df, value, group_col, (), method)
    x, inside = F.col(value), F.col(value).between(F.col("lower_fence"), F.col("upper_fence"))
    w = (join_small(v, q.select("_box", "lower_fence", "upper_fence"), "_box").groupBy("_box")
         .agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
              F.count(F.when(~inside, F.lit(1))).alias("outliers")))
    out = q.join(w, "_box")
    return out.withColumnRenamed("_box", group_col) if group_col else out.drop("_box")


def box_outliers(df: DataFrame, value: str = "sales", group_col: str | None = None, key=(),
                 method: str = "hazen") -> DataFrame:
    """The rows drawn as outlier points (outside the fences)."""
    v, q = _boxes(df, value, group_col, key, method)
    j = join_small(v, q.select("_box", "lower_fence", "upper_fence"), "_box")
    return j.where(~F.col(value).between(F.col("lower_fence"), F.col("upper_fence"))).drop("_box", "lower_fence", "upper_fence")


# --- Q-Q -----------------------------------------------------------------------------

def qq_normal(df: DataFrame, value: str = "sales", key=()) -> DataFrame:
    """Normal probability plot points: the i-th smallest value against the
    normal quantile of Filliben's order-statistic median
    (ends 1 - 0.5^(1/n) and 0.5^(1/n), else (i - 0.3175)/(n + 0.365))."""
    key = list(key)
    v = finite_values(df, value, key)
    r = global_rank(v, [value, *key], size_col="_n")
    n = F.col("_n").cast("double")
    i = F.col("rank").cast("double")
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    m = (F.when(n == 1, F.lit(0.5))
         .when(F.col("rank") == 1, F.lit(1.0) - last)
         .when(F.col("rank") == F.col("_n"), last)
         .otherwise((i - F.lit(FILLIBEN_A)) / (n + F.lit(FILLIBEN_B))))
    return r.select(*key, F.col("rank"), probit(m).alias("osm"), F.col(value).alias("osr"))


def qq_fit(qq: DataFrame) -> DataFrame:
    """Least-squares reference line of the Q-Q points and its correlation."""
    return qq.agg(F.regr_slope("osr", "osm").alias("slope"), F.regr_intercept("osr", "osm").alias("intercept"),
                  F.corr("osr", "osm").alias("r"))


# --- density ------------------------------------------------------------------------

KDE_CHUNK = 4096


def _kernel_sums(lo: float, step: float, h: float, points: int, value: str):
    """mapInPandas body: this task's sums of the kernel at every grid point,
    one row each."""
    grid = lo + np.arange(points) * step

    def run(batches):
        total = np.zeros(points)
        for pdf in batches:
            x = pdf[value].to_numpy(dtype="float64")
            for at in range(0, len(x), KDE_CHUNK):
                u = (grid[None, :] - x[at:at + KDE_CHUNK, None]) / h
                total += np.exp(-0.5 * u * u).sum(axis=0)
        yield pd.DataFrame({"point": np.arange(points, dtype="int32"), "s": total})
    return run


def kde(df: DataFrame, value: str = "sales", points: int = KDE_POINTS) -> DataFrame:
    """Gaussian kernel density at ``points`` grid points min + i*(max-min)/points,
    bandwidth Scott's factor n^(-1/5) times the sample std.

    Every task adds up the kernel of its own rows at the grid points and emits
    ``points`` rows, so nothing but these partial sums is shuffled."""
    v = computed_once(finite_values(df, value))
    st = v.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
               F.stddev_samp(value).alias("sd")).first()
    if not st["n"] or st["sd"] is None or st["sd"] == 0 or st["hi"] == st["lo"]:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    n, lo, hi, sd = st["n"], float(st["lo"]), float(st["hi"]), float(st["sd"])
    h, step = sd * n ** (-0.2), (hi - lo) / points
    sums = (v.mapInPandas(_kernel_sums(lo, step, h, points, value), "point int, s double")
            .groupBy("point").agg(F.sum("s").alias("s")))
    return sums.select("point", (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"),
                       (F.col("s") * F.lit(1.0 / (n * h * math.sqrt(2 * math.pi)))).alias("density"))


#: Width of a bin of the pre-binned density, in bandwidths, and the most bins.
KDE_BIN, KDE_MAX_BINS = 0.02, 1 << 20


def kde_binned(df: DataFrame, value: str = "sales", points: int = KDE_POINTS) -> DataFrame:
    """``kde`` over linearly binned values: each value is shared between the two
    ends of its bin, one aggregation adds the shares up, and the kernel is
    evaluated at the bins that are not empty instead of at the rows.

    Bins are KDE_BIN bandwidths wide (wider if that were more than
    KDE_MAX_BINS), so the density is off by at most ``kde_bin_error`` times the
    largest value that a single kernel reaches, whatever the number of rows.
    The bins, not the rows, come to the driver."""
    v = finite_values(df, value)
    st = v.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
               F.stddev_samp(value).alias("sd")).first()
    spark = df.sparkSession
    if not st["n"] or not st["sd"] or st["hi"] == st["lo"]:
        return spark.createDataFrame([], "point int, x double, density double")
    n, lo, hi = st["n"], float(st["lo"]), float(st["hi"])
    h, step = float(st["sd"]) * n ** (-0.2), (hi - lo) / points
    bins = min(KDE_MAX_BINS, math.ceil((hi - lo) / (KDE_BIN * h)))
    width = (hi - lo) / bins
    place = (F.col(value) - F.lit(lo)) / F.lit(width)
    left = F.least(F.floor(place), F.lit(bins - 1)).cast("long")
    shares = v.select(left.alias("bin"), (place - left).alias("right"))
    sums = shares.groupBy("bin").agg(F.count(F.lit(1)).alias("c"), F.sum("right").alias("r")).collect()  # at most KDE_MAX_BINS
    weight = np.zeros(bins + 1)
    for r in sums:
        weight[r["bin"]] += r["c"] - r["r"]
        weight[r["bin"] + 1] += r["r"]
    some = np.flatnonzero(weight)
    at, weight = lo + some * width, weight[some]
    rows = []
    for i in range(points):
        x = lo + i * step
        near = slice(*np.searchsorted(at, [x - 9 * h, x + 9 * h]))  # beyond, a kernel is under 1e-17 of its top
        u = (x - at[near]) / h
        rows.append((i, x, float((weight[near] * np.exp(-0.5 * u * u)).sum() / (n * h * math.sqrt(2 * math.pi)))))
    return spark.createDataFrame(rows, "point int, x double, density double")


def kde_bin_error(width_in_bandwidths: float = KDE_BIN) -> float:
    """Largest error of a binned density, as a share of a kernel's top: a
    value's kernel is interpolated between its bin's ends, and the Gaussian's
    second derivative is at most its top over h^2."""
    return width_in_bandwidths ** 2 / 8


#: Values kept for each bin of a rug.
RUG_PER_BIN = 50


def rug_sample(df: DataFrame, key_cols, value: str = "sales", bins: int | None = None, per_bin: int = RUG_PER_BIN,
               seed: int = 0) -> DataFrame:
    """(bin, value): of each histogram bin the ``per_bin`` rows with the least
    hash of key and seed - the same rows under any partitioning, every bin that
    has rows, and at most bins x per_bin of them. Tasks keep their own least
    ``per_bin`` of a bin, so a bin's rows don't meet."""
    from ordertide.operators.supervised import hash_uniform
    v = finite_values(df, value, dict.fromkeys(key_cols))
    st = v.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    k = bins or auto_bins(st["n"])
    lo, hi = float(st["lo"] or 0), float(st["hi"] or 0)
    width = (hi - lo) / k
    b = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(k - 1)).cast("int") if width else F.lit(0)
    drawn = v.select(b.alias("bin"), F.col(value), hash_uniform(key_cols, seed, v).alias("_u"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)])
    first = Window.partitionBy("bin").orderBy("_u", *[f"_k{i}" for i in range(len(list(key_cols)))])
    return drawn.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= per_bin).select("bin", value)
