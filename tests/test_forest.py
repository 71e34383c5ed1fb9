import numpy as np
import pytest
from pyspark.sql import functions as F

from ordertide.operators.forest import LocalTree, bootstrap_weight, forest, grow

CAT = [True, True, False]


def brute_tree(x, y, test, min_leaf):
    """One tree, node by node and cut by cut; leaf means of the rows ``test``, gains by column."""
    out, gains = np.zeros(len(y)), np.zeros(len(x))

    def split(train, all_rows):
        mean = y[train].mean()
        best = (1e-9, None)
        for c, col in enumerate(x):
            levels = sorted(set(col[train].tolist()), key=(lambda v: (y[train][col[train] == v].mean(), v)) if CAT[c] else None)
            for cut in range(1, len(levels)):
                left = set(levels[:cut])
                go = np.array([v in left for v in col[train].tolist()])
                a, b = y[train][go], y[train][~go]
                if min(len(a), len(b)) < min_leaf:
                    continue
                gain = ((y[train] - mean) ** 2).sum() - ((a - a.mean()) ** 2).sum() - ((b - b.mean()) ** 2).sum()
                if gain > best[0] + 1e-9:
                    best = (gain, c, left, set(levels), len(a) >= len(b), (levels[cut - 1] + levels[cut]) / 2 if not CAT[c] else None)
        if best[1] is None:
            out[all_rows] = mean
            return
        gain, c, left, seen, larger, half = best
        gains[c] += gain
        side = lambda rows: np.array([(v <= half if not CAT[c] else v in left if v in seen else larger) for v in x[c][rows].tolist()], dtype=bool)
        split(train[side(train)], all_rows[side(all_rows)])
        split(train[~side(train)], all_rows[~side(all_rows)])

    split(np.flatnonzero(~test), np.arange(len(y)))
    return out, gains


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n = 400
    x = [rng.integers(0, 40, n), rng.integers(0, 5, n), np.round(rng.normal(size=n), 2)]
    y = np.sin(x[0]) + (x[1] == 3) * x[2] + rng.normal(size=n) * 0.3
    test = rng.random(n) < 0.25
    x[0][np.flatnonzero(test)[:5]] = 99  # a level that training has not seen
    return x, y, test


def frame(spark, data):
    x, y, test = data
    rows = [(i, i * 7, float(y[i]), bool(test[i]), int(x[0][i]), int(x[1][i]), float(x[2][i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "row long, key long, y double, is_test boolean, a long, b long, z double")


@pytest.mark.parametrize("min_leaf", [1, 2, 25])
def test_local_tree_is_brute_force(data, min_leaf):
    x, y, test = data
    want, gains = brute_tree(x, y, test, min_leaf)
    tree = LocalTree(x, CAT, y, (~test).astype(int), min_leaf)
    assert np.allclose(tree.value[test], want[test]) and np.allclose(tree.gains, gains)


@pytest.mark.parametrize("local_rows", [1 << 17, 120])
def test_one_tree_is_brute_force(spark, data, local_rows):
    """Nodes split by Spark and nodes finished in a task make the same tree."""
    x, y, test = data
    want, gains = brute_tree(x, y, test, 2)
    got = grow(frame(spark, data), ["a", "b", "z"], CAT, range(1), 2, local_rows=local_rows, bins=400, bootstrap=False).collect()
    by_row = {r["row"]: r["value"] for r in got if r["row"] is not None}
    assert by_row.keys() == set(np.flatnonzero(test).tolist())
    exact = [np.isclose(by_row[i], want[i]) for i in by_row]
    # large nodes cut at a value, not half-way to the next: a test row between the two may go the other way
    assert all(exact) if local_rows > 1000 else np.mean(exact) > 0.9
    summed = np.bincount([r["feature"] for r in got if r["row"] is None], [r["value"] for r in got if r["row"] is None], 3)
    assert np.allclose(summed, gains)


def test_forest(spark, data, monkeypatch):
    """The mean over trees, whatever the batches; importances add to 1; better than the mean."""
    from ordertide.operators import forest as module
    x, y, test = data
    rows = frame(spark, data)
    predicted, shares = forest(rows, ["a", "b", "z"], CAT, 30, 2)
    got = {r["row"]: r["predicted"] for r in predicted.collect()}
    monkeypatch.setattr(module, "BATCH_ROWS", 4000)
    again, _ = forest(rows.repartition(3), ["a", "b", "z"], CAT, 30, 2)
    assert all(np.isclose(r["predicted"], got[r["row"]]) for r in again.collect()) and len(got) == test.sum()
    share = {r["feature"]: r["value"] for r in shares.collect()}
    assert np.isclose(sum(share.values()), 1) and max(share, key=share.get) == "a"
    error = np.mean([(got[i] - y[i]) ** 2 for i in got])
    assert error < 0.5 * np.var(y[test])


def test_edges_of_a_forest(spark):
    """One value of the label, of a column, or one training row: a leaf."""
    rows = spark.createDataFrame([(i, i, 1.0, i % 3 == 0, 5, 0.5) for i in range(30)], "row long, key long, y double, is_test boolean, a long, z double")
    for local in (1 << 17, 10):
        predicted, shares = forest(rows, ["a", "z"], [True, False], 3, 2, local_rows=local)
        assert {round(r["predicted"], 12) for r in predicted.collect()} == {1.0} and shares.count() == 0
    one = rows.where("row in (0, 1)").withColumn("y", F.col("row") + F.lit(2.0))
    got = forest(one, ["a", "z"], [True, False], 2, 2, bootstrap=False)[0].collect()
    assert [(r["row"], r["predicted"]) for r in got] == [(0, 3.0)]


def test_bootstrap_is_poisson(spark):
    n = 40_000
    got = spark.range(n).select(bootstrap_weight(F.col("id"), F.lit(3), 0).alias("w")).agg(F.avg("w").alias("m"), F.variance("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).first()
    assert abs(got["m"] - 1) < 0.03 and abs(got["v"] - 1) < 0.05 and abs(got["z"] - 0.3679) < 0.01


@pytest.mark.parametrize("block_rows, dense_cells", [(16, 0), (16, 1000), (1 << 17, 0), (60, 2)])
def test_blocks_and_tables_make_the_same_tree(data, monkeypatch, block_rows, dense_cells):
    from ordertide.operators import forest as module
    monkeypatch.setattr(module, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(module, "DENSE_CELLS", dense_cells)
    x, y, test = data
    want, gains = brute_tree(x, y, test, 2)
    tree = LocalTree(x, CAT, y, (~test).astype(int), 2)
    assert np.allclose(tree.value[test], want[test]) and np.allclose(tree.gains, gains)


def test_a_tree_of_150000_rows_is_one_task(spark, monkeypatch):
    """No pass of Spark's over the exploded rows, and no table of them, for trees that a task can grow."""
    from ordertide.operators import forest as module

    def never(*_):
        raise AssertionError("split by Spark")
    monkeypatch.setattr(module, "_split_large", never)
    rows = spark.range(150_000).select(F.col("id").alias("row"), F.col("id").alias("key"), (F.col("id") % 7).cast("double").alias("y"),
                                       (F.col("id") % 5000 == 0).alias("is_test"), (F.col("id") % 7).alias("a"))
    predicted, shares = forest(rows, ["a"], [True], 1, 2, bootstrap=False)
    assert all(np.isclose(r["predicted"], r["row"] % 7) for r in predicted.collect()) and shares.count() == 1


def test_numpy_draws_sparks_bootstrap(spark):
    """A tree over packed rows draws the weights that Spark's expression gives."""
    from ordertide.operators.forest import drawn_weights
    keys = np.random.default_rng(3).integers(-1 << 62, 1 << 62, 5000)
    rows = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for tree, seed in ((0, 0), (249, 7), (3, -1)):
        want = [r["w"] for r in rows.select(bootstrap_weight(F.col("key"), F.lit(tree), seed).alias("w")).collect()]
        assert drawn_weights(keys, tree, seed).tolist() == want


def test_rows_are_packed_once_for_all_trees(spark, data, monkeypatch):
    """Trees that a task can grow are no (row, tree) pairs of a shuffle, and are the trees of that path."""
    from ordertide.operators import forest as module
    rows = frame(spark, data)
    dealt = grow(rows, ["a", "b", "z"], CAT, range(5), 2).collect()
    want = {i: np.mean([r["value"] for r in dealt if r["row"] == i]) for i in np.flatnonzero(data[2]).tolist()}

    def never(*_, **__):
        raise AssertionError("rows exploded by tree")
    monkeypatch.setattr(module, "grow", never)
    monkeypatch.setattr(module, "CHUNK_ROWS", 7)
    monkeypatch.setattr(module, "PIECE_BYTES", 104)
    got = {r["row"]: r["predicted"] for r in forest(rows.repartition(3), ["a", "b", "z"], CAT, 5, 2)[0].collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i]) for i in got)


@pytest.mark.parametrize("dense_cells", [0, 4])
def test_columns_that_decide_others(data, monkeypatch, dense_cells):
    """A column whose sums are another's added up splits as if it were counted itself."""
    from ordertide.operators import forest as module
    monkeypatch.setattr(module, "DENSE_CELLS", dense_cells)
    x, y, test = data
    x = [x[0], x[0] // 8, (x[0] // 16).astype(float)]
    want, gains = brute_tree(x, y, test, 2)
    tree = LocalTree(x, CAT, y, (~test).astype(int), 2)
    assert [d and d[0] for d in tree.decider] == [None, 0, 1]
    assert np.allclose(tree.value[test], want[test]) and np.allclose(tree.gains, gains)
