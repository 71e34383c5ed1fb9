"""Supervised models: sales regression and the high-value classifier.

Splits are deterministic hashes of the row key and a seed (replayable in
SQL: ``md5(key|seed)`` -> uniform in [0,1)), not ``randomSplit``. The split
table is checkpointed so training and prediction see the same rows even if
executors are lost. Results are DataFrames: metrics (one row), predictions
(one row per test line) and importances (top 20).
"""

from __future__ import annotations


import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.functions.numeric import is_finite
from ordertide.operators.absorb import fit_absorbed
from ordertide.operators.dist import exact_quantiles, order_statistics
from ordertide.operators.features import CAT_COLS, CLS_NUM_COLS, REG_NUM_COLS, fit_features
from ordertide.operators.forest import forest
from ordertide.operators.joins import computed_once, join_small
from ordertide.session import reliable_checkpoint, written_meanwhile

NORMAL_SOLVER_MAX_FEATURES = 4096  # Spark's normal-equation solver limit
# Most one-hot slots of a model that is gathered on the driver: above, the
# widest column is absorbed (absorb.py).
ONEHOT_MAX_SLOTS = 4096

# High-value cutoff at the 0.75 sales quantile; classification
# needs 40 rows and 8 per class and tests on a stratified 25 %; regression
# needs 200 rows, tests on 20 % by default, ridge alpha 1; forest of 250 trees
# with min leaf 2 using all features per split; top 20 importances.
HIGH_VALUE_Q = 0.75
CLS_MIN_ROWS, CLS_MIN_PER_CLASS, CLS_TEST_FRAC = 40, 8, 0.25
REG_MIN_ROWS, REG_TEST_FRAC, RIDGE_ALPHA = 200, 0.2, 1.0
FOREST_TREES, FOREST_MIN_LEAF = 250, 2
TOP_IMPORTANCES = 20


def _key_text(df: DataFrame | None, k: str) -> Column:
    """Key column as text; doubles go through decimal(38,10) so the text is
    the same in any SQL engine (no float-printing differences)."""
    c = F.col(k)
    if df is not None and dict(df.dtypes).get(k) in ("double", "float"):
        c = c.cast("decimal(38,10)")
    return c.cast("string")


def hash_uniform(key_cols, seed: int = 0, df: DataFrame | None = None) -> Column:
    """Uniform [0,1) from md5 of the key columns and the seed."""
    text = F.concat_ws("|", *[_key_text(df, k) for k in key_cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("double") / F.lit(float(16 ** 15))


def split_random(df: DataFrame, test_frac: float, key_cols, seed: int = 0, col: str = "is_test") -> DataFrame:
    """Rows with hash-uniform < ``test_frac`` go to test (no shuffle)."""
    if not 0.0 < test_frac < 1.0:
        raise ValueError("test_frac must be in (0, 1)")
    return df.withColumn(col, hash_uniform(key_cols, seed, df) < F.lit(test_frac))


def split_stratified(df: DataFrame, label: str, test_frac: float, key_cols, seed: int = 0,
                     col: str = "is_test") -> DataFrame:
    """ceil(test_frac * n_c) rows of each class c go to test: those with the
    smallest hash. The class's last such hash is selected from the narrow
    (label, hash) table, so the rows themselves are neither sorted nor
    written; rows that share that very hash (repeated keys) go together."""
    u = df.withColumn("_u", hash_uniform(key_cols, seed, df))
    cuts = computed_once(_last_hashes(computed_once(u.select(label, "_u")), label, test_frac))
    return join_small(u, cuts, F.col(label).eqNullSafe(F.col("_class"))).withColumn(
        col, F.col("_u") <= F.col("_cut")).drop("_u", "_class", "_cut")


def _last_hashes(u: DataFrame, label: str, test_frac: float) -> DataFrame:
    """(_class, _cut): the hash ``_u`` of each class's last test row; ``u`` is a stored table."""
    last = F.array(F.struct(F.lit(0).alias("want"), (F.ceil(F.lit(test_frac) * F.col("n")) - 1).cast("long").alias("k")))
    return order_statistics(u, "_u", [label], last).select(F.col(label).alias("_class"), F.col("value").alias("_cut"))


def finite_label_rows(df: DataFrame, label: str = "sales") -> DataFrame:
    return df.where(is_finite(F.col(label)))


def regression_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """R^2, MAE and RMSE over the prediction rows (one aggregate pass)."""
    a, p = F.col(actual), F.col(predicted)
    m = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"),
                 F.sum((a - p) * (a - p)).alias("sse"), F.sum(F.abs(a - p)).alias("sae"),
                 F.sum(a * a).alias("saa"), F.sum(a).alias("sa"))
    sst = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    return m.select(F.col("n").alias("test_rows"),
                    (F.lit(1.0) - F.col("sse") / sst).alias("r2"),
                    (F.col("sae") / F.col("n")).alias("mae"),
                    F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def _top20(spark, fm, values, by_abs: bool, kind: str) -> DataFrame:
    """Top-20 (name, value) of a model's coefficient/importance vector. The
    vector is model state on the driver; only its 20 entries become rows."""
    v = np.asarray(values, dtype=float)
    if len(v) != fm.size:
        raise ValueError(f"{len(v)} model weights for {fm.size} features")
    order = np.argsort(np.abs(v) if by_abs else v, kind="stable")[::-1][:TOP_IMPORTANCES]
    rows = [(i + 1, fm.name_of(int(j)), float(v[j])) for i, j in enumerate(order)]
    return spark.createDataFrame(rows, "rank int, feature string, value double").withColumn("type", F.lit(kind))


def linear_solver(size: int) -> str:
    """Normal equations while Spark's solver takes the features, else l-bfgs.
    Both minimise the same loss (tests compare them)."""
    return "normal" if size <= NORMAL_SOLVER_MAX_FEATURES else "l-bfgs"


def fit_regression(df: DataFrame, model: str = "forest", test_frac: float = REG_TEST_FRAC, seed: int = 0,
                   key_cols=None, label: str = "sales", num_trees: int = FOREST_TREES, max_depth: int | None = None,
                   min_rows: int = REG_MIN_ROWS, encoding: str = "onehot", features=None, solver: str | None = None) -> dict:
    """Fit sales on the categorical + postal-code features (or those of them
    in ``features``).

    model: 'linear' (OLS), 'ridge' (alpha 1) or 'forest' (random forest,
    250 trees, min leaf 2, all features per split, unlimited depth; columns
    are split as they are, see forest.py, so its importances are by column).
    ``solver``: 'normal', 'l-bfgs' or 'absorb' for the linear models; by
    default the first, and the last if the one-hot columns are over
    ONEHOT_MAX_SLOTS: the fit is the same, but no vocabulary and no coefficient
    vector of the widest column is gathered.
    Returns {'metrics', 'predictions',
    'importances', 'feature_names'}, or {'error'} with a reason code and its
    numbers. Predictions carry the key columns as they are in ``df``."""
    from ordertide.sources.sales import ROW_KEY
    key_cols = list(key_cols or ROW_KEY)
    spark = df.sparkSession
    data = finite_label_rows(df, label)
    feats = [c for c in [*CAT_COLS, *REG_NUM_COLS] if c in data.columns and (features is None or c in features)]
    data = data.select(*key_cols, *[c for c in feats if c not in key_cols],
                       F.col(label).cast("double").alias("label"))
    # the split table is written once; the row count and every later pass read it
    split = reliable_checkpoint(split_random(data, test_frac, key_cols, seed).withColumn("_row", F.monotonically_increasing_id()))
    n = split.count()
    if n < min_rows:
        return {"error": "too_few_rows", "rows": n, "needed": min_rows}
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    fm = fit_features(train, [c for c in CAT_COLS if c in feats], [c for c in REG_NUM_COLS if c in feats],
                      "hash" if model == "forest" else "none" if solver == "absorb" else encoding, applied_to=split,
                      max_slots=ONEHOT_MAX_SLOTS if solver is None else None)
    if fm is None:
        return {"error": "no_features", "rows": n}
    columns = spark.createDataFrame([(i, c) for i, c in enumerate([*fm.cat_cols, *fm.num_cols])], "position int, column string")
    if model == "forest":
        pred, imp = _forest(fm, split, test, key_cols, num_trees, max_depth, seed)
        metrics = regression_metrics(pred).select(F.lit(model).alias("model"), F.lit(n).cast("long").alias("rows"), "*")
        return {"metrics": metrics, "predictions": pred, "importances": imp, "features": columns,
                "feature_names": [*fm.cat_cols, *fm.num_cols]}
    if model not in ("linear", "ridge"):
        raise ValueError(f"unknown model {model!r}")
    if fm.encoding == "none":
        pred, imp = _absorbed(fm, train, test, key_cols, RIDGE_ALPHA if model == "ridge" else 0.0)
        metrics = regression_metrics(pred).select(F.lit(model).alias("model"), F.lit(n).cast("long").alias("rows"), "*")
        return {"metrics": metrics, "predictions": pred, "importances": imp, "features": columns}
    tr = fm.transform(train).select(*key_cols, "features", "label")
    te = fm.transform(test).select(*key_cols, "features", "label")
    solver = solver or linear_solver(fm.size)
    reg = 0.0
    if model == "ridge":
        # the solvers scale the penalty by the label's deviation, each by its own
        st = train.agg(F.count(F.lit(1)).alias("n"),
                       (F.stddev_pop("label") if solver == "normal" else F.stddev_samp("label")).alias("sd")).first()
        reg = RIDGE_ALPHA * (st["sd"] or 0.0) / st["n"]
    est = LinearRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=0.0,
                           standardization=False, solver=solver, maxIter=1000, tol=1e-6)
    fitted = est.fit(tr)
    pred = (fitted.transform(te)
            .select(*key_cols, F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
            .withColumn("residual", F.col("actual") - F.col("predicted")))
    imp = _top20(spark, fm, fitted.coefficients.toArray(), True, "linear")
    metrics = regression_metrics(pred).select(F.lit(model).alias("model"), F.lit(n).cast("long").alias("rows"), "*")
    return {"metrics": metrics, "predictions": pred, "importances": imp, "features": columns, "feature_names": fm.names}


def _widest(fm) -> tuple[str, list[str]]:
    """The imputed categorical column with the most levels, and the others."""
    cats = sorted(fm.cat_cols, key=lambda c: -fm.levels[c])
    return f"_f_{cats[0]}", [f"_f_{c}" for c in fm.cat_cols if c != cats[0]]


def _absorbed(fm, train: DataFrame, test: DataFrame, key_cols, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Predictions and the largest coefficients of a linear model whose widest
    categorical column is absorbed (absorb.py): no vocabulary, coefficient
    vector or Gram matrix of that column leaves the executors."""
    if not fm.cat_cols:
        raise ValueError("a categorical column is needed to absorb")
    wide, rest = _widest(fm)
    fitted = fit_absorbed(fm.impute(train), wide, rest, {f"_f_{c}": fm.scales[c] for c in fm.num_cols}, "label", alpha)
    pred = fitted.predict(fm.impute(test)).select(*key_cols, F.col("label").alias("actual"), "predicted")
    pred = computed_once(pred.withColumn("residual", F.col("actual") - F.col("predicted")))
    size = F.abs("value")
    top = fitted.coefficients().select(F.regexp_replace("feature", "^_f_", "").alias("feature"), "value")
    top = top.orderBy(size.desc(), "feature").limit(TOP_IMPORTANCES)
    rank = F.row_number().over(Window.orderBy(size.desc(), "feature"))  # over TOP_IMPORTANCES rows
    return pred, top.select(rank.alias("rank"), "feature", "value", F.lit("linear").alias("type"))


def _forest(fm, split: DataFrame, test: DataFrame, key_cols, num_trees: int, max_depth: int | None,
            seed: int) -> tuple[DataFrame, DataFrame]:
    """Predictions of the test rows and importances (rank, feature, value,
    type) of a forest over imputed, otherwise untouched columns."""
    names = [f"c{i}" for i in range(len(fm.cat_cols))] + [f"x{i}" for i in range(len(fm.num_cols))]
    values = [F.xxhash64(f"_f_{c}") for c in fm.cat_cols] + [F.col(f"_f_{c}") for c in fm.num_cols]
    rows = computed_once(fm.impute(split).select(
        F.col("_row").alias("row"), F.xxhash64(*[_key_text(split, k) for k in key_cols]).alias("key"), F.col("label").alias("y"),
        "is_test", *[v.alias(n) for v, n in zip(values, names)]))
    predicted, shares = forest(rows, names, [True] * len(fm.cat_cols) + [False] * len(fm.num_cols), num_trees, FOREST_MIN_LEAF, seed,
                               max_depth=max_depth)
    pred = (test.join(predicted.withColumnRenamed("row", "_row"), "_row")
            .select(*key_cols, F.col("label").alias("actual"), "predicted")
            .withColumn("residual", F.col("actual") - F.col("predicted")))
    named = F.create_map(*[F.lit(x) for n, c in zip(names, [*fm.cat_cols, *fm.num_cols]) for x in (n, c)])
    top = shares.orderBy(F.desc("value"), "feature").limit(TOP_IMPORTANCES)  # at most one row a column
    ranked = top.select(F.row_number().over(Window.orderBy(F.desc("value"), "feature")).alias("rank"),
                        F.element_at(named, F.col("feature")).alias("feature"), "value", F.lit("rf").alias("type"))
    return computed_once(pred), computed_once(ranked)


def ideal_line(pred: DataFrame) -> DataFrame:
    """The y = x reference segment from min to max actual."""
    return pred.agg(F.min("actual").alias("lo"), F.max("actual").alias("hi"))


# --- classification ---------------------------------------------------------------

def high_value_labels(df: DataFrame, key_cols, cutoff_p: float = HIGH_VALUE_Q, value: str = "sales", stored: bool = False):
    """(rows with label = value >= the exact p-quantile, cutoff). ``stored``:
    ``df`` is read from files by column, so its values are not written again."""
    v = finite_label_rows(df, value)
    q = exact_quantiles(v.select(F.col(value).cast("double").alias("_v")), "_v", [cutoff_p], names=["cut"], stored=stored).first()
    cut = q["cut"] if q else None  # no row, no cut-off
    return v.withColumn("label", (F.col(value).cast("double") >= F.lit(cut)).cast("int")), cut


def fit_classifier(df: DataFrame, key_cols=None, test_frac: float = CLS_TEST_FRAC, seed: int = 0,
                   min_rows: int = CLS_MIN_ROWS, min_per_class: int = CLS_MIN_PER_CLASS, max_iter: int = 1000,
                   encoding: str = "onehot", max_slots: int | None = None) -> dict:
    """High-value order classifier: label = sales >= its 0.75 quantile;
    balanced-weight L2 logistic regression (C = 1) on the categorical and
    numeric features (note: profit is a feature while sales sets the label,
    as in the surveyed dashboard); stratified 25 % test split. One-hot columns
    of over ``max_slots`` (ONEHOT_MAX_SLOTS) levels are not gathered: the widest
    is absorbed (absorb.py), by Newton steps on the same loss.

    Returns {'error'} or {'summary', 'predictions'} where predictions has
    (key, label, score, pred) per test row."""
    from ordertide.sources.sales import ROW_KEY
    key_cols = list(key_cols or ROW_KEY)
    feats = [c for c in [*CAT_COLS, *CLS_NUM_COLS] if c in df.columns]
    data = finite_label_rows(df, "sales").select(*key_cols, *[c for c in feats if c not in key_cols], "sales")
    data = data.withColumn("_u", hash_uniform(key_cols, seed, data))
    # the star join runs and the keys are hashed once for every pass below; labels and split are read from that table's columns
    with written_meanwhile(data, "classifier-rows") as data:
        return _fit_classifier(data, key_cols, feats, test_frac, min_rows, min_per_class, max_iter, encoding, max_slots)


def _fit_classifier(data: DataFrame, key_cols: list[str], feats: list[str], test_frac: float, min_rows: int, min_per_class: int,
                    max_iter: int, encoding: str, max_slots: int | None) -> dict:
    """``fit_classifier`` on its stored rows with the hash ``_u`` of their keys; its results read none of them."""
    spark = data.sparkSession
    n = data.count()
    if n < min_rows:
        return {"error": "too_few_rows", "rows": n, "needed": min_rows}
    labeled, cut = high_value_labels(data, key_cols, stored=True)
    counts = {r["label"]: r["count"] for r in labeled.groupBy("label").count().collect()}  # <= 2 rows
    if len(counts) < 2 or min(counts.values()) < min_per_class:
        return {"error": "unbalanced_classes", "rows": n, "smallest": min(counts.values()) if len(counts) > 1 else 0,
                "needed": min_per_class}
    pos_rate = counts.get(1, 0) / n
    last = {r["_class"]: r["_cut"] for r in _last_hashes(labeled.select("label", "_u"), "label", test_frac).collect()}  # 2 rows
    is_test = F.col("_u") <= F.when(F.col("label") == 1, F.lit(last[1])).otherwise(F.lit(last[0]))
    split = labeled.withColumn("is_test", is_test).select(*key_cols, *[c for c in feats if c not in key_cols], "label", "is_test")
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    tc = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n_train = sum(tc.values())
    weights = {k: n_train / (2.0 * v) for k, v in tc.items()}
    fm = fit_features(train, CAT_COLS, CLS_NUM_COLS, encoding, applied_to=data,
                      max_slots=ONEHOT_MAX_SLOTS if max_slots is None else max_slots)
    if fm is None:
        return {"error": "no_features", "rows": n}
    wcol = F.when(F.col("label") == 1, F.lit(weights.get(1, 1.0))).otherwise(F.lit(weights.get(0, 1.0)))
    if fm.encoding == "none":
        # the same loss: weighted log losses plus half the squared coefficients
        wide, rest = _widest(fm)
        model = fit_absorbed(fm.impute(train.withColumn("_w", wcol)), wide, rest, {f"_f_{c}": fm.scales[c] for c in fm.num_cols}, "label",
                             1.0, logistic=True, weight="_w")
        pred = model.predict(fm.impute(test), "_odds").select(
            *key_cols, F.col("label").cast("int").alias("label"), (1 / (1 + F.exp(-F.col("_odds")))).alias("score"))
    else:
        tr = fm.transform(train).select("features", F.col("label").cast("double").alias("label"), wcol.alias("w"))
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=1.0 / n_train,
                                elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6,
                                fitIntercept=True, family="binomial")
        model = lr.fit(tr)
        pred = (model.transform(fm.transform(test))
                .select(*key_cols, F.col("label").cast("int").alias("label"),
                        vector_to_array("probability")[1].alias("score")))
    # scored once, read by the matrix and the curves
    pred = computed_once(pred.withColumn("pred", (F.col("score") >= 0.5).cast("int")))
    summary = spark.createDataFrame(
        [(float(cut), float(pos_rate), int(n), int(n_train))],
        "threshold double, positive_rate double, rows long, train_rows long")
    return {"summary": summary, "predictions": pred, "model": model, "feature_names": fm.names,
            "threshold": cut}
