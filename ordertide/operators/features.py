"""Feature preparation for the supervised models (pyspark.ml based).

* categorical: most-frequent imputation (tie -> smallest value), then one-hot
  with every seen level kept and unseen levels encoded as all zeros
  (``StringIndexer(handleInvalid='keep')`` sends unseen values to one extra
  last index, and ``OneHotEncoder(dropLast=True)`` with its default
  ``handleInvalid='error'`` drops exactly that slot; the encoder's own
  'keep' would add a visible '__unknown' slot instead);
* numeric: median imputation, then division by the population std with no
  centring (a constant column keeps divisor 1).

All statistics are fitted on the training rows only. Modes and medians are
computed distributed: columns are stacked into (column, value) rows so one
aggregation (modes) or one range-partitioned rank (medians) serves all
columns, and no column's values are gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.functions.numeric import finite_or_null
from ordertide.operators.dist import exact_quantiles
from ordertide.operators.joins import computed_once

# The categorical and numeric feature columns of the two models.
CAT_COLS = ["ship_mode", "segment", "region", "state", "category", "sub_category", "product_id"]
REG_NUM_COLS = ["postal_code"]
CLS_NUM_COLS = ["postal_code", "quantity", "discount", "profit"]


def _stack(df: DataFrame, cols, cast: str) -> DataFrame:
    # numbers that are NaN or infinite count as missing
    as_value = (lambda c: finite_or_null(F.col(c).cast(cast))) if cast == "double" else (lambda c: F.col(c).cast(cast))
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), as_value(c).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.col", "p.value").where(F.col("value").isNotNull())


def mode_table(df: DataFrame, cols) -> DataFrame:
    """(col, value, count): most frequent non-NULL value per column, ties
    to the smallest (string order). One aggregation over stacked columns,
    then a per-column min over (-count, value) with map-side combine."""
    counts = _stack(df, cols, "string").groupBy("col", "value").count()
    best = counts.groupBy("col").agg(F.min(F.struct((-F.col("count")).alias("k"), F.col("value"))).alias("b"))
    return best.select("col", F.col("b.value").alias("value"), (-F.col("b.k")).alias("count"))


def median_table(df: DataFrame, cols) -> DataFrame:
    """(col, n, median): exact median (linear interpolation) of the finite
    values of each column; a column without any has no row."""
    return exact_quantiles(_stack(df, cols, "double"), "value", [0.5], group_cols=["col"], names=["median"])


def scale_table(df: DataFrame, cols) -> DataFrame:
    """(col, scale): population std per column, 1 when it is 0 or undefined."""
    row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    st = row.select(F.expr(f"stack({len(cols)}, {stack}) AS (col, sd)"))
    return st.select("col", F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)).alias("scale"))


def feature_name_table(df: DataFrame, cat_cols, num_cols) -> DataFrame:
    """(idx, name) of the one-hot + numeric feature vector, computed
    distributed: distinct levels ranked by (column position, level) with
    ``global_rank`` -- the slot order the fitted encoders produce."""
    from ordertide.operators.ranking import global_rank
    cat_cols = [c for c in cat_cols if c in df.columns]
    num_cols = [c for c in num_cols if c in df.columns]
    pos = F.create_map(*[x for i, c in enumerate(cat_cols) for x in (F.lit(c), F.lit(i))])
    levels = _stack(df, cat_cols, "string").distinct().withColumn("ord", pos[F.col("col")])
    ranked = global_rank(levels, ["ord", "value"], size_col="_n")
    cats = ranked.select((F.col("rank") - 1).cast("long").alias("idx"),
                         F.concat(F.col("col"), F.lit("_"), F.col("value")).alias("name"))
    if not num_cols:
        return cats
    n_levels = F.coalesce(levels.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    spark = df.sparkSession
    nums = spark.createDataFrame([(i, c) for i, c in enumerate(num_cols)], "j int, name string")
    nums = nums.select((n_levels + F.col("j")).cast("long").alias("idx"), "name")
    return cats.unionByName(nums)


def column_medians(df: DataFrame, cols) -> dict:
    if not cols:
        return {}
    return {r["col"]: r["median"] for r in median_table(df, cols).collect()}  # one row per column


def missing_columns(df: DataFrame, cols) -> list:
    """The numeric columns with a value that is NULL, NaN or infinite (one pass)."""
    if not cols:
        return []
    row = df.agg(*[F.count(F.when(finite_or_null(F.col(c).cast("double")).isNull(), F.lit(1))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


@dataclass
class FeatureModel:
    cat_cols: list
    num_cols: list
    modes: dict
    medians: dict
    scales: dict
    indexer: object = None
    encoder: object = None
    names: list = field(default_factory=list)
    encoding: str = "onehot"
    hash_features: int = 1 << 18
    levels: dict = field(default_factory=dict)

    def impute(self, df: DataFrame) -> DataFrame:
        """Add the imputed columns (``_f_`` and the column's name); the columns
        themselves, row keys among them, stay as they are."""
        fills = {}
        for c in self.cat_cols:
            fills[f"_f_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c)))
        for c in self.num_cols:
            fills[f"_f_{c}"] = F.coalesce(finite_or_null(F.col(c).cast("double")), F.lit(self.medians.get(c)).cast("double"))
        return df.withColumns(fills)

    def index(self, df: DataFrame) -> DataFrame:
        for m in self.indexer:
            df = m.transform(df)
        return df

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with the feature vector ``out``, all its own columns kept."""
        x = self.impute(df)
        parts = []
        if self.cat_cols and self.encoding == "hash":
            cats = [f"_f_{c}" for c in self.cat_cols]
            x = FeatureHasher(inputCols=cats, outputCol="_cat_hashed", numFeatures=self.hash_features,
                              categoricalCols=cats).transform(x)
            parts.append("_cat_hashed")
        elif self.cat_cols:
            x = self.encoder.transform(self.index(x))
            parts += [f"_oh_{c}" for c in self.cat_cols]
        x = x.withColumns({f"_s_{c}": F.col(f"_f_{c}") / F.lit(self.scales[c]) for c in self.num_cols})
        parts += [f"_s_{c}" for c in self.num_cols]
        x = VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep").transform(x)
        # drop the per-slot attribute metadata (one entry per level): every
        # later plan would carry it; names live in ``names`` / ``name_of``
        return x.select(*[F.col(c) for c in df.columns if c != out], F.col(out).alias(out, metadata={}))

    @property
    def size(self) -> int:
        if self.encoding == "hash":
            return (self.hash_features if self.cat_cols else 0) + len(self.num_cols)
        return len(self.names)

    def name_of(self, i: int) -> str:
        if self.encoding == "hash":
            h = self.hash_features if self.cat_cols else 0
            return f"hash_{i}" if i < h else self.num_cols[i - h]
        return self.names[i]


def fit_features(train: DataFrame, cat_cols, num_cols, encoding: str = "onehot",
                 hash_features: int = 1 << 18, applied_to: DataFrame | None = None,
                 max_slots: int | None = None) -> FeatureModel | None:
    """Fit imputers, encoders and scales on ``train``; columns that are
    absent or have no value are skipped (schema-adaptive, as the dashboards
    are). None when no column is left.

    ``encoding='onehot'`` (default, as the dashboards) keeps one slot per
    seen level; its vocabulary is model state on the driver, which bounds it
    by driver memory. ``encoding='hash'`` is the scale option for columns
    with billions of levels: levels are hashed into ``hash_features`` slots
    (stateless, nothing collected), at the price of rare collisions. With
    ``max_slots`` a one-hot vocabulary that would have more slots is not
    gathered: the model then has ``encoding`` 'none', imputes and scales only,
    and knows how many ``levels`` each column has.

    One aggregation counts every (column, level) pair into a small stored
    table. Modes come from it with a per-column min over (-count, level),
    and each column's alphabetical ``StringIndexer`` is fitted on that small
    table instead of another pass over the training rows. (Imputation only
    fills NULLs with an existing level, so the level set is unchanged.)
    Medians are selected only for columns that miss a value somewhere in
    ``applied_to`` (all rows that the model will see; default ``train``)."""
    cat_cols = [c for c in cat_cols if c in train.columns]
    num_cols = [c for c in num_cols if c in train.columns]
    modes: dict[str, str] = {}
    levels: dict[str, int] = {}
    indexers = []
    if cat_cols:
        counts = computed_once(_stack(train, cat_cols, "string").groupBy("col", "value").count())
        best = counts.groupBy("col").agg(F.min(F.struct((-F.col("count")).alias("k"), F.col("value"))).alias("b"),
                                         F.count(F.lit(1)).alias("levels")).collect()  # one row per column
        modes = {r["col"]: r["b"]["value"] for r in best}
        levels = {r["col"]: r["levels"] for r in best}
        cat_cols = [c for c in cat_cols if c in modes]
        if encoding == "onehot" and max_slots is not None and sum(levels.values()) + len(num_cols) > max_slots:
            encoding = "none"
        if encoding == "onehot":
            def fit_one(c):
                m = StringIndexer(inputCol="value", outputCol=f"_ix_{c}", handleInvalid="keep",
                                  stringOrderType="alphabetAsc").fit(counts.where(F.col("col") == c))
                return m.setInputCol(f"_f_{c}")

            with ThreadPoolExecutor(max_workers=8) as pool:
                indexers = list(pool.map(fit_one, cat_cols))
    if num_cols:
        some = train.agg(*[F.count(finite_or_null(F.col(c).cast("double"))).alias(c) for c in num_cols]).first()
        num_cols = [c for c in num_cols if some[c]]
    if not cat_cols and not num_cols:
        return None
    medians = column_medians(train, missing_columns(applied_to if applied_to is not None else train, num_cols))
    fm = FeatureModel(cat_cols, num_cols, modes, medians, {}, encoding=encoding, hash_features=hash_features, levels=levels)
    imputed = fm.impute(train)
    if num_cols:
        std = imputed.agg(*[F.stddev_pop(f"_f_{c}").alias(c) for c in num_cols]).first()
        fm.scales = {c: (std[c] if std[c] and std[c] > 0 else 1.0) for c in num_cols}
    fm.indexer = indexers
    if cat_cols and encoding == "onehot":
        fm.encoder = OneHotEncoder(inputCols=[f"_ix_{c}" for c in cat_cols], outputCols=[f"_oh_{c}" for c in cat_cols],
                                   dropLast=True).fit(fm.index(imputed))
    fm.names = [f"{c}_{x}" for c, m in zip(cat_cols, indexers) for x in m.labels] + list(num_cols) if encoding != "none" else []
    return fm
