"""Classifier evaluation curves from (label, score) rows, all distributed.

Scores are first collapsed to one row per distinct score with its positive
and negative counts (partial aggregation), then ``global_rank`` gives the
cumulative counts in descending-score order without a single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.operators.ranking import global_rank


def score_table(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score (descending): tp, fp, cumulative tps/fps, rank, and
    the totals p and n, from one pass over the rows."""
    g = (pred.groupBy(F.col(score).alias("threshold"))
         .agg(F.sum(F.col(label).cast("long")).alias("tp"),
              F.sum((1 - F.col(label)).cast("long")).alias("fp")))
    r = global_rank(g, [("threshold", False)], sum_cols=["tp", "fp"], size_col="m", total_sums=True)
    return r.select("threshold", "tp", "fp", "rank", "m",
                    F.col("cum_tp").cast("long").alias("tps"), F.col("cum_fp").cast("long").alias("fps"),
                    F.col("total_tp").alias("p"), F.col("total_fp").alias("n"))


def _share(part, whole):
    """part / whole as double, NaN when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(float("nan")))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score",
              drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) points, starting at (0, 0) with threshold +inf.
    With ``drop_intermediate``, points whose fps and tps both have zero second
    difference (interior of a straight run) are dropped; neighbours are
    fetched by equi-joins on rank +- 1. Without rows only the start is left."""
    st = score_table(pred, label, score)
    pts = st
    if drop_intermediate:
        prev = st.select((F.col("rank") + 1).alias("rank"), F.col("tps").alias("p_tps"), F.col("fps").alias("p_fps"))
        nxt = st.select((F.col("rank") - 1).alias("rank"), F.col("tps").alias("n_tps"), F.col("fps").alias("n_fps"))
        j = st.join(prev, "rank", "left").join(nxt, "rank", "left")
        d2f = F.col("n_fps") - 2 * F.col("fps") + F.col("p_fps")
        d2t = F.col("n_tps") - 2 * F.col("tps") + F.col("p_tps")
        pts = j.where((F.col("rank") == 1) | (F.col("rank") == F.col("m")) | (d2f != 0) | (d2t != 0))
    start = pred.sparkSession.createDataFrame([(0, 0.0, 0.0, float("inf"))],
                                              "rank long, fpr double, tpr double, threshold double")
    return start.unionByName(pts.select(F.col("rank").cast("long").alias("rank"), _share(F.col("fps"), F.col("n")).alias("fpr"),
                                        _share(F.col("tps"), F.col("p")).alias("tpr"), "threshold"))


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, summed per distinct
    score: fp_g * (tps_before + tps_after) / 2 / (P * N)."""
    st = score_table(pred, label, score)
    area = F.sum(F.col("fp").cast("double") * (2 * F.col("tps") - F.col("tp")).cast("double") / 2.0)
    return st.agg(_share(area, F.max("p") * F.max("n")).alias("roc_auc"))


def pr_curve(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(recall, precision, threshold) per distinct score plus the final
    (recall 0, precision 1) point."""
    st = score_table(pred, label, score)
    pts = st.select(F.col("rank").cast("long").alias("rank"), _share(F.col("tps"), F.col("p")).alias("recall"),
                    F.try_divide(F.col("tps").cast("double"), (F.col("tps") + F.col("fps")).cast("double"))
                    .alias("precision"), "threshold")
    end = pred.sparkSession.createDataFrame([(0, 0.0, 1.0, None)],
                                            "rank long, recall double, precision double, threshold double")
    return pts.unionByName(end)


def average_precision(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Sum over thresholds of (R_n - R_{n-1}) * P_n."""
    st = score_table(pred, label, score)
    term = _share(F.col("tp"), F.col("p")) * (F.col("tps").cast("double") / (F.col("tps") + F.col("fps")).cast("double"))
    return st.agg(F.sum(term).alias("average_precision"))


def confusion_matrix(pred: DataFrame, label: str = "label", predicted: str = "pred") -> DataFrame:
    """The 2x2 matrix as 4 rows (actual, predicted, count), labels [0, 1]
    always present: one aggregate pass, then a stack."""
    a, p = F.col(label), F.col(predicted)
    c = pred.agg(*[F.count(F.when((a == i) & (p == j), F.lit(1))).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    return c.select(F.expr("stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) AS (actual, predicted, count)"))


def accuracy(cm: DataFrame) -> DataFrame:
    return cm.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0))
                   / F.greatest(F.sum("count"), F.lit(1))).alias("accuracy"))


def class_flow(cm: DataFrame) -> DataFrame:
    """Actual -> predicted edges with counts (the flow diagram)."""
    names = {0: "Low", 1: "High"}
    src = F.when(F.col("actual") == 1, F.lit(f"Actual: {names[1]}")).otherwise(F.lit(f"Actual: {names[0]}"))
    dst = F.when(F.col("predicted") == 1, F.lit(f"Pred: {names[1]}")).otherwise(F.lit(f"Pred: {names[0]}"))
    return cm.select(src.alias("source"), dst.alias("target"), F.col("count").alias("value"))
