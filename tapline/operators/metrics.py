"""Evaluation operators (L1-L9) as plain aggregates.

Everything is computed from per-group sums / confusion counts, so a
metric over billions of scored rows is one partial+final aggregate; only
the (class × class) confusion table — bounded by the label set — is
ever windowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggs import _by
from .windows import prefix_sum


def regression_metrics(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """L1: R² = 1 − SSE/SST (SST = n·var_pop), MAE, RMSE, n; rows with a prediction."""
    keys = _by(by)
    x = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = F.col(y) - F.col(p)
    g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"),
                             (F.var_pop(y) * F.count(F.lit(1))).alias("sst"),
                             F.avg(F.abs(e)).alias("mae"))
    return g.select(*keys, "n", (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"),
                    "mae", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def confusion_counts(df: DataFrame, actual: str, pred: str, by=None) -> DataFrame:
    keys = _by(by)
    return df.groupBy(*keys, F.col(actual).alias("actual"), F.col(pred).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, actual: str, pred: str, by=None) -> DataFrame:
    """Per-class tp / predicted / support with zero-division → 0 precision/recall/F1."""
    keys = _by(by)
    cc = confusion_counts(df, actual, pred, by)
    tp = cc.where(F.col("actual") == F.col("predicted")).select(*keys, F.col("actual").alias("cls"),
                                                                  F.col("n").alias("tp"))
    sup = cc.groupBy(*keys, F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    prd = cc.groupBy(*keys, F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    t = sup.join(prd, [*keys, "cls"], "full").join(tp, [*keys, "cls"], "left").fillna(0, ["support", "n_pred", "tp"])
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return t.withColumn("f1", f1)


def classification_metrics(df: DataFrame, actual: str, pred: str, by=None) -> DataFrame:
    """L2: accuracy and macro precision / recall / F1 (zero division → 0)."""
    keys = _by(by)
    pc = per_class(df, actual, pred, by)
    return pc.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"))


def class_report(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """L3: per-class rows plus 'macro avg' and 'weighted avg' rows."""
    pc = per_class(df, actual, pred).select(F.col("cls").alias("label"), "precision", "recall", "f1", "support")
    tot = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    wavg = pc.agg(F.lit("weighted avg").alias("label"),
                  (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                  (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                  (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    return pc.unionByName(macro).unionByName(wavg)


def confusion_matrix(df: DataFrame, actual: str, pred: str, by=None) -> DataFrame:
    """L4: long confusion table with row-normalised share."""
    keys = _by(by)
    cc = confusion_counts(df, actual, pred, by)
    w = Window.partitionBy(*keys, "actual")  # window over the label×label table only
    return cc.withColumn("row_share", F.col("n") / F.sum("n").over(w))


def _per_score(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """(cls_i, label, s, cnt, npos): one row per (class, distinct score) — every class in one table."""
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("cls_i"), F.lit(c).alias("label"),
                                         F.col(sc).cast("double").alias("s"),
                                         (F.col(actual) == F.lit(c)).cast("long").alias("pos"))
                                for i, (c, sc) in enumerate(scores.items())]))
    x = df.select(parts.alias("r")).select("r.*")
    return x.groupBy("cls_i", "label", "s").agg(F.count(F.lit(1)).alias("cnt"), F.sum("pos").alias("npos"))


def roc_auc_ovr(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """One-vs-rest AUC per class by the Mann-Whitney mid-rank formula + macro row.

    Mid-ranks need a running count over the sorted scores: one distributed
    ``prefix_sum`` by class.
    """
    g = _per_score(df, actual, scores)
    g = prefix_sum(g, "s", ["cnt"], by="cls_i", inclusive=False, fmt="__below")
    g = g.withColumn("midrank", F.col("__below") + (F.col("cnt") + 1) / 2.0)
    a = g.groupBy("label").agg(F.sum(F.col("npos") * F.col("midrank")).alias("rsum"),
                               F.sum("npos").alias("np"), F.sum("cnt").alias("n"))
    out = a.select("label", F.try_divide(F.col("rsum") - F.col("np") * (F.col("np") + 1) / 2.0,
                                         F.col("np") * (F.col("n") - F.col("np"))).alias("auc"))
    macro = out.agg(F.lit("macro").alias("label"), F.avg("auc").alias("auc"))
    return out.unionByName(macro)


def roc_curve(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """Per-class ROC points (threshold, fpr, tpr) at every distinct score, one pass."""
    g = _per_score(df, actual, scores).withColumn("fp_at", F.col("cnt") - F.col("npos"))
    g = prefix_sum(g, "s", ["npos", "fp_at"], by="cls_i", desc=True, total_fmt="{c}_all")
    return g.select("label", F.col("s").alias("threshold"), F.try_divide("fp_at_cum", "fp_at_all").alias("fpr"),
                    F.try_divide("npos_cum", "npos_all").alias("tpr"))


def macro_roc(points: DataFrame, grid: int = 200) -> DataFrame:
    """Macro-average ROC: every class's curve from (0, 0), linearly interpolated at ``grid`` equal steps of fpr, averaged.

    Points are first reduced to the first and last of every grid cell per class
    (a plain aggregate), so the windows run over at most ``grid`` rows a class.
    Where a curve is vertical the upper end counts at its fpr.
    """
    step = float(grid - 1)
    start = points.select("label", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).distinct()
    x = points.select("label", "fpr", "tpr").unionByName(start)
    cells = x.groupBy("label", F.ceil(F.col("fpr") * step).cast("int").alias("i")).agg(
        F.min(F.struct("fpr", "tpr")).alias("first"), F.max(F.struct("fpr", "tpr")).alias("last"))
    frame = cells.select("label").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    w = Window.partitionBy("label").orderBy("i")
    y = frame.join(cells, ["label", "i"], "left").select(
        "label", "i", F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"),
        F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("b"))
    g = F.col("i") / step
    slope = (F.col("b.tpr") - F.col("a.tpr")) / (F.col("b.fpr") - F.col("a.fpr"))
    tpr = F.when(F.col("b").isNull(), F.col("a.tpr")).otherwise(F.col("a.tpr") + slope * (g - F.col("a.fpr")))
    return y.groupBy("i").agg(F.avg(tpr).alias("tpr")).select(F.col("i").alias("point_no"), (F.col("i") / step).alias("fpr"), "tpr")


def masked_metrics(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """Metrics only over rows where a prediction exists, plus the row count.

    One aggregate: the mask is applied inside each aggregate expression.
    """
    keys = _by(by)
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    e = F.when(ok, F.col(y) - F.col(p))
    yy = F.when(ok, F.col(y))
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(e).alias("n"),
                              F.sum(e * e).alias("sse"), (F.var_pop(yy) * F.count(yy)).alias("sst"),
                              F.avg(F.abs(e)).alias("mae"))
    return g.select(*keys, "n_rows", "n", (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"),
                    "mae", F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"))


def residual_stats(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """Bias (mean residual), population std, n."""
    keys = _by(by)
    r = F.col(y) - F.col(p)
    return df.where(r.isNotNull()).groupBy(*keys).agg(
        F.avg(r).alias("bias"), F.stddev_pop(r).alias("resid_std"), F.count(F.lit(1)).alias("n"))


def scorecard(metrics: DataFrame, row: str, col: str, value: str, cols: Sequence[str]) -> DataFrame:
    """Row × column matrix of a metric, absent cell → 0."""
    return metrics.groupBy(row).pivot(col, list(cols)).agg(F.first(value)).fillna(0.0, subset=list(cols))
