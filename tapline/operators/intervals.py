"""Prediction / confidence intervals (M1b, M1d, M1e, M1f).

Scalars (RMSE, n, fold metrics) come from one aggregate; critical values
are computed once on the driver; the interval itself is a column
expression applied to every scored row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import norm_ppf, t_ppf


def rmse_scalars(df: DataFrame, y: str, p: str) -> tuple[float, int]:
    r = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(
        F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2)).alias("rmse"), F.count(F.lit(1)).alias("n")).first()
    return float(r["rmse"] or 0.0), int(r["n"])


def pi_rmse(df: DataFrame, p: str, rmse: float, n: int, n_features: int = 1,
            alpha: float = 0.05, out_prefix: str = "pi") -> DataFrame:
    """ŷ ± t(1-α/2, max(n-p-1, 1)) · RMSE · √(1 + 1/n)."""
    dof = max(n - n_features - 1, 1)
    half = t_ppf(1 - alpha / 2, dof) * rmse * math.sqrt(1 + 1 / n)
    return df.withColumns({f"{out_prefix}_lo": F.col(p) - F.lit(half),
                           f"{out_prefix}_hi": F.col(p) + F.lit(half)})


def ci_vs_pi(rmse: float, n: int, n_features: int = 1, alpha: float = 0.05) -> dict:
    """M1d: mean-response CI half-width vs single-observation PI half-width."""
    dof = max(n - n_features - 1, 1)
    t = t_ppf(1 - alpha / 2, dof)
    return {"t_crit": t, "ci_half": t * rmse / math.sqrt(n), "pi_half": t * rmse * math.sqrt(1 + 1 / n)}


def cv_ci(fold_metrics: DataFrame, metric: str = "r2", alpha: float = 0.05) -> DataFrame:
    """M1e: mean ± t·s/√k of per-fold metrics, clipped to [0, 1]."""
    k = fold_metrics.count()  # number of folds: a handful of rows
    t = t_ppf(1 - alpha / 2, max(k - 1, 1))
    g = fold_metrics.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
                         F.count(F.lit(1)).alias("k"))
    half = F.lit(t) * F.col("std") / F.sqrt(F.col("k"))
    return g.select("k", "mean", "std", F.greatest(F.lit(0.0), F.col("mean") - half).alias("ci_lo"),
                    F.least(F.lit(1.0), F.col("mean") + half).alias("ci_hi"))


def kfold_index(df: DataFrame, k: int, order: str, out: str = "fold") -> DataFrame:
    """Contiguous K-fold ids in ``order`` (unshuffled KFold: first n % k folds one larger)."""
    from .windows import prefix_sum
    x = df.withColumn("__one", F.lit(1))
    x = prefix_sum(x, order, ["__one"], inclusive=False, fmt="__r", total_fmt="__n")  # 0-based row index, distributed
    n, r = F.col("__n"), F.col("__r")
    big = F.floor(n / k) + 1
    nbig = n % k
    fold = F.when(r < nbig * big, F.floor(r / big)).otherwise(nbig + F.floor(F.try_divide(r - nbig * big, F.floor(n / k))))
    return x.withColumn(out, fold.cast("int")).drop("__one", "__r", "__n")
