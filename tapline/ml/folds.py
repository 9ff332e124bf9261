"""Ridge cross-validation from moments (J11, M1e): one aggregate serves every fold, target and penalty.

Each fold yields its row count, means and covariances of inputs and targets (Spark's merging
aggregates, stable for large means). The training moments of a fold are the other folds'
moments pooled, and the error on the fold follows from its own moments, so no model job and no
second scan runs per fold. The driver holds folds × (inputs + targets)² numbers.

Rows with a NULL in an input, target or fold are left out. A fold without rows gives no row
back; a constant target in a fold has no R² (NULL); a single fold is a ValueError.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_moments(df: DataFrame, cols: Sequence[str], fold: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Fold → (rows, means, population covariances) of ``cols``; one scan, one partial aggregate."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    agg = df.dropna(subset=[*cols, fold]).groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("m"),
        F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("c"))
    out = {}
    for r in agg.toLocalIterator():  # one row a fold
        cov = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, r["c"]):
            cov[i, j] = cov[j, i] = v
        out[r[fold]] = r["n"], np.array(r["m"], float), cov
    return out


def pooled(parts) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of the union of disjoint row sets."""
    parts = list(parts)
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n


def ridge_cv(df: DataFrame, features: Sequence[str], targets: Sequence[str], fold: str = "fold",
             alphas: Sequence[float] = (1.0,)) -> DataFrame:
    """Per target, penalty and fold: R² and RMSE on the fold of ‖y − Xβ − b‖² + α‖β‖² fitted on the others."""
    features, targets, d = list(features), list(targets), len(features)
    moments = fold_moments(df, features + targets, fold)
    if len(moments) == 1:
        raise ValueError("cross-validation needs rows in at least two folds")
    rows = []
    for k in sorted(moments):
        n, mean, cov = pooled(m for f, m in moments.items() if f != k)
        size, here, spread = moments[k]
        for alpha in alphas:
            for i, t in enumerate(targets, d):
                beta = np.linalg.solve(n * cov[:d, :d] + alpha * np.eye(d), n * cov[:d, i])
                bias = (here[i] - mean[i]) - beta @ (here[:d] - mean[:d])
                mse = spread[i, i] - 2 * beta @ spread[:d, i] + beta @ spread[:d, :d] @ beta + bias ** 2
                r2 = float(1 - mse / spread[i, i]) if spread[i, i] > 0 else None
                rows.append((t, float(alpha), int(k), int(size), r2, float(max(mse, 0.0) ** 0.5)))
    return df.sparkSession.createDataFrame(rows, "target string, alpha double, fold int, n long, r2 double, rmse double")
