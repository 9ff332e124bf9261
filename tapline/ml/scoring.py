"""Batch scoring, explanation and what-if operators.

A "request" is a row of a DataFrame, so one call scores any number of
requests in parallel.  Contributions and sensitivity curves expand each
request/feature into a bounded number of rows (features × grid points)
with ``explode`` and score them in one ``transform``; no Python loop runs
per request.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..functions.dist import t_ppf
from . import models as M
from .training import CLASS_LABELS, UNITS


def train_means(fit: dict) -> dict:
    train = fit["split"].where("split = 'train'")
    r = train.agg(*[F.avg(c).alias(c) for c in fit["features"]]).first()
    return {c: float(r[c]) if r[c] is not None else 0.0 for c in fit["features"]}


def default_fill(req: DataFrame, means: dict) -> DataFrame:
    """I8: missing request inputs take the training mean."""
    cols = {c: F.coalesce(F.col(c), F.lit(v)) if c in req.columns else F.lit(v) for c, v in means.items()}
    return req.withColumns(cols)


def score_regression(fit: dict, req: DataFrame, target: str, model_name: str, r2: float | None = None) -> DataFrame:
    """O1: default-fill → scale → predict; unit, model and hold-out R² attached."""
    x = fit["pm"].transform(default_fill(req, train_means(fit)))
    return x.withColumns({"target": F.lit(target), "unit": F.lit(UNITS.get(target, "")),
                          "model": F.lit(model_name), "r2_test": F.lit(r2)})


def score_classification(fit: dict, req: DataFrame, model_name: str) -> DataFrame:
    """O2: predicted class + class→probability map."""
    x = fit["pm"].transform(default_fill(req, train_means(fit)))
    x = x.withColumn("pred_label", F.element_at(F.array(*[F.lit(c) for c in CLASS_LABELS]),
                                                F.col("prediction").cast("int") + 1))
    if "probability" in x.columns:
        x = M.probability_map(x, CLASS_LABELS)
    else:  # one-vs-rest: normalised per-class margins
        raw = vector_margins(x)
        x = x.withColumn("probabilities", raw)
    return x.withColumn("model", F.lit(model_name))


def vector_margins(x: DataFrame):
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("rawPrediction")
    ex = F.transform(arr, lambda v: F.exp(v))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    return F.map_from_arrays(F.array(*[F.lit(c) for c in CLASS_LABELS]), F.transform(ex, lambda v: v / tot))


def rmse_interval(scored: DataFrame, rmse: float, n: int, p: int, alpha: float = 0.05) -> DataFrame:
    dof = max(n - p - 1, 1)
    half = t_ppf(1 - alpha / 2, dof) * rmse * math.sqrt(1 + 1 / max(n, 1))
    return scored.withColumns({"pi_lo": F.col("prediction") - F.lit(half), "pi_hi": F.col("prediction") + F.lit(half)})


def spec_status(df: DataFrame, target_col: str = "target", value: str = "prediction",
                limits: dict | None = None) -> DataFrame:
    """I4 via a constant-size limits map (no join)."""
    limits = limits or K.SPEC_LIMITS
    lo = F.create_map(*[x for k, (a, _) in limits.items() for x in (F.lit(k), F.lit(float(a)))])
    hi = F.create_map(*[x for k, (_, b) in limits.items() for x in (F.lit(k), F.lit(float(b)))])
    slo, shi = F.try_element_at(lo, F.col(target_col)), F.try_element_at(hi, F.col(target_col))
    ok = S.in_spec(value, slo, shi)
    return df.withColumns({"spec_lo": slo, "spec_hi": shi, "in_spec": ok,
                           "status": F.when(ok, "in spec").otherwise("out of spec")})


def contributions(fit: dict, req: DataFrame, key: str, classification: bool = False) -> DataFrame:
    """For each request × feature, prediction with only that feature at the request
    value (others at the training mean) minus the all-mean baseline.
    The classification variant is value − mean (no model call)."""
    means = train_means(fit)
    feats = fit["features"]
    vals = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats])
    x = req.select(key, F.explode(vals).alias("fv")).select(key, "fv.feature", "fv.value")
    if classification:
        mean_map = F.create_map(*[v for f, m in means.items() for v in (F.lit(f), F.lit(m))])
        return x.withColumn("contribution", F.col("value") - F.try_element_at(mean_map, F.col("feature")))
    x = x.withColumns({f: F.when(F.col("feature") == f, F.coalesce(F.col("value"), F.lit(means[f])))
                       .otherwise(F.lit(means[f])) for f in feats})
    base = fit["pm"].transform(req.sparkSession.range(1).select(*[F.lit(m).alias(f) for f, m in means.items()]))
    b = base.select("prediction").first()[0]
    out = fit["pm"].transform(x).select(key, "feature", "value", (F.col("prediction") - F.lit(b)).alias("contribution"))
    w = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), F.col("feature"))
    return out.withColumn("rank", F.row_number().over(w))  # window per request (≤ #features rows)


def sensitivity_curves(fits: dict, table: DataFrame, features: Sequence[str],
                       points: int = K.SENSITIVITY_POINTS) -> DataFrame:
    """Each feature swept over ``points`` values p01..p99, others at the mean;
    both targets scored.  ``fits`` maps target → fit dict sharing one feature list."""
    feats = list(dict.fromkeys(list(features) + [f for fit in fits.values() for f in fit["features"]]))
    mr = table.agg(*[F.avg(f).alias(f) for f in feats]).first()
    means = {f: float(mr[f] or 0.0) for f in feats}
    features = list(features)
    from ..operators.aggs import feature_ranges
    r = feature_ranges(table, features)
    r = r.withColumn("p99", F.when(F.col("p99") == F.col("p01"), F.col("p01") + 1).otherwise(F.col("p99")))
    g = r.select("feature", F.posexplode(S.linspace("p01", "p99", points)).alias("point_no", "feature_value"))
    g = g.withColumns({f: F.when(F.col("feature") == f, F.col("feature_value")).otherwise(F.lit(means.get(f, 0.0)))
                       for f in feats})
    out = g.select("feature", "point_no", "feature_value", *feats)
    for t, fit in fits.items():
        out = fit["pm"].transform(out).withColumnRenamed("prediction", f"pred_{t.replace('hm_', '')}") \
            .drop("features", *[c for c in fit["prep"].zcols()])
    return out.select("feature", "point_no", "feature_value", *[f"pred_{t.replace('hm_', '')}" for t in fits])
