"""Radial kernel features by Nyström landmarks (K9).

k(x, y) = exp(-gamma |x - y|^2) is approximated by the product of two feature
vectors: the kernel values against ``landmarks`` rows, times the inverse square
root of the landmarks' own kernel matrix.  A linear max-margin fit on them is a
kernel machine whose work grows with the rows, not with their square.

The landmarks are a bounded sample (the smallest hashes of the distinct rows, so
copies count once); all rows are transformed.  gamma defaults to 1 / (features x
variance of all entries).  With as many landmarks as distinct rows the kernel is
exact.  Rows: no row gives an error in ``fit``; equal entries everywhere give gamma 1.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel matrix between the rows of x and of y."""
    d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(d2, 0.0))


class KernelLandmarks(Estimator):
    """Chooses landmarks and gamma; ``landmarks`` bounds what the driver and the model hold."""

    def __init__(self, landmarks: int = 256, gamma: float | None = None, features: str = "features", out: str = "kernel"):
        super().__init__()
        if landmarks < 1 or (gamma is not None and gamma <= 0):
            raise ValueError("landmarks must be 1 or more, gamma above 0")
        self.landmarks, self.gamma, self.features, self.out = landmarks, gamma, features, out

    def _fit(self, df: DataFrame) -> "KernelLandmarksModel":
        rows = df.select(vector_to_array(self.features).alias("x"))
        gamma = self.gamma
        if gamma is None:
            total = lambda g: F.sum(F.aggregate("x", F.lit(0.0), lambda t, v: t + g(v)))
            s = rows.agg(F.sum(F.size("x")).alias("n"), total(lambda v: v).alias("s"), F.max(F.size("x")).alias("d")).first()
            if not s["n"]:
                raise ValueError("no rows to choose landmarks from")
            mean = s["s"] / s["n"]
            spread = rows.agg(total(lambda v: (v - mean) * (v - mean))).first()[0] / s["n"]  # about the mean: no cancellation
            gamma = 1.0 / (s["d"] * spread) if spread > 0 else 1.0
        marks = rows.distinct().orderBy(F.xxhash64("x"), "x").limit(self.landmarks).collect()  # bounded by the parameter
        if not marks:
            raise ValueError("no rows to choose landmarks from")
        points = np.array([r["x"] for r in marks], float)
        value, vector = np.linalg.eigh(rbf(points, points, gamma))
        keep = value > value.max() * 1e-10
        root = vector[:, keep] / np.sqrt(value[keep])
        return KernelLandmarksModel(fitted=json.dumps({"gamma": gamma, "points": points.tolist(), "root": root.tolist()}),
                                    features=self.features, out=self.out)


class KernelLandmarksModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector column ``out`` of approximate kernel features. Saved as one JSON parameter."""

    fitted = Param(Params._dummy(), "fitted", "landmarks, root and gamma as JSON", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "name of the feature vector", TypeConverters.toString)
    out = Param(Params._dummy(), "out", "name of the new vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fitted: str | None = None, features: str = "features", out: str = "kernel"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        m = json.loads(self.getOrDefault(self.fitted))
        shipped = df.sparkSession.sparkContext.broadcast((np.array(m["points"]), np.array(m["root"]), m["gamma"]))

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            points, root, gamma = shipped.value
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(rbf(np.stack(x.to_numpy()), points, gamma) @ root))

        return df.withColumn(self.getOrDefault(self.out), array_to_vector(mapped(vector_to_array(self.getOrDefault(self.features)))))
