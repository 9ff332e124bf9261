"""Kernel landmarks: error against the exact matrix, rings a quadratic cannot split, saving, bad input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tapline.ml import models as M
from tapline.ml.kernel import KernelLandmarks, KernelLandmarksModel, rbf


def frame(spark, x, y=None):
    y = np.zeros(len(x)) if y is None else y
    return spark.createDataFrame([(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y))], ["id", "label", "features"])


def features(model, df):
    return np.array([r["k"] for r in model.transform(df).orderBy("id").select(vector_to_array("kernel").alias("k")).collect()])


def test_error_against_the_exact_matrix(spark):
    x = np.random.default_rng(1).normal(size=(300, 4)) * [1.0, 2.0, 0.5, 1.0]
    df, gamma = frame(spark, x), 1.0 / (4 * x.var())
    exact = rbf(x, x, gamma)
    error = {}
    for n in (40, 150, 300):
        z = features(KernelLandmarks(n).fit(df), df)
        error[n] = np.linalg.norm(z @ z.T - exact) / np.linalg.norm(exact)
    assert error[300] < 1e-6 and error[150] < 0.1 and error[300] < error[150] < error[40]


def rings(n, seed):
    rng = np.random.default_rng(seed)
    band = rng.integers(0, 4, n)
    r, a = band + rng.uniform(0.15, 0.85, n), rng.uniform(0, 2 * np.pi, n)
    return np.c_[r * np.cos(a), r * np.sin(a)], (band % 2).astype(float)


def test_rings_that_a_quadratic_cannot_split(spark):
    train, test = frame(spark, *rings(600, 2)), frame(spark, *rings(300, 3))

    def accuracy(stage, column):
        pm = Pipeline(stages=[stage, M.svm_cls("label", 10.0, 600, features=column)]).fit(train)
        return pm.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    assert accuracy(KernelLandmarks(200, gamma=2.0), "kernel") > 0.95
    assert accuracy(M.poly_stage(), "poly") < 0.75


def test_saved_copies_and_no_rows(spark, tmp_path):
    x = np.concatenate([np.zeros((200, 2)), [[1.0, 0.0], [0.0, 2.0], [3.0, 1.0]]])
    df = frame(spark, x)
    model = KernelLandmarks(4).fit(df)  # copies are one landmark, so four hold all
    z = features(model, df)
    assert np.abs(z @ z.T - rbf(x, x, 1.0 / (2 * x.var()))).max() < 1e-6
    model.write().overwrite().save(str(tmp_path / "kernel"))
    assert np.array_equal(features(KernelLandmarksModel.load(str(tmp_path / "kernel")), df), z)
    assert np.allclose(features(KernelLandmarks(4).fit(frame(spark, np.ones((5, 2)))), frame(spark, np.ones((5, 2)))), 1.0)
    assert model.transform(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        KernelLandmarks(4).fit(df.where("false"))


@pytest.mark.parametrize("present", [[2.0], [0.0, 2.0]])
def test_classes_without_training_rows(spark, present, tmp_path):
    """A class without rows (the rare class of a calm plant) is left out; a class alone is predicted everywhere."""
    from pyspark.ml import PipelineModel
    x = np.array([[4.0 * c + 0.1 * i, -4.0 * c * c] for c in present for i in range(20)])
    y = [c for c in present for _ in range(20)]
    df = frame(spark, x, y).coalesce(1).cache()
    model = Pipeline(stages=[M.svm_cls("label", 10.0, len(y), features="features")]).fit(df)
    model.write().overwrite().save(str(tmp_path / "svm"))
    for m in (model, PipelineModel.load(str(tmp_path / "svm"))):
        out = m.transform(df)
        assert set(df.columns) < set(out.columns) and not {"__code", "__place"} & set(out.columns)
        found = [r["prediction"] for r in out.orderBy("id").collect()]
        assert set(found) <= set(present) and np.mean(np.array(found) == y) >= 0.9
    with pytest.raises(ValueError):
        M.svm_cls("label", features="features").fit(df.where("false"))
