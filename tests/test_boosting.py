"""Histogram boosting against a plain numpy version, and its edge rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tapline.ml.boosting import NewtonBoosting
from tapline.session import scratch_path

COLS = [f"a{i}" for i in range(4)]


def frame(n=240, seed=3):
    r = np.random.default_rng(seed)
    p = pd.DataFrame(r.integers(0, 12, (n, len(COLS))).astype(float), columns=COLS)  # few values: every gap is an edge
    p["y"] = 3 * p.a0 - (p.a1 > 5) * 7 + r.normal(size=n)
    p["c"] = (p.a0 > 4).astype(int) + (p.a2 > 8).astype(int)
    return p


def put(spark, p, parts=3):
    return VectorAssembler(inputCols=COLS, outputCol="features", handleInvalid="keep").transform(spark.createDataFrame(p).repartition(parts))


def plain(x, y, outputs, trees, depth, rate, l2, least):
    """Margins of the training rows by exact greedy trees, rows and thresholds visited one by one."""
    base = np.array([y.mean()]) if outputs == 1 else np.log([max((y == k).sum(), 1e-6) / len(y) for k in range(outputs)])
    margin = np.tile(base, (len(y), 1))

    def grow(rows, g, h, level, out):
        best, at = 1e-9, None
        if level < depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if h[left].sum() < least or h[right].sum() < least:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                    if gain > best + 1e-9:
                        best, at = gain, (left, right)
        if at is None:
            out[rows] = -rate * g[rows].sum() / (h[rows].sum() + l2)
        else:
            grow(at[0], g, h, level + 1, out)
            grow(at[1], g, h, level + 1, out)
    for _ in range(trees):
        if outputs == 1:
            grad, hess = margin - y[:, None], np.ones_like(margin)
        else:
            p = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
            grad, hess = p - np.eye(outputs)[y.astype(int)], p * (1 - p)
        step = np.zeros_like(margin)
        for k in range(outputs):
            grow(np.arange(len(y)), grad[:, k], hess[:, k], 0, step[:, k])
        margin = margin + step
    return margin


def test_regression_equals_plain_trees(spark):
    p = frame()
    m = NewtonBoosting("y", trees=12, depth=3, rate=0.3, l2=1.0).fit(put(spark, p))
    got = m.transform(put(spark, p)).select(*COLS, "y", "prediction").toPandas().sort_values([*COLS, "y"])
    p["want"] = plain(p[COLS].to_numpy(), p.y.to_numpy(), 1, 12, 3, 0.3, 1.0, 1.0)[:, 0]
    np.testing.assert_allclose(got.prediction.to_numpy(), p.sort_values([*COLS, "y"]).want.to_numpy(), rtol=1e-9)


def test_classes_equal_plain_trees(spark):
    p = frame(160)
    m = NewtonBoosting("c", "softmax", classes=3, trees=4, depth=2, rate=0.3, min_child=0.5).fit(put(spark, p))
    got = m.transform(put(spark, p)).select(*COLS, vector_to_array("rawPrediction").alias("raw"), vector_to_array("probability").alias("p"),
                                            "prediction").toPandas().sort_values(COLS)
    p["want"] = list(plain(p[COLS].to_numpy(), p.c.to_numpy(), 3, 4, 2, 0.3, 1.0, 0.5))
    want = np.stack(p.sort_values(COLS).want.to_list())
    np.testing.assert_allclose(np.stack(got.raw.to_list()), want, rtol=1e-9)
    np.testing.assert_allclose(np.stack(got.p.to_list()).sum(1), 1.0)
    assert (got.prediction.to_numpy() == want.argmax(1)).all()


def test_saved_pipeline_sampling_and_edge_rows(spark):
    p = frame()
    extra = pd.DataFrame({"a0": [1.0, np.nan], "a1": 2.0, "a2": 3.0, "a3": [4.0, 5.0], "y": [np.nan, 4.0], "c": 0})
    data = spark.createDataFrame(pd.concat([p, extra])).drop("features").repartition(2)
    stages = [VectorAssembler(inputCols=COLS, outputCol="features", handleInvalid="keep"),
              NewtonBoosting("y", trees=12, depth=3, rows=0.7, columns=0.5)]
    pm = Pipeline(stages=stages).fit(data)
    path = scratch_path(spark, "boosted")
    pm.write().overwrite().save(path)
    a = pm.transform(data).select(*COLS, "prediction").toPandas().sort_values([*COLS, "prediction"])
    b = PipelineModel.load(path).transform(data).select(*COLS, "prediction").toPandas().sort_values([*COLS, "prediction"])
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))
    assert len(a) == len(p) + 2 and a.prediction.notna().all()  # rows without a label are scored, not trained on
    assert pm.stages[-1].featureImportances.toArray().sum() == pytest.approx(1.0)
    assert pm.transform(data.limit(0)).count() == 0


def test_no_rows_and_wrong_labels(spark):
    df = put(spark, frame(20))
    with pytest.raises(ValueError):
        NewtonBoosting("y", trees=2).fit(df.limit(0))
    with pytest.raises(ValueError):
        NewtonBoosting("c", "softmax", classes=2, trees=2).fit(df)
    flat = put(spark, frame(20).assign(**{c: 1.0 for c in COLS}))
    m = NewtonBoosting("y", trees=3).fit(flat)  # nothing to split on: the mean
    assert m.transform(flat).select("prediction").distinct().count() == 1


def test_driver_gets_splits_not_histograms(spark, monkeypatch):
    """Several blocks give the one block's model, and what a level sends to the driver is a few numbers a node."""
    import pickle
    from tapline.ml import boosting as B
    x = np.random.default_rng(5).normal(size=(400, 3))
    rows = [(i, float(a[0] + 2 * (a[1] > 0)), Vectors.dense(a)) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "y", "features"]).repartition(4, "id").cache()
    sizes, grow = [], B._grow
    monkeypatch.setattr(B, "_grow", lambda trees, found, level, *rest: sizes.append(len(pickle.dumps(found)) / 2 ** level) or grow(trees, found, level, *rest))
    models = []
    for block in (B.BLOCK, 100):  # one block, then four
        monkeypatch.setattr(B, "BLOCK", block)
        models.append(NewtonBoosting("y", trees=2, depth=3, rate=0.3).fit(df))
    one, many = (np.array([r["prediction"] for r in m.transform(df).orderBy("id").collect()]) for m in models)
    assert np.abs(one - many).max() < 1e-9 and np.ptp(one) > 0.5
    assert len(sizes) == 12 and max(sizes) < 1_500


def test_few_partitions_are_dealt_to_as_many_tasks_as_blocks(spark, monkeypatch):
    """Adaptive execution may leave many rows in one partition; the passes must not stay in one task."""
    from tapline.ml import boosting as B
    monkeypatch.setattr(B, "BLOCK", 60)
    seen, level = [], B._level
    monkeypatch.setattr(B, "_level", lambda state, *rest: seen.append(state.rdd.getNumPartitions()) or level(state, *rest))
    p = frame()
    m = NewtonBoosting("y", trees=2, depth=2, rate=0.3, l2=1.0).fit(put(spark, p, parts=1))
    assert set(seen) == {4}
    got = m.transform(put(spark, p)).select(*COLS, "y", "prediction").toPandas().sort_values([*COLS, "y"])
    p["want"] = plain(p[COLS].to_numpy(), p.y.to_numpy(), 1, 2, 2, 0.3, 1.0, 1.0)[:, 0]
    np.testing.assert_allclose(got.prediction.to_numpy(), p.sort_values([*COLS, "y"]).want.to_numpy(), rtol=1e-9)


def test_a_scored_row_passes_one_python_function_once(spark):
    """A filter on the prediction, as in the metrics, must not score the rows a second time in a second worker."""
    from tapline.operators import metrics
    df = put(spark, frame(60))
    reg = NewtonBoosting("y", trees=2, depth=2).fit(df)
    cls = NewtonBoosting("c", "softmax", classes=3, trees=2, depth=2).fit(df)
    scored = cls.transform(df).where("prediction >= 0").select("prediction", "rawPrediction", "probability")
    for out in (metrics.regression_metrics(reg.transform(df), "y", "prediction"), scored):
        assert out._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    assert scored.count() == 60


def test_workers_load_neither_pandas_nor_spark_ml(spark, monkeypatch):
    """What runs in tasks, loaded in a fresh process as a worker loads it, brings numpy and Arrow only."""
    import subprocess
    import sys
    from pathlib import Path
    from pyspark import cloudpickle
    from tapline.ml import boosting as B
    sent, arrow_udf = [], B.F.arrow_udf
    monkeypatch.setattr(B.F, "arrow_udf", lambda f, t: sent.append(f) or arrow_udf(f, t))
    cls = type(put(spark, frame(20)))
    map_in_arrow = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda self, f, t: sent.append(f) or map_in_arrow(self, f, t))
    df = put(spark, frame(60))
    df_scored = NewtonBoosting("c", "softmax", classes=3, trees=2, depth=2).fit(df).transform(df)
    assert df_scored.count() == 60 and len(sent) == 2
    code = """
import pickle, sys
import numpy as np, pyarrow as pa
from pyspark import TaskContext
from tapline.ml import arrowrows as A, histograms as H
pack, score = pickle.load(sys.stdin.buffer)
TaskContext._taskContext = task = TaskContext()
task._partitionId = 7
x = A.lists(np.arange(8.0).reshape(2, 4))
column = pa.Array.from_buffers(pa.float64(), 2, [None, pa.py_buffer(np.ones(2))])
block, = pack([pa.RecordBatch.from_arrays([x, column, column], ["x", "y", "w"])])
row = {n: block.column(n)[0].as_py() for n in block.schema.names}
(name, bins, y, w), margin = H.unpacked(row, 3)
assert name == (7, 0) and bins.shape == (2, 4) and y.tolist() == w.tolist() == [1, 1] and margin.shape == (2, 3)
assert len(score(x)) == 2 and len(score(x.slice(0, 0))) == 0 and score(x.slice(1)) == score(x).slice(1)
assert not {"pandas", "pyspark.ml"} & set(sys.modules), "loaded"
"""
    root = str(Path(B.__file__).parents[2])
    run = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(sent), capture_output=True, cwd=root, timeout=120)
    assert run.returncode == 0, run.stderr.decode()


@pytest.mark.parametrize("block", [65_536, 100])
def test_few_blocks_grow_in_one_job_as_level_by_level(spark, monkeypatch, block):
    """Up to three blocks take no job a level, and the trees are those of passes over the blocks, bit for bit."""
    from tapline.ml import boosting as B
    monkeypatch.setattr(B, "BLOCK", block)
    df = put(spark, frame()).cache()
    fits = [NewtonBoosting("y", trees=12, depth=3, rate=0.3, rows=0.7, columns=0.5),
            NewtonBoosting("c", "softmax", classes=3, trees=11, depth=2, rate=0.3, min_child=0.5)]
    got, jobs = [], []
    for i, fit in enumerate(fits):
        spark.sparkContext.setJobGroup(f"few blocks {block} {i}", "")
        got.append(fit.fit(df).getOrDefault("forest"))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few blocks {block} {i}")))
    spark.sparkContext.setJobGroup("", "")
    assert max(jobs) < 12  # 36 and 22 levels
    monkeypatch.setattr(B, "_lone", lambda *_: None, raising=False)
    assert got == [fit.fit(df).getOrDefault("forest") for fit in fits]
