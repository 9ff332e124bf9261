"""Invariants and algebraic checks of the non-SQL operators."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapline.ml import models as M
from tapline.ml import prep as MP
from tapline.operators import clean, intervals, metrics, tseries, windows
from tapline.functions.dist import t_ppf
from tapline.plans import feature_table as FT

from conftest import SF_CHECK


@pytest.fixture(scope="module")
def ft(spark):
    return FT.labelled(FT.feature_table(spark, SF_CHECK)).persist()


def test_prefix_sum_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).cast("double").alias("k"), F.lit(1).alias("one"))
    df = df.dropDuplicates(["k"])
    got = windows.prefix_sum(df, "k", ["one"]).select("k", "one_cum")
    ref = df.withColumn("ref", F.sum("one").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    assert got.join(ref, "k").where("one_cum != ref").count() == 0


def test_splits_disjoint_complete_stable(spark, ft):
    a = MP.random_split(ft, ["clock"]).select("clock", "split")
    b = MP.random_split(ft.repartition(3), ["clock"]).select("clock", F.col("split").alias("s2"))
    assert a.count() == ft.count()
    assert a.join(b, "clock").where("split != s2").count() == 0
    s = MP.stratified_split(ft, "si_class", ["clock"])
    counts = {(r.si_class, r.split): r["count"] for r in s.groupBy("si_class", "split").count().collect()}
    totals = {r.si_class: r["count"] for r in ft.groupBy("si_class").count().collect()}
    for c, n in totals.items():
        assert counts.get((c, "train"), 0) == math.floor(n * 0.8)


def test_scalers(spark, ft):
    z = clean.scale_standard(ft, ["hbt"]).agg(F.avg("hbt"), F.stddev_pop("hbt")).first()
    assert abs(z[0]) < 1e-9 and abs(z[1] - 1) < 1e-9
    r = clean.scale_robust(ft, ["hbt"]).agg(F.median("hbt"), F.percentile("hbt", 0.75) - F.percentile("hbt", 0.25)).first()
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9


def test_confusion_sums_and_coverage(spark, ft):
    x = ft.withColumn("p", F.when(F.col("hm_si") > 0.5, "High").otherwise("Normal"))
    cm = metrics.confusion_matrix(x, "si_class", "p")
    assert cm.agg(F.sum("n")).first()[0] == ft.count()
    from tapline.operators import aggs
    cov = aggs.interval_coverage(ft.withColumns({"lo": F.col("hm_si") - 0.1, "hi": F.col("hm_si") + 0.1}), "hm_si", "lo", "hi")
    assert cov.first().coverage == 1.0


def test_ridge_one_feature_closed_form(spark, ft):
    prep = M.Prep.fit(ft, ["hbt"])
    n = ft.count()
    y_std = ft.agg(F.stddev_pop("hm_si")).first()[0]
    pm = M.fit(ft, prep, M.ridge("hm_si", alpha=1.0, n=n, y_std=y_std))
    z = prep.sql().transform(ft).select(F.col("z_hbt").alias("x"), F.col("hm_si").alias("y")).toPandas()
    x, y = z.x.to_numpy(), z.y.to_numpy()
    xc, yc = x - x.mean(), y - y.mean()
    slope = (xc @ yc) / (xc @ xc + 1.0)
    assert abs(pm.stages[-1].coefficients[0] - slope) < 1e-6


def test_forest_leaf_table_reproduces_prediction(spark, ft):
    prep = M.Prep.fit(ft, ["hbt", "oxygen_flow", "coal_actual"])
    pm = M.fit(ft, prep, M.rf_reg("hm_si", trees=10, depth=4))
    out = M.forest_interval(spark, pm, ft).toPandas()
    assert np.allclose(out.tree_mean, out.prediction, atol=1e-9)
    assert (out.pi_lo <= out.pi_hi + 1e-12).all()


def test_smote_balances_and_interpolates(spark):
    rows = [(f"a{i}", "A", float(i), float(i % 7)) for i in range(60)] + \
           [(f"b{i}", "B", 100.0 + i, float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, label string, x double, y double")
    out = MP.smote(df, "label", "key", ["x", "y"], k=5)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {"A": 60, "B": 60}
    syn = out.where("synthetic and label = 'B'").agg(F.min("x"), F.max("x")).first()
    assert syn[0] >= 100.0 and syn[1] <= 111.0  # inside the minority cloud


def test_knn_exact_against_brute_force(spark):
    from tapline.ml.neighbours import nearest
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(f"p{i}", "c", *map(float, p)) for i, p in enumerate(pts)], "key string, label string, a double, b double, c double")
    nn = nearest(df, "label", "key", ["a", "b", "c"], k=5).toPandas()
    for i in range(0, 80, 9):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(1))
        d[i] = np.inf
        want = sorted(np.argsort(d)[:5])
        got = sorted(int(k[1:]) for k in nn[nn.key == f"p{i}"]["__n"])
        assert got == want


def test_var1_and_acf(spark):
    rng = np.random.default_rng(1)
    n, a = 800, 0.6
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = a * x[t - 1] + rng.normal()
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + timedelta(hours=i), float(v), float(v) * 0.5 + 1) for i, v in enumerate(x)],
                               "clock timestamp_ntz, a double, b double")
    r1 = tseries.acf(df, "a", 3).orderBy("lag").first()
    assert abs(r1.acf - a) < 0.1
    m = tseries.fit_var(df, ["a"], maxlags=3, fixed_p=1)
    assert abs(m["coef"][0, 1] - a) < 0.1
    assert tseries.adf_test(df, "a")["verdict"] == "stationary"


def test_t_quantiles():
    assert abs(t_ppf(0.975, 4) - 2.7764451052) < 1e-8
    assert abs(t_ppf(0.975, 30) - 2.0422724563) < 1e-8


def test_cv_interval_clipped(spark):
    folds = spark.createDataFrame([(i, v) for i, v in enumerate([0.9, 0.95, 0.99, 0.97, 0.98])], "fold int, r2 double")
    r = intervals.cv_ci(folds).first()
    assert 0 <= r.ci_lo <= r.mean <= r.ci_hi <= 1.0


def test_asof_result_independent_of_partitions(spark):
    from tapline.operators import joins
    from tapline.sources import fixtures as fx
    t = fx.fx_tap(spark, SF_CHECK).select("tapno", "sampletaken")
    b = fx.fx_burden(spark, SF_CHECK).select("chargetime", "actwt")
    res, old = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in ("1", "3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = joins.asof_join(t, b, "sampletaken", "chargetime", right_cols=["actwt"])
            res.append(sorted(map(tuple, got.select("tapno", "chargetime", "actwt").collect()), key=lambda r: r[0]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert res[0] == res[1] == res[2]


def test_asof_burst_ties_and_missing_times(spark):
    from tapline.operators import joins
    t0 = datetime(2024, 1, 1)
    # 500 right rows inside one second; the greatest payload of the latest time matches
    right = spark.createDataFrame([(t0 + timedelta(microseconds=i // 2), float(i)) for i in range(500)], "rt timestamp_ntz, v double")
    left = spark.createDataFrame([(1, t0 + timedelta(seconds=1)), (2, t0), (3, t0 - timedelta(seconds=1)), (4, None)], "i int, lt timestamp_ntz")
    got = {r.i: r.v for r in joins.asof_join(left, right, "lt", "rt").collect()}
    assert got == {1: 499.0, 2: 1.0, 3: None, 4: None}


def test_prefix_sum_null_empty_and_groups(spark):
    df = spark.createDataFrame([(None, 1), (1.0, 1), (2.0, 1)], "k double, one int")
    got = {r.k: r.one_cum for r in windows.prefix_sum(df, "k", ["one"]).collect()}
    assert got == {None: 1, 1.0: 2, 2.0: 3}
    assert windows.prefix_sum(df.where("one > 1"), "k", ["one"]).collect() == []
    nulls = windows.prefix_sum(df.withColumn("k", F.lit(None).cast("double")), "k", ["one"]).collect()
    assert sorted(r.one_cum for r in nulls) == [1, 2, 3]
    by = spark.createDataFrame([(None, 1.0, 5), ("a", 1.0, 1), ("a", 2.0, 2), (None, 0.0, 7)], "g string, k double, v int")
    got = {(r.g, r.k): (r.v_cum, r.v_all) for r in windows.prefix_sum(by, "k", ["v"], by="g", desc=True, total_fmt="{c}_all").collect()}
    assert got == {(None, 1.0): (5, 12), (None, 0.0): (12, 12), ("a", 2.0): (2, 3), ("a", 1.0): (3, 3)}


def test_keyless_windows_are_blocked_and_equal_plain_ones(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("clock"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    w = Window.orderBy("clock")
    frame = windows._Frame(df, None, "clock", before=5, after=2, block_rows=64)
    got = frame.add({"a": F.lag("x", 5).over(frame.window), "b": F.lead("x", 2).over(frame.window),
                     "c": F.avg("x").over(frame.window.rowsBetween(-4, 0))})
    want = df.withColumns({"a": F.lag("x", 5).over(w), "b": F.lead("x", 2).over(w), "c": F.avg("x").over(w.rowsBetween(-4, 0))})
    assert sorted(map(tuple, got.select("clock", "x", "a", "b", "c").collect())) == sorted(map(tuple, want.select("clock", "x", "a", "b", "c").collect()))
    plan = windows.add_lags(df, ["x"], [1])._jdf.queryExecution().executedPlan().toString()
    # the only exchange to one task carries one row per bucket
    below = [plan.splitlines()[i + 1] for i, x in enumerate(plan.splitlines()) if "SinglePartition" in x]
    assert all("HashAggregate(keys=[__bk" in x for x in below)


def test_splits_with_null_labels_and_tiny_classes(spark):
    df = spark.range(0, 100).select(F.col("id").alias("k"), F.when(F.col("id") < 60, "a").when(F.col("id") < 61, "b").alias("y"))
    s = MP.stratified_split(df, "y", ["k"])
    got = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got == {("a", "train"): 48, ("a", "test"): 12, ("b", "test"): 1, (None, "train"): 31, (None, "test"): 8}
    folds = MP.kfold_ids(df, 3, ["k"], label="y").groupBy("y", "fold").count()
    assert {r["count"] for r in folds.where("y = 'a'").collect()} == {20}
    with pytest.raises(ValueError):
        MP.smote(df.where("y is not null").withColumn("f", F.col("k").cast("double")), "y", "k", ["f"])


def test_dynamic_pivot_has_no_value_limit(spark):
    from tapline.operators import aggs
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("clock"), F.format_string("b%04d", F.col("id") % 1200).alias("b"), F.lit(1.0).alias("w"))
    vals = aggs.distinct_values(df, "b")
    assert len(vals) == 1200
    assert len(aggs.pivot_sum(df, ["clock"], "b", "w", vals[:1100], fill=None).columns) == 1101


def test_cluster_without_shared_folder_is_refused():
    from tapline import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_pacf_per_lag_samples_match_direct_fits(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = np.zeros(n)
    for t in range(2, n):
        x[t] = 0.5 * x[t - 1] - 0.3 * x[t - 2] + rng.normal()
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + timedelta(hours=i), float(v)) for i, v in enumerate(x)], "clock timestamp_ntz, a double")
    got = tseries.pacf(df, "a", 5, method="ols")
    for k in range(1, 6):
        y = x[k:]
        X = np.column_stack([np.ones(n - k)] + [x[k - j:n - j] for j in range(1, k + 1)])
        want = np.linalg.lstsq(X, y, rcond=None)[0][-1]
        assert abs(got[k] - want) < 1e-8


def test_one_pass_merge_equals_joined_form(spark):
    cols = ["clock", "hm_si", "hm_temp", "hbt", "heat_flow_flux", "coke_kg", "other_kg", "ore_coke_ratio"]
    a = FT.merged_hourly(spark, SF_CHECK).select(*cols)
    b = FT.merged_hourly_joined(spark, SF_CHECK).select(*cols)
    ra = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.collect())
    rb = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.collect())
    assert len(ra) > 0 and ra == rb


def test_distributed_quantiles_equal_percentile_on_skewed_groups(spark):
    from tapline.operators import aggs
    # group 0 holds most rows and many duplicate values; group 1 is small
    df = spark.range(0, 20000).select((F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("g"),
                                      ((F.col("id") * 7919) % 97 / 7.0).alias("x"))
    probs = [0.01, 0.25, 0.33, 0.5, 0.9, 0.99]
    a = aggs.exact_quantiles_distributed(df, "x", probs, by="g").orderBy("g").collect()
    b = aggs.exact_quantiles(df, ["x"], probs, by="g").orderBy("g").collect()
    for ra, rb in zip(a, b):
        for c in ra.asDict():
            assert abs(ra[c] - rb[c]) < 1e-9, (c, ra[c], rb[c])


def test_adjusted_yule_walker_and_adf_refit(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = np.zeros(n)
    for t in range(2, n):
        x[t] = 0.6 * x[t - 1] - 0.2 * x[t - 2] + rng.normal()
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + timedelta(hours=i), float(v)) for i, v in enumerate(x)], "clock timestamp_ntz, a double")
    d = x - x.mean()
    r = np.array([d[:n - k] @ d[k:] / (n - k) for k in range(7)])
    got = tseries.pacf(df, "a", 6, method="yw")
    for k in range(1, 7):
        toeplitz = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert abs(got[k] - np.linalg.solve(toeplitz, r[1:k + 1])[-1]) < 1e-9
    res = tseries.adf_test(df, "a", maxlag=8)
    p, dy = res["lags"], np.diff(x)
    X = np.column_stack([np.ones(n - 1 - p), x[p:-1]] + [dy[p - k:n - 1 - k] for k in range(1, p + 1)])
    y = dy[p:]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e = y - X @ beta
    se = math.sqrt(e @ e / (len(y) - X.shape[1]) * np.linalg.inv(X.T @ X)[1, 1])
    assert res["nobs"] == len(y) and abs(res["stat"] - beta[1] / se) < 1e-6


def test_arimax_uses_the_last_shock(spark):
    rng = np.random.default_rng(12)
    n, u, e = 600, np.zeros(600), rng.normal(size=600) * 0.1
    for t in range(1, n):
        u[t] = 0.5 * u[t - 1] + e[t] + 0.4 * e[t - 1]
    z = rng.normal(size=n)
    y = 2.0 + 1.5 * z + u
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0 + timedelta(hours=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, z))], "clock timestamp_ntz, y double, z double")
    train = df.where(F.col("clock") < t0 + timedelta(hours=500))
    m = tseries.arimax_fit(train, "y", ["z"])
    assert abs(m["phi"] - 0.5) < 0.15 and abs(m["theta"] - 0.4) < 0.15 and abs(m["e_T"] - e[499]) < 0.05
    test = df.where(F.col("clock") >= t0 + timedelta(hours=500))
    first = tseries.arimax_forecast(test, m).orderBy("clock").first()
    assert abs(first.arimax - (m["const"] + m["beta"]["z"] * z[500] + m["phi"] * m["u_T"] + m["theta"] * m["e_T"])) < 1e-9
    one = np.array([r.arimax_1 for r in tseries.arimax_one_step(df, m).orderBy("clock").collect()])
    ue, ee = y - m["const"] - m["beta"]["z"] * z, np.zeros(n)
    for t in range(1, n):
        want = m["const"] + m["beta"]["z"] * z[t] + m["phi"] * ue[t - 1] + m["theta"] * ee[t - 1]
        ee[t] = y[t] - want
        assert t < 60 or abs(one[t] - want) < 1e-6


def test_guidance_of_single_drops(spark):
    from tapline.functions import scalars as S
    rows = spark.createDataFrame([(0.0, -1.0), (-1.0, 0.0), (0.0, 0.0)], "a double, b double").select(S.guidance("a", "b").alias("g")).collect()
    assert [r.g for r in rows] == ["lowers temperature, not silicon", "lowers silicon, not temperature", "little effect on either target"]
