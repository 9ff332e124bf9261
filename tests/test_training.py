"""Training runs: what candidates share, and what the driver asks the cluster for."""

import numpy as np
import pandas as pd

from tapline.ml import models as M
from tapline.ml import training as TR

FEATS = ["a", "b", "c"]


def table(spark, n=120):
    r = np.random.default_rng(4)
    p = pd.DataFrame(r.normal(size=(n, 3)), columns=FEATS)
    p.loc[::10, "b"] = None
    p["clock"], p["hm_si"], p["hm_temp"] = np.arange(n), p.a + r.normal(size=n) / 9, 1500 + 3 * p.c + r.normal(size=n)
    return spark.createDataFrame(p.astype(object).where(p.notna(), None).to_dict("records"),
                                 "a double, b double, c double, clock int, hm_si double, hm_temp double").persist()


def test_candidates_share_their_rows_and_scaler(spark, monkeypatch):
    """A bake-off fits one scaler for the selections and one for the inputs of each target, not one a candidate."""
    ctx, calls, fit = TR.Context(spark, "", table(spark), FEATS), [], M.Prep.fit.__func__
    monkeypatch.setattr(M.Prep, "fit", classmethod(lambda cls, df, features, scale=True: calls.append(scale) or fit(cls, df, features, scale)))
    monkeypatch.setattr(TR, "REG_CANDIDATES", {"Random Forest": lambda y, n: M.rf_reg(y, 3, 3), "Gradient Boosting": lambda y, n: M.gbt_reg(y, 3, 2, 0.3)})
    rows = TR.bakeoff(ctx).collect()
    assert len(rows) == 4 and sum(r["best"] for r in rows) == 2
    assert calls.count(False) == 1 and calls.count(True) <= 2
    fits = [TR.fit_regression(ctx, "hm_si", m) for m in TR.REG_CANDIDATES]
    train = fits[0]["split"].where("split = 'train'")
    assert fits[0]["prep"] is fits[1]["prep"] and {f["n_train"] for f in fits} == {train.count()}
    want = fit(M.Prep, train, fits[0]["features"])
    assert (want.medians, want.means, want.stds) == (fits[0]["prep"].medians, fits[0]["prep"].means, fits[0]["prep"].stds)


def test_forest_interval_reads_its_leaves_without_a_job(spark):
    """The leaf values of a forest are the driver's already; they do not go to the cluster and back."""
    df = table(spark)
    pm = M.fit(df, M.Prep.fit(df, FEATS), M.rf_reg("hm_si", 7, 5))
    spark.sparkContext.setJobGroup("interval", "")
    out = M.forest_interval(spark, pm, df)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("interval")
    spark.sparkContext.setJobGroup("", "")
    assert not jobs
    got = out.select("clock", "prediction", "pi_lo", "pi_hi", "tree_mean", "tree_std").toPandas().set_index("clock").sort_index()
    np.testing.assert_allclose(got.tree_mean, got.prediction, rtol=1e-12)
    x = M.assemble(M.Prep.fit(df, FEATS))
    rows = x[1].transform(x[0].transform(df)).select("clock", "features").orderBy("clock").limit(5).collect()
    trees = [[t.predict(r["features"]) for t in pm.stages[-1].trees] for r in rows]
    np.testing.assert_allclose(got.tree_std.iloc[:5], np.std(trees, axis=1), rtol=1e-9)
    np.testing.assert_allclose(got.pi_lo.iloc[:5], np.percentile(trees, 2.5, axis=1), rtol=1e-9)
