"""Cross-validation from moments against fits on the rows themselves."""

import numpy as np
import pandas as pd
import pytest

from tapline.ml.folds import ridge_cv


def test_ridge_cv_equals_row_fits(spark):
    r = np.random.default_rng(5)
    p = pd.DataFrame(r.normal(1e4, 3, (300, 4)), columns=list("abcd"))  # means far above the spread
    p["y"] = 2 * p.a - p.c + r.normal(size=300)
    p["z"] = p.b + 50.0
    p["fold"] = r.integers(0, 4, 300)
    gaps = p.head(3).assign(a=[None, 1.0, 2.0], y=[1.0, None, 3.0], fold=[1, 2, None])
    df = spark.createDataFrame(pd.concat([p, gaps]).astype(object).where(lambda x: x.notna(), None),
                               "a double, b double, c double, d double, y double, z double, fold int").repartition(5)
    got = {(x["target"], x["alpha"], x["fold"]): x for x in ridge_cv(df, list("abcd"), ["y", "z"], alphas=[1.0, 100.0]).collect()}
    assert len(got) == 16
    for (t, alpha, k), x in got.items():
        tr, te = p[p.fold != k], p[p.fold == k]
        m, mu = tr[list("abcd")].mean(), tr[t].mean()
        a = (tr[list("abcd")] - m).to_numpy()
        beta = np.linalg.solve(a.T @ a + alpha * np.eye(4), a.T @ (tr[t] - mu).to_numpy())
        err = te[t].to_numpy() - mu - (te[list("abcd")] - m).to_numpy() @ beta
        assert x["n"] == len(te)
        assert x["rmse"] == pytest.approx(np.sqrt((err ** 2).mean()), rel=1e-6)
        assert x["r2"] == pytest.approx(1 - (err ** 2).mean() / te[t].var(ddof=0), rel=1e-6)


def test_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 2.0, 1), (3.0, 2.0, 1)], "x double, y double, fold int")
    assert {x["r2"] for x in ridge_cv(df, ["x"], ["y"]).collect()} == {None}
    assert ridge_cv(df.limit(0), ["x"], ["y"]).count() == 0
    with pytest.raises(ValueError):
        ridge_cv(df.where("fold = 1"), ["x"], ["y"])
