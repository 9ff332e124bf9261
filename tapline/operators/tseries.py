"""Time-series statistics and linear forecasters (N1-N7, M1f).

Heavy lifting is one Spark aggregate of cross-products (a k×k moment
matrix, k = number of regressors ≤ a few dozen) over lag columns built
with partitioned windows; the tiny k×k solves run on the driver with
numpy.  Forecasts are column expressions over lag columns — no loops
over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import norm_cdf, norm_ppf
from . import windows
from .aggs import _by


def acf(df: DataFrame, col: str, nlags: int = 40, by=None, clock: str = "clock") -> DataFrame:
    """Biased sample ACF per series (global mean), long form + ±1.96/√n band."""
    keys = _by(by)
    x = df.where(F.col(col).isNotNull())
    mean = F.avg(col).over(Window.partitionBy(*keys)) if keys else F.lit(x.agg(F.avg(col)).first()[0])
    x = windows.add_lags(x.withColumn("__d", F.col(col) - mean), ["__d"], range(1, nlags + 1), by, clock, fmt="__l{k}")
    g = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__d") ** 2).alias("__den"),
                             *[F.sum(F.col("__d") * F.col(f"__l{k}")).alias(f"__s{k}")
                               for k in range(1, nlags + 1)])
    stack = ", ".join(f"{k}, `__s{k}`" for k in range(1, nlags + 1))
    long = g.selectExpr(*keys, "n", "__den", f"stack({nlags}, {stack}) as (lag, __num)")
    z = norm_ppf(0.975)
    return long.select(*keys, "lag", (F.col("__num") / F.col("__den")).alias("acf"),
                       (F.lit(z) / F.sqrt(F.col("n"))).alias("band"))


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, int]:
    """Σ z zᵀ over complete rows for z = (1, cols...) in one aggregate."""
    z = ["__one"] + list(cols)
    x = df.dropna(subset=list(cols)).withColumn("__one", F.lit(1.0))
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z) if j >= i]
    r = x.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    k = len(z)
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = r[f"m_{i}_{j}"] or 0.0
    return m, int(r["n"])


def ols_from_moments(m: np.ndarray, n: int, yi: int, xi: Sequence[int]):
    """OLS of column yi on columns xi (indices into the moment matrix)."""
    xx = m[np.ix_(xi, xi)]
    xy = m[np.ix_(xi, [yi])][:, 0]
    beta = np.linalg.solve(xx, xy)
    ssr = float(m[yi, yi] - 2 * beta @ xy + beta @ xx @ beta)
    return beta, max(ssr, 0.0), xx


def lagged(df: DataFrame, cols: Sequence[str], p: int, by=None, clock: str = "clock",
           diff: bool = False) -> DataFrame:
    """Lags 1..p of the columns (or of their first differences ``d_<c>``); blocked where the series has no key."""
    if diff:
        df = windows.add_diffs(df, cols, by, clock, fmt="d_{c}")
        cols = [f"d_{c}" for c in cols]
    return windows.add_lags(df, cols, range(1, p + 1), by, clock, fmt="{c}_l{k}") if p else df


def fit_var(df: DataFrame, cols: Sequence[str], maxlags: int = 12, by=None, clock: str = "clock",
            ic: str = "aic", fixed_p: int | None = None) -> dict:
    """VAR(p) with p chosen by AIC on the common sample (rows with maxlags history)."""
    k = len(cols)
    x = lagged(df, cols, maxlags, by, clock)
    regs = [f"{c}_l{j}" for j in range(1, maxlags + 1) for c in cols]
    m, n = moments(x, list(cols) + regs)
    idx = {c: i + 1 for i, c in enumerate(list(cols) + regs)}

    def fit(p):
        xi = [0] + [idx[f"{c}_l{j}"] for j in range(1, p + 1) for c in cols]
        betas, resid = [], []
        for c in cols:
            b, _, xx = ols_from_moments(m, n, idx[c], xi)
            betas.append(b)
        # residual covariance from moments
        B = np.array(betas)  # k × (1 + kp)
        yi = [idx[c] for c in cols]
        yy = m[np.ix_(yi, yi)]
        xy = m[np.ix_(xi, yi)]
        xx = m[np.ix_(xi, xi)]
        su = yy - B @ xy - xy.T @ B.T + B @ xx @ B.T
        return B, su
    best = None
    for p in ([fixed_p] if fixed_p else range(1, maxlags + 1)):
        B, su = fit(p)
        sig = su / n
        sign, ld = np.linalg.slogdet(sig)
        aic = ld + 2.0 * k * (k * p + 1) / n
        if best is None or aic < best["aic"]:
            best = {"p": p, "coef": B, "sigma_u": su / max(n - (k * p + 1), 1), "aic": float(aic), "n": n,
                    "cols": list(cols)}
    if best["p"] < maxlags:
        # the order is chosen on the common sample; the chosen model is refit on every
        # row that has p lags of history (one more moment aggregate)
        p = best["p"]
        x = lagged(df, cols, p, by, clock)
        regs = [f"{c}_l{j}" for j in range(1, p + 1) for c in cols]
        m, n = moments(x, list(cols) + regs)
        idx = {c: i + 1 for i, c in enumerate(list(cols) + regs)}
        B, su = fit(p)
        best.update({"coef": B, "sigma_u": su / max(n - (k * p + 1), 1), "n": n})
    return best


def var_forecast(df: DataFrame, model: dict, by=None, clock: str = "clock", prefix: str = "var_") -> DataFrame:
    """One-step forecasts from *actual* history = linear expression over lag columns."""
    cols, p, B = model["cols"], model["p"], model["coef"]
    x = lagged(df, cols, p, by, clock)
    out = {}
    for e, c in enumerate(cols):
        expr = F.lit(float(B[e, 0]))
        i = 1
        for j in range(1, p + 1):
            for cc in cols:
                expr = expr + F.lit(float(B[e, i])) * F.col(f"{cc}_l{j}")
                i += 1
        out[f"{prefix}{c}"] = expr
    return x.withColumns(out).drop(*[f"{c}_l{j}" for c in cols for j in range(1, p + 1)])


def var_pi(df: DataFrame, model: dict, alpha: float = 0.05, prefix: str = "var_") -> DataFrame:
    """M1f: ± z·√Σ_ii around each VAR forecast."""
    z = norm_ppf(1 - alpha / 2)
    out = {}
    for e, c in enumerate(model["cols"]):
        h = z * math.sqrt(model["sigma_u"][e, e])
        out[f"{prefix}{c}_lo"] = F.col(f"{prefix}{c}") - F.lit(h)
        out[f"{prefix}{c}_hi"] = F.col(f"{prefix}{c}") + F.lit(h)
    return df.withColumns(out)


def pacf(df: DataFrame, col: str, nlags: int = 40, by=None, clock: str = "clock",
         method: str = "ols") -> list[float]:
    """Partial autocorrelations.

    ``ols``: lag-k coefficient of an AR(k) fit on every row with k lags of history;
    ``ols_common``: all AR(k) fits on the rows with the full history;
    ``yw``: Yule-Walker by Durbin-Levinson on the adjusted ACF (denominator n − k);
    ``ywm``: the same on the biased ACF (denominator n).
    """
    if method in ("yw", "ywm"):
        a = [1.0] + [r["acf"] for r in acf(df, col, nlags, by, clock).orderBy("lag").collect()]
        if method == "yw":
            n = df.where(F.col(col).isNotNull()).count()
            a = [v * n / (n - k) for k, v in enumerate(a)]
        phi_prev, out = [], [1.0]
        for k in range(1, nlags + 1):
            num = a[k] - sum(phi_prev[j] * a[k - 1 - j] for j in range(k - 1))
            den = 1.0 - sum(phi_prev[j] * a[j + 1] for j in range(k - 1))
            pk = num / den
            phi_prev = [phi_prev[j] - pk * phi_prev[k - 2 - j] for j in range(k - 1)] + [pk]
            out.append(pk)
        return out
    x = lagged(df, [col], nlags, by, clock).where(F.col(col).isNotNull())
    regs = [f"{col}_l{j}" for j in range(1, nlags + 1)]
    m, n = moments(x, [col] + regs)  # rows with the full nlags history
    out = [1.0]
    if method == "ols_common":
        for k in range(1, nlags + 1):
            b, _, _ = ols_from_moments(m, n, 1, [0] + list(range(2, 2 + k)))
            out.append(float(b[-1]))
        return out
    # per-lag samples (each AR(k) uses every row with k lags of history): the rows
    # missing lag nlags are the first ≤ nlags rows of each series — collect only those
    head = x.where(F.col(regs[-1]).isNull()).select(col, *regs).collect()
    z = np.array([[1.0, r[col]] + [np.nan if r[c] is None else r[c] for c in regs] for r in head]).reshape(-1, nlags + 2)
    for k in range(1, nlags + 1):
        idx = [0, 1] + list(range(2, 2 + k))
        mk = m[np.ix_(idx, idx)].copy()
        rows = z[~np.isnan(z[:, 1 + k])] if len(z) else z
        if len(rows):
            v = rows[:, idx]
            mk += v.T @ v
        b, _, _ = ols_from_moments(mk, n + len(rows), 1, [0] + list(range(2, 2 + k)))
        out.append(float(b[-1]))
    return out


# FIXED VALUES: MacKinnon (1994, 2010) response-surface coefficients for the
# constant-only Dickey-Fuller test (one series).
_TAU_MAX_C, _TAU_MIN_C, _TAU_STAR_C = 2.74, -18.83, -1.61
_TAU_C_SMALLP = [2.1659, 1.4412, 0.038269]
_TAU_C_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]
_TAU_C_CRIT = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
               "5%": [-2.86154, -2.8903, -4.234, -40.040],
               "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def _mackinnon_p(stat: float) -> float:
    if stat > _TAU_MAX_C:
        return 1.0
    if stat < _TAU_MIN_C:
        return 0.0
    c = _TAU_C_SMALLP if stat <= _TAU_STAR_C else _TAU_C_LARGEP
    return norm_cdf(sum(ci * stat ** i for i, ci in enumerate(c)))


def adf_test(df: DataFrame, col: str, maxlag: int | None = None, by=None, clock: str = "clock") -> dict:
    """Augmented Dickey-Fuller with constant, lag order by AIC, refit at the chosen order."""
    n_all = df.where(F.col(col).isNotNull()).count()
    if n_all < 40:
        return {"stat": None, "pvalue": None, "lags": None, "verdict": "too few rows"}
    if maxlag is None:
        maxlag = int(math.ceil(12.0 * (n_all / 100.0) ** 0.25))
    def sample(p):
        """Moments of (1, dy, y lag 1, dy lags 1..p) over the rows that have them all."""
        x = windows.add_lags(df.where(F.col(col).isNotNull()), [col], [1], by, clock, fmt="__y1")
        x = lagged(x.withColumn("__dy", F.col(col) - F.col("__y1")), ["__dy"], p, by, clock)
        return moments(x, ["__dy", "__y1"] + [f"__dy_l{k}" for k in range(1, p + 1)])

    m, n = sample(maxlag)
    if n < 10 or m[1, 1] == 0:
        return {"stat": None, "pvalue": None, "lags": None, "verdict": "constant series"}
    best = None
    for p in range(0, maxlag + 1):
        xi = [0, 2] + list(range(3, 3 + p))
        _, ssr, _ = ols_from_moments(m, n, 1, xi)
        llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
        aic = -2 * llf + 2 * len(xi)
        if best is None or aic < best[0]:
            best = (aic, p)
    # the order is chosen on the common sample, the statistic comes from all rows that the chosen order can use
    p = best[1]
    m, n = sample(p)
    xi = [0, 2] + list(range(3, 3 + p))
    b, ssr, xx = ols_from_moments(m, n, 1, xi)
    s2 = ssr / (n - len(xi))
    se = math.sqrt(s2 * np.linalg.inv(xx)[1, 1])
    stat = float(b[1] / se)
    crit = {k: v[0] + v[1] / n + v[2] / n ** 2 + v[3] / n ** 3 for k, v in _TAU_C_CRIT.items()}
    pv = _mackinnon_p(stat)
    return {"stat": stat, "pvalue": pv, "lags": p, "nobs": n, "crit_5": crit["5%"],
            "verdict": "stationary" if pv < 0.05 else "non-stationary"}


def arimax_fit(df: DataFrame, y: str, exog: Sequence[str], by=None, clock: str = "clock",
               long_ar: int = 10) -> dict:
    """Regression with ARMA(1,1) errors by Hannan-Rissanen (three OLS passes)."""
    exog = list(exog)
    m0, n0 = moments(df, [y] + exog)
    beta, _, _ = ols_from_moments(m0, n0, 1, [0] + list(range(2, 2 + len(exog))))
    u = F.col(y) - F.lit(float(beta[0]))
    for i, c in enumerate(exog):
        u = u - F.lit(float(beta[i + 1])) * F.col(c)
    x = windows.add_lags(df.withColumn("__u", u), ["__u"], range(1, long_ar + 1), by, clock, fmt="__ul{k}")
    m1, n1 = moments(x, ["__u"] + [f"__ul{k}" for k in range(1, long_ar + 1)])
    a, _, _ = ols_from_moments(m1, n1, 1, [0] + list(range(2, 2 + long_ar)))
    e = F.col("__u") - F.lit(float(a[0]))
    for k in range(1, long_ar + 1):
        e = e - F.lit(float(a[k])) * F.col(f"__ul{k}")
    x = windows.add_lags(x.withColumn("__e", e), ["__e"], [1], by, clock, fmt="__el1")
    m2, n2 = moments(x, ["__u", "__ul1", "__el1"])
    b2, ssr, _ = ols_from_moments(m2, n2, 1, [2, 3])
    last = x.where(F.col("__u").isNotNull()).agg(F.max_by(F.struct("__u", "__e"), clock).alias("r")).first()["r"]
    return {"y": y, "const": float(beta[0]), "beta": {c: float(beta[i + 1]) for i, c in enumerate(exog)},
            "phi": float(b2[0]), "theta": float(b2[1]), "sigma2": ssr / max(n2 - 2, 1), "n": n2,
            "u_T": float(last["__u"]), "e_T": float(last["__e"] or 0.0)}


def _mean_part(model: dict):
    """c + xβ as a column."""
    expr = F.lit(model["const"])
    for c, b in model["beta"].items():
        expr = expr + F.lit(b) * F.col(c)
    return expr


def arimax_forecast(test: DataFrame, model: dict, clock: str = "clock", by=None, out: str = "arimax") -> DataFrame:
    """Multi-step mean forecast: c + xβ + φ^{h-1}(φ u_T + θ e_T), h = row number in test."""
    u1 = model["phi"] * model["u_T"] + model["theta"] * model["e_T"]
    x = windows.numbered(test, clock, by=by, out="__h")
    return x.withColumn(out, _mean_part(model) + F.pow(F.lit(model["phi"]), F.col("__h")) * F.lit(u1)).drop("__h")


def arimax_one_step(df: DataFrame, model: dict, clock: str = "clock", by=None, out: str = "arimax_1") -> DataFrame:
    """One-step filter: c + xβ + φ u_{t−1} + θ e_{t−1}, from actual history.

    e is unrolled to Σ (−θ)^j (u_{t−1−j} − φ u_{t−2−j}) until θ^j is below 1e-12, so
    the filter is a linear expression over lags (a lag before the series' start
    counts as 0); θ must be invertible (|θ| < 1).
    """
    phi, theta = model["phi"], model["theta"]
    if abs(theta) >= 1:
        raise ValueError(f"moving-average part is not invertible: theta = {theta}")
    depth = 1 if theta == 0 else max(1, math.ceil(math.log(1e-12) / math.log(abs(theta))))
    weight = np.zeros(depth + 3)  # of u_{t-k}
    weight[1] += phi
    for j in range(depth + 1):
        weight[1 + j] += theta * (-theta) ** j
        weight[2 + j] -= theta * (-theta) ** j * phi
    x = df.withColumn("__u", F.col(model["y"]) - _mean_part(model))
    x = windows.add_lags(x, ["__u"], range(1, len(weight)), by, clock, fmt="__ul{k}")
    expr = _mean_part(model)
    for k in range(1, len(weight)):
        expr = expr + F.lit(float(weight[k])) * F.coalesce(F.col(f"__ul{k}"), F.lit(0.0))
    return x.withColumn(out, expr).drop("__u", *[f"__ul{k}" for k in range(1, len(weight))])


def naive_mean(train: DataFrame, test: DataFrame, col: str, by=None, out: str = "naive") -> DataFrame:
    """Every test row forecast by the training mean (per series)."""
    keys = _by(by)
    mu = train.groupBy(*keys).agg(F.avg(col).alias(out))
    return test.join(mu, keys, "left") if keys else test.withColumn(out, F.lit(mu.first()[0]))
