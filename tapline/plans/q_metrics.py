"""Registered queries: evaluation metrics, intervals, time-series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..functions.dist import t_ppf, t_ppf_sql
from ..operators import intervals, metrics, rank, tseries, windows
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures as W
from . import feature_table as FT
from . import sqlparts as P
from .registry import query

CLS = ["Low", "Normal", "High"]
CENTERS = {"Low": 0.15, "Normal": 0.5, "High": 1.2}


def scored(spark, d):
    """fx_pred with actual / predicted classes and per-class scores (deterministic)."""
    p = fx.fx_pred(spark, d)
    p = p.withColumns({"actual": S.cut_right_closed("hm_si", K.SI_EDGES, K.SI_LABELS),
                       "predicted": S.cut_right_closed("pred_si", K.SI_EDGES, K.SI_LABELS)})
    # sums and quotients only: both engines round those alike, so they see the same distinct thresholds
    raw = {c: F.lit(1.0) / (F.abs(F.col("pred_si") - F.lit(v)) * 10 + 1) for c, v in CENTERS.items()}
    tot = raw["Low"] + raw["Normal"] + raw["High"]
    return p.withColumns({f"p_{c.lower()}": raw[c] / tot for c in CLS})


SCORED_SQL = """scored as (select *, ((1e0 / (abs(pred_si - 0.15) * 10 + 1)) / t) as p_low,
   ((1e0 / (abs(pred_si - 0.5) * 10 + 1)) / t) as p_normal, ((1e0 / (abs(pred_si - 1.2) * 10 + 1)) / t) as p_high from (select *,
   (1e0 / (abs(pred_si - 0.15) * 10 + 1)) + (1e0 / (abs(pred_si - 0.5) * 10 + 1)) + (1e0 / (abs(pred_si - 1.2) * 10 + 1)) as t,
   case when hm_si is null then 'nan' when hm_si <= 0.25 then 'Low' when hm_si <= 0.8 then 'Normal' else 'High' end as actual,
   case when pred_si is null then 'nan' when pred_si <= 0.25 then 'Low' when pred_si <= 0.8 then 'Normal' else 'High' end as predicted
   from fx_pred))"""

PER_CLASS_SQL = """pc as (select cls, coalesce(tp, 0) as tp, coalesce(support, 0) as support, coalesce(n_pred, 0) as n_pred,
   case when coalesce(n_pred, 0) > 0 then coalesce(tp, 0) / n_pred else 0e0 end as precision,
   case when coalesce(support, 0) > 0 then coalesce(tp, 0) / support else 0e0 end as recall
 from (select actual as cls, count(*) as support from scored group by 1) s
 full join (select predicted as cls, count(*) as n_pred from scored group by 1) p using (cls)
 left join (select actual as cls, count(*) as tp from scored where actual = predicted group by 1) t using (cls)),
pcf as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end as f1 from pc)"""


@query("regression_metrics", W("""select taphole, count(*) as n,
  (1 - sum((hm_si - pred_si) ^ 2) / (var_pop(hm_si) * count(*))) as r2,
  (avg(abs(hm_si - pred_si))) as mae, (sqrt(sum((hm_si - pred_si) ^ 2) / count(*))) as rmse
from fx_pred where hm_si is not null and pred_si is not null group by taphole"""))
def q_regression_metrics(spark, d):
    """L1: R², MAE, RMSE per taphole (SST = n·var_pop, not squared correlation)."""
    return metrics.regression_metrics(fx.fx_pred(spark, d), "hm_si", "pred_si", by="taphole")


@query("classification_metrics", W("""select (sum(tp) / sum(support)) as accuracy,
  avg(precision) as precision_macro, avg(recall) as recall_macro, avg(f1) as f1_macro
from pcf""", SCORED_SQL + ",\n" + PER_CLASS_SQL))
def q_classification_metrics(spark, d):
    """L2: accuracy and macro scores with zero division → 0."""
    return metrics.classification_metrics(scored(spark, d), "actual", "predicted")


@query("class_report", W("""select cls as label, precision as precision, recall as recall,
  f1 as f1, support from pcf
union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from pcf
union all select 'weighted avg', (sum(precision * support) / sum(support)), (sum(recall * support) / sum(support)),
  (sum(f1 * support) / sum(support)), cast(sum(support) as bigint) from pcf""", SCORED_SQL + ",\n" + PER_CLASS_SQL))
def q_class_report(spark, d):
    return metrics.class_report(scored(spark, d), "actual", "predicted")


@query("confusion_matrix", W("""select actual, predicted, n, (n / sum(n) over (partition by actual)) as row_share
from (select actual, predicted, count(*) as n from scored group by 1, 2)""", SCORED_SQL))
def q_confusion_matrix(spark, d):
    return metrics.confusion_matrix(scored(spark, d), "actual", "predicted")


def _auc_sql(cls, col):
    return f"""select '{cls}' as label, (sum(npos * midrank) - sum(npos) * (sum(npos) + 1) / 2e0)
  / (sum(npos) * (sum(cnt) - sum(npos))) as auc from (
  select s, cnt, npos, coalesce(sum(cnt) over (order by s rows between unbounded preceding and 1 preceding), 0)
    + (cnt + 1) / 2e0 as midrank from (
    select {col} as s, count(*) as cnt, sum(case when actual = '{cls}' then 1 else 0 end) as npos from scored group by 1))"""


AUC_SQL = " union all ".join(_auc_sql(c, f"p_{c.lower()}") for c in CLS)


@query("roc_auc_ovr", W(f"""select label, auc as auc from ({AUC_SQL})
union all select 'macro', avg(auc) from ({AUC_SQL})""", SCORED_SQL))
def q_roc_auc_ovr(spark, d):
    """One-vs-rest AUC via mid-ranks (distributed prefix sums), macro row."""
    return metrics.roc_auc_ovr(scored(spark, d), "actual", {c: f"p_{c.lower()}" for c in CLS})


def _roc_sql(cls, col):
    return f"""select '{cls}' as label, s as threshold,
  (sum(fp) over (order by s desc rows between unbounded preceding and current row) / sum(fp) over ()) as fpr,
  (sum(tp) over (order by s desc rows between unbounded preceding and current row) / sum(tp) over ()) as tpr
from (select {col} as s, sum(case when actual = '{cls}' then 1 else 0 end) as tp,
  sum(case when actual = '{cls}' then 0 else 1 end) as fp from scored group by 1)"""


@query("roc_curve", W(" union all ".join(_roc_sql(c, f"p_{c.lower()}") for c in CLS), SCORED_SQL))
def q_roc_curve(spark, d):
    """ROC points per class at every distinct score."""
    return metrics.roc_curve(scored(spark, d), "actual", {c: f"p_{c.lower()}" for c in CLS})


ROC_SQL = " union all ".join(_roc_sql(c, f"p_{c.lower()}") for c in CLS)


@query("roc_macro", W("""select i as point_no, i / 199e0 as fpr, avg(case when b.x is null then a.y
    else a.y + (b.y - a.y) / (b.x - a.x) * (i / 199e0 - a.x) end) as tpr from (
  select label, i, (select max({'x': fpr, 'y': tpr}) from pts p where p.label = l.label and ceil(p.fpr * 199e0) <= i) as a,
    (select min({'x': fpr, 'y': tpr}) from pts p where p.label = l.label and ceil(p.fpr * 199e0) > i) as b
  from (select distinct label from pts) l, (select cast(range as integer) as i from range(200))) group by i""",
    SCORED_SQL + f", pts as (select label, fpr, tpr from ({ROC_SQL}) union all select unnest(['Low', 'Normal', 'High']), 0e0, 0e0)"))
def q_roc_macro(spark, d):
    """Macro-average ROC on the 200-point grid."""
    return metrics.macro_roc(metrics.roc_curve(scored(spark, d), "actual", {c: f"p_{c.lower()}" for c in CLS}))


@query("masked_metrics", W("""select taphole, count(*) as n_rows, count(case when p is not null then 1 end) as n,
  (1 - sum(case when p is not null then (hm_si - p) ^ 2 end)
        / (var_pop(case when p is not null then hm_si end) * count(case when p is not null then hm_si end))) as r2,
  (avg(case when p is not null then abs(hm_si - p) end)) as mae,
  (sqrt(sum(case when p is not null then (hm_si - p) ^ 2 end) / count(case when p is not null then 1 end))) as rmse
from (select *, lag(hm_si) over (partition by taphole order by clock) as p from series)
group by taphole""", P.SERIES))
def q_masked_metrics(spark, d):
    """Metrics of the persistence forecast over the hours that have one (a series' first hour has none)."""
    from .q_windows import series
    x = windows.add_lags(series(spark, d), ["hm_si"], [1], by="taphole", fmt="p")
    return metrics.masked_metrics(x, "hm_si", "p", by="taphole")


@query("residual_stats", W("""select taphole, avg(hm_si - pred_si) as bias,
  stddev_pop(hm_si - pred_si) as resid_std, count(*) as n from fx_pred
where hm_si - pred_si is not null group by taphole"""))
def q_residual_stats(spark, d):
    return metrics.residual_stats(fx.fx_pred(spark, d), "hm_si", "pred_si", by="taphole")


@query("residual_rows", W("""select tapno, hm_si as actual, pred_si as predicted, hm_si - pred_si as residual from fx_pred"""))
def q_residual_rows(spark, d):
    """One residual per scored row."""
    return fx.fx_pred(spark, d).select("tapno", F.col("hm_si").alias("actual"), F.col("pred_si").alias("predicted"),
                                       (F.col("hm_si") - F.col("pred_si")).alias("residual"))


@query("residual_histogram", W("""select bin, n, mn + (mx - mn) * bin / 40e0 as bin_lo, mn + (mx - mn) * (bin + 1) / 40e0 as bin_hi,
  n / (sum(n) over () * (mx - mn) / 40e0) as density from (
  select cast(least(floor((r - mn) / ((mx - mn) / 40e0)), 39) as integer) as bin, mn, mx, count(*) as n
  from (select tapno, hm_temp - pred_temp as r from fx_pred), (select min(hm_temp - pred_temp) as mn, max(hm_temp - pred_temp) as mx from fx_pred)
  where r is not null group by all)"""))
def q_residual_histogram(spark, d):
    """Histogram and density of the residuals."""
    from ..operators import aggs
    return aggs.histogram(fx.fx_pred(spark, d).select((F.col("hm_temp") - F.col("pred_temp")).alias("r")), "r", 40)


@query("scorecard", W("""select target, (coalesce(max(acc) filter (where model = 'noisy'), 0e0)) as noisy,
  (coalesce(max(acc) filter (where model = 'always_normal'), 0e0)) as always_normal,
  (coalesce(max(acc) filter (where model = 'unscored'), 0e0)) as unscored from (
  select 'si_class' as target, 'noisy' as model, avg(case when actual = predicted then 1e0 else 0e0 end) as acc from scored
  union all select 'si_class', 'always_normal', avg(case when actual = 'Normal' then 1e0 else 0e0 end) from scored
  union all select 'temp_class', 'noisy', avg(case when (case when hm_temp <= 1480 then 'Low' when hm_temp <= 1535 then 'Normal' else 'High' end)
     = (case when pred_temp <= 1480 then 'Low' when pred_temp <= 1535 then 'Normal' else 'High' end) then 1e0 else 0e0 end) from scored)
group by target""", SCORED_SQL))
def q_scorecard(spark, d):
    """Target × model accuracy matrix; a pair never evaluated is 0."""
    s = scored(spark, d)
    t_act = S.cut_right_closed("hm_temp", K.TEMP_EDGES, K.TEMP_LABELS)
    t_pred = S.cut_right_closed("pred_temp", K.TEMP_EDGES, K.TEMP_LABELS)
    acc = (s.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("a1"),
                 F.avg((F.col("actual") == "Normal").cast("double")).alias("a2"),
                 F.avg((t_act == t_pred).cast("double")).alias("a3"))
           .selectExpr("stack(3, 'si_class', 'noisy', a1, 'si_class', 'always_normal', a2, "
                       "'temp_class', 'noisy', a3) as (target, model, acc)"))
    return metrics.scorecard(acc, "target", "model", "acc", ["noisy", "always_normal", "unscored"])


@query("best_model", W("""select taphole, model as best_model, r2 as r2 from (
  select *, row_number() over (partition by taphole order by r2 desc, model_order) as rn from (
    select taphole, 'noisy' as model, 1 as model_order, 1 - sum((hm_si - pred_si) ^ 2) / (var_pop(hm_si) * count(*)) as r2
      from fx_pred group by taphole
    union all select taphole, 'shrunk', 2, 1 - sum((hm_si - (0.5 * pred_si + 0.5 * m)) ^ 2) / (var_pop(hm_si) * count(*))
      from (select *, avg(hm_si) over (partition by taphole) as m from fx_pred) group by taphole
    union all select taphole, 'mean', 3, 0e0 from fx_pred group by taphole)) where rn = 1"""))
def q_best_model(spark, d):
    """Arg-max R² per taphole over candidate predictors; the first listed wins ties."""
    p = fx.fx_pred(spark, d)
    # the group mean is an aggregate of one row per group, joined back; no group is gathered
    p = p.join(p.groupBy("taphole").agg(F.avg("hm_si").alias("m")), "taphole")
    p = p.withColumn("shrunk", 0.5 * F.col("pred_si") + 0.5 * F.col("m"))
    a = metrics.regression_metrics(p, "hm_si", "pred_si", by="taphole").select(
        "taphole", F.lit("noisy").alias("model"), F.lit(1).alias("model_order"), "r2")
    b = metrics.regression_metrics(p, "hm_si", "shrunk", by="taphole").select(
        "taphole", F.lit("shrunk").alias("model"), F.lit(2).alias("model_order"), "r2")
    c = a.select("taphole", F.lit("mean").alias("model"), F.lit(3).alias("model_order"), F.lit(0.0).alias("r2"))
    return rank.best_model(a.unionByName(b).unionByName(c), "taphole", "r2")


# ------------------------------------------------------------------ intervals

PI_SQL = f"""st as (select sqrt(avg((hm_si - pred_si) ^ 2)) as rmse, count(*) as n from fx_pred
  where hm_si is not null and pred_si is not null),
ht as (select {t_ppf_sql(0.975, 'greatest(n - 2, 1)')} * rmse * sqrt(1 + 1e0 / n) as half,
              {t_ppf_sql(0.975, 'greatest(n - 2, 1)')} * rmse / sqrt(n) as ci_half,
              {t_ppf_sql(0.975, 'greatest(n - 2, 1)')} as t_crit from st)"""


@query("pi_rmse", W("""select tapno, (pred_si - half) as pi_lo, (pred_si + half) as pi_hi,
  coalesce(hm_si between pred_si - half and pred_si + half, false) as in_pi from fx_pred, ht""", PI_SQL))
def q_pi_rmse(spark, d):
    """ŷ ± t·RMSE·√(1+1/n) for every scored row, plus the in-interval flag."""
    p = fx.fx_pred(spark, d)
    rmse, n = intervals.rmse_scalars(p, "hm_si", "pred_si")
    x = intervals.pi_rmse(p, "pred_si", rmse, n, n_features=1)
    return x.select("tapno", "pi_lo", "pi_hi", S.in_spec("hm_si", F.col("pi_lo"), F.col("pi_hi")).alias("in_pi"))


@query("ci_vs_pi", W("""select t_crit as t_crit, ci_half as ci_half, half as pi_half
from ht""", PI_SQL))
def q_ci_vs_pi(spark, d):
    """M1d: mean-response CI against observation PI (half-widths)."""
    rmse, n = intervals.rmse_scalars(fx.fx_pred(spark, d), "hm_si", "pred_si")
    r = intervals.ci_vs_pi(rmse, n, 1)
    return spark.createDataFrame([(r["t_crit"], r["ci_half"], r["pi_half"])], "t_crit double, ci_half double, pi_half double")


_T4 = t_ppf(0.975, 4)


@query("cv_ci", W(f"""select k, mean as mean, std as std,
  (greatest(0e0, mean - {_T4!r} * std / sqrt(k))) as ci_lo, (least(1e0, mean + {_T4!r} * std / sqrt(k))) as ci_hi
from (select count(*) as k, avg(r2) as mean, stddev_samp(r2) as std from (
  select fold, 1 - sum((hm_si - pred_si) ^ 2) / (var_pop(hm_si) * count(*)) as r2 from (
    select *, case when r < (n % 5) * (n // 5 + 1) then r // (n // 5 + 1)
                   else (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) end as fold
    from (select *, row_number() over (order by tapno) - 1 as r, count(*) over () as n from fx_pred)) group by fold))"""))
def q_cv_ci(spark, d):
    """M1e: 5 contiguous folds (unshuffled K-fold) → per-fold R² → t interval clipped to [0, 1]."""
    p = intervals.kfold_index(fx.fx_pred(spark, d), 5, "tapno")
    folds = metrics.regression_metrics(p, "hm_si", "pred_si", by="fold").select("fold", "r2")
    return intervals.cv_ci(folds, "r2")


# ------------------------------------------------------------------ time series

TS_SQL = """ts as (select date_trunc('hour', sampletaken) as clock, avg(hm_si) as hm_si, avg(hm_temp) as hm_temp
  from fx_tap group by 1)"""


def ts_hourly(spark, d):
    from ..operators import aggs
    return aggs.hourly_mean(fx.fx_tap(spark, d), "sampletaken", ["hm_si", "hm_temp"])


@query("acf", W("""select a.taphole, a.lag, (a.num / b.den) as acf, (1.959963984540054 / sqrt(b.n)) as band
from (select x.taphole, cast(x.rn - y.rn as integer) as lag, sum(x.d * y.d) as num from dd x join dd y
      on x.taphole = y.taphole and x.rn - y.rn between 1 and 40 group by 1, 2) a
join (select taphole, count(*) as n, sum(d * d) as den from dd group by taphole) b using (taphole)""",
    P.SERIES + """, dd as (select taphole, clock, hm_si - avg(hm_si) over (partition by taphole) as d,
      row_number() over (partition by taphole order by clock) as rn from series where hm_si is not null)"""))
def q_acf(spark, d):
    """ACF to 40 lags per taphole series with the ±1.96/√n band."""
    from .q_windows import series
    return tseries.acf(series(spark, d), "hm_si", 40, by="taphole")


@query("naive_mean", W(f"""select s.taphole, s.clock, s.hm_si as hm_si, m.naive as naive from (
  select *, row_number() over (partition by taphole order by clock) as rn, count(*) over (partition by taphole) as n
  from series) s join (select taphole, avg(hm_si) as naive from (select *, row_number() over (partition by taphole order by clock) as rn,
  count(*) over (partition by taphole) as n from series) where rn <= floor(n * 0.8) group by taphole) m using (taphole)
where s.rn > floor(s.n * 0.8)""", P.SERIES))
def q_naive_mean(spark, d):
    """Test rows forecast by the training mean of their series."""
    from .q_windows import series
    s = windows.chrono_split(series(spark, d), by="taphole")
    return tseries.naive_mean(s.where("split = 'train'"), s.where("split = 'test'"), "hm_si", by="taphole") \
        .select("taphole", "clock", "hm_si", "naive")


@query("var1_moments", W("""select regr_slope(hm_si, si1) as slope_si_on_si1, regr_intercept(hm_si, si1) as icpt_si,
  regr_slope(hm_temp, t1) as slope_temp_on_t1, regr_intercept(hm_temp, t1) as icpt_temp, count(*) as n from (
  select *, lag(hm_si) over (order by clock) as si1, lag(hm_temp) over (order by clock) as t1 from ts)
where si1 is not null and t1 is not null and hm_si is not null and hm_temp is not null""", TS_SQL))
def q_var1_moments(spark, d):
    """N5 building block: lag-1 regressions on the hourly series, one aggregate."""
    x = tseries.lagged(ts_hourly(spark, d), ["hm_si", "hm_temp"], 1).dropna(subset=["hm_si", "hm_temp", "hm_si_l1", "hm_temp_l1"])
    return x.agg(F.regr_slope("hm_si", "hm_si_l1").alias("slope_si_on_si1"), F.regr_intercept("hm_si", "hm_si_l1").alias("icpt_si"),
                 F.regr_slope("hm_temp", "hm_temp_l1").alias("slope_temp_on_t1"),
                 F.regr_intercept("hm_temp", "hm_temp_l1").alias("icpt_temp"), F.count(F.lit(1)).alias("n"))


@query("fit_var")
def q_fit_var(spark, d):
    """VAR(p ≤ 12) by AIC on the hourly (si, temp) series → coefficient table."""
    m = tseries.fit_var(ts_hourly(spark, d), ["hm_si", "hm_temp"], maxlags=12)
    rows = []
    regs = ["const"] + [f"{c}_l{j}" for j in range(1, m["p"] + 1) for c in m["cols"]]
    for e, c in enumerate(m["cols"]):
        rows += [(c, r, float(m["coef"][e, i]), m["p"], m["aic"]) for i, r in enumerate(regs)]
    return spark.createDataFrame(rows, "equation string, regressor string, coef double, p int, aic double")


@query("var_forecast")
def q_var_forecast(spark, d):
    """N5 + M1f: one-step VAR forecasts over the test part with ±z·σ intervals."""
    s = windows.chrono_split(ts_hourly(spark, d))
    m = tseries.fit_var(s.where("split = 'train'"), ["hm_si", "hm_temp"], maxlags=12)
    f = tseries.var_forecast(s, m)
    f = tseries.var_pi(f, m).where("split = 'test'")
    return f.select("clock", "hm_si", "hm_temp", "var_hm_si", "var_hm_si_lo", "var_hm_si_hi", "var_hm_temp")


def _var1_sql():
    # two-regressor OLS per equation from centred moments (Cramer's rule), residual
    # variance with T − 3 degrees of freedom, interval half-width z·σ
    eq = []
    for y in ("hm_si", "hm_temp"):
        eq.append(f"""select '{y}' as equation, b1, b2, (my - b1 * m1 - b2 * m2) as const,
      (syy - b1 * s1y - b2 * s2y) / (n - 3) as sigma2 from (
      select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1,
                (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2 from (
        select count(*) as n, avg({y}) as my, avg(si1) as m1, avg(t1) as m2,
          sum((si1 - m1x) * (si1 - m1x)) as s11, sum((t1 - m2x) * (t1 - m2x)) as s22,
          sum((si1 - m1x) * (t1 - m2x)) as s12, sum((si1 - m1x) * ({y} - myx)) as s1y,
          sum((t1 - m2x) * ({y} - myx)) as s2y, sum(({y} - myx) * ({y} - myx)) as syy
        from (select *, avg(si1) over () as m1x, avg(t1) over () as m2x, avg({y}) over () as myx from lagged)))""")
    return " union all ".join(eq)


VAR1_SQL = TS_SQL + """, lagged as (select * from (select hm_si, hm_temp, lag(hm_si) over (order by clock) as si1,
  lag(hm_temp) over (order by clock) as t1 from ts) where si1 is not null and t1 is not null
  and hm_si is not null and hm_temp is not null)"""


@query("pi_var", W(f"""select equation, const as const, b1 as coef_hm_si_l1, b2 as coef_hm_temp_l1,
  sqrt(sigma2) as sigma, (1.959963984540054 * sqrt(sigma2)) as pi_half from ({_var1_sql()})""", VAR1_SQL))
def q_pi_var(spark, d):
    """M1f: VAR(1) on the hourly (si, temp) series; residual-covariance interval ±z·√Σ_ii."""
    from ..functions.dist import norm_ppf
    m = tseries.fit_var(ts_hourly(spark, d), ["hm_si", "hm_temp"], maxlags=1, fixed_p=1)
    z = norm_ppf(0.975)
    rows = [(c, float(m["coef"][e, 0]), float(m["coef"][e, 1]), float(m["coef"][e, 2]),
             float(m["sigma_u"][e, e] ** 0.5), float(z * m["sigma_u"][e, e] ** 0.5)) for e, c in enumerate(m["cols"])]
    return spark.createDataFrame(rows, "equation string, const double, coef_hm_si_l1 double, coef_hm_temp_l1 double, "
                                       "sigma double, pi_half double")


@query("pi_var_coverage")
def q_pi_var_coverage(spark, d):
    """M1f on the test part: coverage of the AIC-chosen VAR's ±z·σ interval."""
    from ..operators import aggs
    f = q_var_forecast(spark, d)
    return aggs.interval_coverage(f, "hm_si", "var_hm_si_lo", "var_hm_si_hi")


@query("pacf")
def q_pacf(spark, d):
    """Partial autocorrelations (OLS and Yule-Walker) to 40 lags."""
    s = ts_hourly(spark, d)
    a = tseries.pacf(s, "hm_si", 40, method="ols")
    b = tseries.pacf(s, "hm_si", 40, method="yw")
    return spark.createDataFrame([(k, float(a[k]), float(b[k])) for k in range(len(a))],
                                 "lag int, pacf_ols double, pacf_yw double")


@query("adf_test")
def q_adf_test(spark, d):
    """ADF statistic, MacKinnon p-value, 5 % critical value, verdict per target."""
    s = ts_hourly(spark, d)
    rows = []
    for c in ["hm_si", "hm_temp"]:
        r = tseries.adf_test(s, c)
        rows.append((c, r.get("stat"), r.get("pvalue"), r.get("lags"), r.get("crit_5"), r.get("verdict")))
    return spark.createDataFrame(rows, "target string, stat double, pvalue double, lags int, crit_5 double, verdict string")


@query("arimax")
def q_arimax(spark, d):
    """Regression with ARMA(1,1) errors (Hannan-Rissanen), multi-step and one-step forecasts of the test part, both targets."""
    from ..operators import clean
    f = windows.chrono_split(FT.feature_table(spark, d))
    ex = ["hbt", "oxygen_flow", "coal_actual"]
    tr = f.where("split = 'train'")
    f = clean.scale_minmax(clean.scale_minmax(clean.scale_minmax(f, ex[0], tr), ex[1], tr), ex[2], tr).checkpoint()
    out = None
    for t in ["hm_si", "hm_temp"]:
        m = tseries.arimax_fit(f.where("split = 'train'"), t, ex)
        g = tseries.arimax_one_step(f, m).where("split = 'test'")
        g = tseries.arimax_forecast(g, m).select("clock", F.lit(t).alias("target"), F.col(t).alias("actual"), "arimax", "arimax_1",
                                                 F.lit(m["phi"]).alias("phi"), F.lit(m["theta"]).alias("theta"))
        out = g if out is None else out.unionByName(g)
    return out
