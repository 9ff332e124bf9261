"""Registered queries: clock-ordered window features (F1-F10) and ranking (G, H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggs, rank, windows
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures as W
from . import feature_table as FT
from . import sqlparts as P
from .registry import query

T = ["hm_si", "hm_temp"]
WS = "over (partition by taphole order by clock"


def series(spark, d):
    """Hourly tap series per taphole (the multi-series view)."""
    return aggs.hourly_mean(fx.fx_tap(spark, d), "sampletaken", T, by="taphole")


def _sel(cols):
    return ", ".join(cols)


@query("target_lags", W("select taphole, clock, " + ", ".join(
    f"lag({c}, {k}) {WS}) as {c}_lag{k}" for c in T for k in (1, 2, 3)) + " from series", P.SERIES))
def q_target_lags(spark, d):
    s = windows.add_lags(series(spark, d), T, [1, 2, 3], by="taphole")
    return s.select("taphole", "clock", *[f"{c}_lag{k}" for c in T for k in (1, 2, 3)])


PROC = ["hbt", "oxygen_flow", "coal_actual"]


@query("process_lags", W("select clock, " + ", ".join(
    f"(lag({c}, {k}) over (order by clock)) as {c}_lag{k}" for c in PROC for k in (2, 4, 8))
    + " from feat", P.FEATURE_CTES))
def q_process_lags(spark, d):
    """F2 on the single-furnace feature table (hour-bounded, one ordered series)."""
    f = windows.add_lags(FT.feature_table(spark, d), PROC, [2, 4, 8])
    return f.select("clock", *[f"{c}_lag{k}" for c in PROC for k in (2, 4, 8)])


@query("future_target", W(f"select taphole, clock, lead(hm_si, 1) {WS}) as hm_si_next, "
                          f"lead(hm_temp, 1) {WS}) as hm_temp_next from series", P.SERIES))
def q_future_target(spark, d):
    return windows.add_leads(series(spark, d), T, 1, by="taphole").select(
        "taphole", "clock", "hm_si_next", "hm_temp_next")


@query("first_diff", W(f"select taphole, clock, hm_si - lag(hm_si, 1) {WS}) as hm_si_diff1, "
                       f"hm_temp - lag(hm_temp, 1) {WS}) as hm_temp_diff1 from series", P.SERIES))
def q_first_diff(spark, d):
    return windows.add_diffs(series(spark, d), T, by="taphole").select(
        "taphole", "clock", "hm_si_diff1", "hm_temp_diff1")


def _roll_sql(c, w):
    f = f"{WS} rows between {w - 1} preceding and current row)"
    return f"(case when count({c}) {f} >= 2 then avg({c}) {f} end) as {c}_roll{w}"


@query("rolling_mean", W("select taphole, clock, " + ", ".join(_roll_sql(c, w) for c in T for w in (4, 8))
                         + " from series", P.SERIES))
def q_rolling_mean(spark, d):
    s = windows.add_rolling_mean(series(spark, d), T, [4, 8], by="taphole")
    return s.select("taphole", "clock", *[f"{c}_roll{w}" for c in T for w in (4, 8)])


def _proll_sql(c, w):
    f = f"{WS} rows between {w} preceding and 1 preceding)"
    return f"(case when count({c}) {f} = {w} then avg({c}) {f} end) as {c}_proll{w}"


@query("rolling_mean_prior", W("select taphole, clock, " + ", ".join(_proll_sql(c, w) for c in T for w in (4, 8))
                               + " from series", P.SERIES))
def q_rolling_mean_prior(spark, d):
    s = windows.add_rolling_mean_prior(series(spark, d), T, [4, 8], by="taphole")
    return s.select("taphole", "clock", *[f"{c}_proll{w}" for c in T for w in (4, 8)])


def _rstd_sql(c):
    f = f"{WS} rows between 3 preceding and current row)"
    return f"(coalesce(case when count({c}) {f} >= 2 then stddev_samp({c}) {f} end, 0e0)) as {c}_rstd4"


@query("rolling_std", W("select taphole, clock, " + ", ".join(_rstd_sql(c) for c in T) + " from series",
                        P.SERIES))
def q_rolling_std(spark, d):
    s = windows.add_rolling_std(series(spark, d), T, 4, by="taphole")
    return s.select("taphole", "clock", "hm_si_rstd4", "hm_temp_rstd4")


@query("chrono_split", W(f"""select taphole, clock, cast(row_number() {WS}) as integer) as row_no,
  case when row_number() {WS}) <= floor(count(*) over (partition by taphole) * 0.8) then 'train' else 'test' end as split
from series""", P.SERIES))
def q_chrono_split(spark, d):
    return windows.chrono_split(series(spark, d), by="taphole").select("taphole", "clock", "row_no", "split")


@query("union_by_name", W(f"""select taphole, clock, hm_si as hm_si, split from (
  select *, case when row_number() {WS}) <= floor(count(*) over (partition by taphole) * 0.8)
    then 'train' else 'test' end as split from series)""", P.SERIES))
def q_union_by_name(spark, d):
    """H1: train and test parts glued back by column name."""
    s = windows.chrono_split(series(spark, d), by="taphole").select("taphole", "clock", "hm_si", "split")
    train = s.where("split = 'train'")
    test = s.where("split = 'test'").select("split", "hm_si", "clock", "taphole")
    return rank.union_by_name(train, test)


@query("lookback_sequences", W(f"""select a.taphole, a.clock, cast(b.rn - a.rn + 24 as integer) as step,
  b.hm_si as hm_si, b.hm_temp as hm_temp
from (select *, row_number() {WS}) as rn from series) a
join (select *, row_number() {WS}) as rn from series) b
  on a.taphole = b.taphole and b.rn between a.rn - 24 and a.rn - 1
where a.rn > 24""", P.SERIES))
def q_lookback_sequences(spark, d):
    """24-step lookback tensors, exploded to (step, values) for checking."""
    s = windows.lookback_sequences(series(spark, d), T, 24, by="taphole")
    x = s.select("taphole", "clock", F.posexplode("seq").alias("step", "v"))
    return x.select("taphole", "clock", "step", F.col("v")[0].alias("hm_si"), F.col("v")[1].alias("hm_temp"))


@query("sort_clock", W("select taphole, clock, hm_si as hm_si from series", P.SERIES))
def q_sort_clock(spark, d):
    return rank.sort_clock(series(spark, d).select("taphole", "clock", "hm_si"))


@query("head_n", W("select clock, hm_si as hm_si, hm_temp as hm_temp from feat "
                   "order by clock limit 50", P.FEATURE_CTES))
def q_head_n(spark, d):
    """First 50 rows of the ordered table (the limit is the feature)."""
    return rank.head_n(FT.feature_table(spark, d).select("clock", "hm_si", "hm_temp"), 50, "clock")


@query("topk_per_group", W("""select taphole, clock, hm_si as hm_si, cast(rank as integer) as rank from (
  select *, row_number() over (partition by taphole order by hm_si desc, clock) as rank from series)
where rank <= 3""", P.SERIES))
def q_topk_per_group(spark, d):
    return rank.topk_per_group(series(spark, d), 3, "taphole", "hm_si", tie="clock").select(
        "taphole", "clock", "hm_si", "rank")


CORR_FEATS = ["hbt", "oxygen_flow", "coal_actual", "prod_rate", "etaco", "permeability", "ore_coke_ratio",
              "thermal_idx", "coal_intensity", "gas_eff", "coke_kg", "sinter_kg"]


def corr_long(spark, d, target):
    f = FT.feature_table(spark, d)
    wide = f.agg(*[F.corr(c, target).alias(c) for c in CORR_FEATS])
    stack = ", ".join(f"'{c}', `{c}`" for c in CORR_FEATS)
    return wide.selectExpr(f"stack({len(CORR_FEATS)}, {stack}) as (feature, corr)")


def _corr_sql(target):
    return " union all ".join(f"select '{c}' as feature, corr({c}, {target}) as corr from feat" for c in CORR_FEATS)


@query("topk_abs", W(f"""select feature, corr as corr, cast(rank as integer) as rank from (
  select *, row_number() over (order by round(abs(corr), 9) desc, feature) as rank from ({_corr_sql('hm_temp')}))
where rank <= 8""", P.FEATURE_CTES))
def q_topk_abs(spark, d):
    """Top-8 features by absolute correlation with the temperature."""
    return rank.topk_abs(corr_long(spark, d, "hm_temp"), 8, "corr", tie="feature", digits=9)


def importance(spark, d, target="hm_si"):
    c = corr_long(spark, d, target).withColumn("a", F.abs("corr"))
    # the window spans the feature list (a dozen rows), not data rows
    return c.select("feature", (F.col("a") / F.sum("a").over(Window.partitionBy())).alias("importance"))


_IMP_SQL = f"select feature, abs(corr) / sum(abs(corr)) over () as importance from ({_corr_sql('hm_si')})"


@query("importance_table", W(f"""select feature, importance as importance,
  cast(row_number() over (order by round(importance, 9) desc, feature) as integer) as rank, round(importance * 100, 2) as score_pct
from ({_IMP_SQL})""", P.FEATURE_CTES))
def q_importance_table(spark, d):
    return rank.importance_table(importance(spark, d), digits=9)


@query("rank_features", W(f"""select feature, cast(row_number() over (order by round(importance, 9) desc, feature) as integer) as rank
from ({_IMP_SQL})""", P.FEATURE_CTES))
def q_rank_features(spark, d):
    """1-based numbering of the importance-ordered feature list."""
    return windows.rank_numbers(importance(spark, d), "importance", tie="feature", digits=9).select("feature", "rank")


@query("ordered_union", W(f"""select feature, cast(row_number() over (order by l, p) as integer) as order_no from (
  select feature, min(l * 100 + p) // 100 as l, min(l * 100 + p) % 100 as p from (
    select feature, 0 as l, row_number() over (order by round(abs(corr), 9) desc, feature) as p from ({_corr_sql('hm_si')})
    qualify p <= 5
    union all
    select feature, 1 as l, row_number() over (order by round(abs(corr), 9) desc, feature) as p from ({_corr_sql('hm_temp')})
    qualify p <= 5) group by feature)""", P.FEATURE_CTES))
def q_ordered_union(spark, d):
    """H2: top-5 lists of the two targets merged, first occurrence keeps its place."""
    a = rank.topk_abs(corr_long(spark, d, "hm_si"), 5, "corr", tie="feature", out="pos", digits=9)
    b = rank.topk_abs(corr_long(spark, d, "hm_temp"), 5, "corr", tie="feature", out="pos", digits=9)
    return rank.ordered_union([a, b])


@query("distinct_by_key", W("""select feature, pipeline, mean as mean from (
  select *, row_number() over (partition by feature order by pipeline desc) as rn from (
    select 1 as pipeline, 'hm_si' as feature, avg(hm_si) as mean from fx_tap
    union all select 1, 'hm_temp', avg(hm_temp) from fx_tap
    union all select 1, 'hm_s', avg(hm_s) from fx_tap
    union all select 2, 'hm_si', avg(hm_si) from feat
    union all select 2, 'hm_temp', avg(hm_temp) from feat)) where rn = 1""", P.FEATURE_CTES))
def q_distinct_by_key(spark, d):
    """H3: per-feature statistics from two pipelines; the later pipeline wins."""
    t = fx.fx_tap(spark, d)
    p1 = t.agg(*[F.avg(c).alias(c) for c in ("hm_si", "hm_temp", "hm_s")])
    p1 = p1.selectExpr("stack(3, 'hm_si', hm_si, 'hm_temp', hm_temp, 'hm_s', hm_s) as (feature, mean)") \
        .withColumn("pipeline", F.lit(1))
    p2 = FT.feature_table(spark, d).agg(F.avg("hm_si").alias("hm_si"), F.avg("hm_temp").alias("hm_temp")) \
        .selectExpr("stack(2, 'hm_si', hm_si, 'hm_temp', hm_temp) as (feature, mean)").withColumn("pipeline", F.lit(2))
    return rank.distinct_by_key(p1.unionByName(p2), "feature", "pipeline").select("feature", "pipeline", "mean")


@query("time_lags", W("""select s.taphole, s.clock, a.hm_si as hm_si_tlag1, b.hm_si as hm_si_tlag3,
  r.m as hm_si_troll4
from series s
left join series a on a.taphole = s.taphole and a.clock = s.clock - interval 1 hour
left join series b on b.taphole = s.taphole and b.clock = s.clock - interval 3 hour
left join (select s1.taphole, s1.clock, case when count(s2.hm_si) >= 2 then avg(s2.hm_si) end as m
           from series s1 join series s2 on s1.taphole = s2.taphole
             and s2.clock between s1.clock - interval 3 hour and s1.clock
           group by 1, 2) r on r.taphole = s.taphole and r.clock = s.clock""", P.SERIES))
def q_time_lags(spark, d):
    """F1/F5 by time: value exactly 1 h / 3 h earlier and a 4-hour mean (gaps stay NULL)."""
    s = windows.add_time_lags(series(spark, d), ["hm_si"], [1, 3], by="taphole")
    s = windows.add_time_rolling_mean(s, ["hm_si"], [4], by="taphole")
    return s.select("taphole", "clock", "hm_si_tlag1", "hm_si_tlag3", "hm_si_troll4")
