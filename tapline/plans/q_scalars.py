"""Registered queries: labels, checks, lookups and schema repair (I, B1-B7, D8-D10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import aggs, ingest, joins
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures as W
from . import feature_table as FT
from . import sqlparts as P
from .registry import query


def spec_table(spark, limits=None):
    """Specification limits as a small DataFrame (size fixed by the constant)."""
    limits = limits or K.SPEC_LIMITS
    return spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in limits.items()],
                                 "target string, spec_lo double, spec_hi double")


SPEC_SQL = "spec as (select * from (values " + ", ".join(
    f"('{k}', {lo}e0, {hi}e0)" for k, (lo, hi) in K.SPEC_LIMITS.items()) + ") t(target, spec_lo, spec_hi))"


@query("tertile_label", W("""select tapno, hm_si as hm_si, case when hm_si is null then null
  when hm_si < q.a then 0 when hm_si <= q.b then 1 else 2 end as si_tertile
from fx_tap, (select quantile_cont(hm_si, 0.33) as a, quantile_cont(hm_si, 0.66) as b from fx_tap) q"""))
def q_tertile_label(spark, d):
    """Tertile classes from the 33rd/66th percentile (asymmetric edges)."""
    t = fx.fx_tap(spark, d)
    q = aggs.exact_quantiles_distributed(t, "hm_si", [0.33, 0.66]).first()  # two scalars
    return t.select("tapno", "hm_si", S.tertile_label("hm_si", F.lit(q[0]), F.lit(q[1])).alias("si_tertile"))


@query("cut_bins", W("""select tapno, case when hm_si is null then 'nan' when hm_si <= 0.25 then 'Low'
  when hm_si <= 0.8 then 'Normal' else 'High' end as si_class,
  case when hm_temp is null then 'nan' when hm_temp <= 1480 then 'Cold' when hm_temp <= 1535 then 'Normal'
  else 'Hot' end as temp_class from fx_tap"""))
def q_cut_bins(spark, d):
    """Right-closed bins; 0.25 is Low, 1480 is Cold."""
    t = fx.fx_tap(spark, d)
    return t.select("tapno", S.cut_right_closed("hm_si", K.SI_EDGES, K.SI_LABELS).alias("si_class"),
                    S.cut_right_closed("hm_temp", K.TEMP_EDGES, K.TEMP_LABELS_HOTCOLD).alias("temp_class"))


GRADE_SQL = """case (case when coalesce(hm_si between 0.25 and 0.8, false) then 0 else 1 end
   + case when coalesce(hm_temp between 1480 and 1535, false) then 0 else 1 end
   + case when coalesce(hm_s <= 0.055, false) then 0 else 1 end
   + case when coalesce(hm_p <= 0.18, false) then 0 else 1 end) when 0 then 'A' when 1 then 'B' else 'C' end"""


@query("quality_grade", W(f"select tapno, {GRADE_SQL} as quality_grade from fx_tap"))
def q_quality_grade(spark, d):
    """Count of failed checks → grade A/B/C."""
    t = fx.fx_tap(spark, d)
    return t.select("tapno", S.quality_grade("hm_si", "hm_temp", "hm_s", "hm_p").alias("quality_grade"))


@query("desirability_alert", W(f"""select tapno, quality_grade,
  case quality_grade when 'A' then 1e0 when 'B' then 5e-1 when 'C' then -1e0 else 0e0 end as desirability,
  case when (case quality_grade when 'A' then 1e0 when 'B' then 5e-1 when 'C' then -1e0 else 0e0 end) >= 0.5
    then 'OK' else 'OFF-SPEC' end as alert
from (select tapno, {GRADE_SQL} as quality_grade from fx_tap)"""))
def q_desirability_alert(spark, d):
    """Class → desirability score → alert below 0.5."""
    t = fx.fx_tap(spark, d).select("tapno", S.quality_grade("hm_si", "hm_temp", "hm_s", "hm_p")
                                   .alias("quality_grade"))
    t = t.withColumn("desirability", S.desirability("quality_grade", F.col("quality_grade")))
    return t.withColumn("alert", S.alert_text("desirability"))


def tap_long(spark, d, cols=("hm_si", "hm_temp", "hm_s", "hm_p")):
    t = fx.fx_tap(spark, d)
    stack = ", ".join(f"'{c}', {c}" for c in cols)
    return t.selectExpr("tapno", f"stack({len(cols)}, {stack}) as (target, value)")


@query("spec_check", W("""select t.tapno, t.target, t.value as value, s.spec_lo, s.spec_hi,
  coalesce(t.value between s.spec_lo and s.spec_hi, false) as in_spec,
  case when coalesce(t.value between s.spec_lo and s.spec_hi, false) then 'in spec' else 'out of spec' end as status
from (select tapno, 'hm_si' as target, hm_si as value from fx_tap union all select tapno, 'hm_temp', hm_temp from fx_tap
      union all select tapno, 'hm_s', hm_s from fx_tap union all select tapno, 'hm_p', hm_p from fx_tap) t
join spec s using (target)""", SPEC_SQL))
def q_spec_check(spark, d):
    """I4: closed spec interval per target (limits table is constant-size → broadcast)."""
    x = tap_long(spark, d).join(F.broadcast(spec_table(spark)), "target")
    ok = S.in_spec("value", F.col("spec_lo"), F.col("spec_hi"))
    return x.select("tapno", "target", "value", "spec_lo", "spec_hi", ok.alias("in_spec"),
                    F.when(ok, "in spec").otherwise("out of spec").alias("status"))


@query("operating_window", W("""select tapno, coalesce(pred_si between 0.25 and 0.8, false) as si_ok,
  coalesce(pred_temp between 1470 and 1540, false) as temp_ok,
  case when coalesce(pred_si between 0.25 and 0.8, false) and coalesce(pred_temp between 1470 and 1540, false)
    then 'inside' else 'outside' end as window from fx_pred"""))
def q_operating_window(spark, d):
    """Both predicted targets inside their specification."""
    p = fx.fx_pred(spark, d)
    si = S.in_spec("pred_si", *K.SPEC_LIMITS["hm_si"])
    te = S.in_spec("pred_temp", *K.SPEC_LIMITS["hm_temp"])
    return p.select("tapno", si.alias("si_ok"), te.alias("temp_ok"),
                    F.when(si & te, "inside").otherwise("outside").alias("window"))


@query("guarded_ratio", W("""select clock, (total_iron_kg / greatest(coke_kg, 1e0)) as ore_coke_guarded,
  (coal_actual / greatest(prod_rate, 1e0)) as coal_intensity_guarded,
  (total_flux_kg / greatest(total_iron_kg, 1e0)) as flux_iron_guarded from feat""", P.FEATURE_CTES))
def q_guarded_ratio(spark, d):
    """Inference-time ratios with max(den, 1) (differs from B16 on zeros)."""
    f = FT.feature_table(spark, d)
    return f.select("clock", S.guarded_ratio("total_iron_kg", "coke_kg", 1.0).alias("ore_coke_guarded"),
                    S.guarded_ratio("coal_actual", "prod_rate", 1.0).alias("coal_intensity_guarded"),
                    S.guarded_ratio("total_flux_kg", "total_iron_kg", 1.0).alias("flux_iron_guarded"))


DEF_COLS = ["hbt", "oxygen_flow", "etaco"]


@query("default_inputs", W("select t.clock, " + ", ".join(
    f"coalesce(p.{c}, m.{c}) as {c}" for c in DEF_COLS)
    + " from tap_h t left join para_h p using (clock), (select " + ", ".join(f"avg({c}) as {c}" for c in DEF_COLS)
    + " from para_h) m", P.TAP_H + ",\n" + P.PARA_H))
def q_default_inputs(spark, d):
    """I8: missing request inputs take the training mean."""
    para = FT.para_hourly(spark, d)
    means = para.agg(*[F.avg(c).alias(c) for c in DEF_COLS]).first()
    x = FT.tap_hourly(spark, d).select("clock").join(para.select("clock", *DEF_COLS), "clock", "left")
    return x.select("clock", *[F.coalesce(F.col(c), F.lit(means[c])).alias(c) for c in DEF_COLS])


FAMILY_COLS = ["hbt", "oxygen_flow", "coal_actual", "prod_rate", "etaco", "permeability", "heat_flow_flux"]


@query("feature_family", W("""select feature, case when starts_with(upper(feature), 'BRD_') then 'Burden' else 'Process' end as family, n from (
  select 'BRD_' || upper(trim(brandcode)) as feature, count(actwt) as n from fx_burden group by 1 union all """ + " union all ".join(
    f"select '{c}', count({c}) from fx_para" for c in FAMILY_COLS) + ")"))
def q_feature_family(spark, d):
    """Family tag by name prefix over the data-derived feature list, with the values each has."""
    b = fx.fx_burden(spark, d).groupBy(F.concat(F.lit("BRD_"), F.upper(F.trim("brandcode"))).alias("feature")).agg(F.count("actwt").alias("n"))
    p = fx.fx_para(spark, d).agg(*[F.count(c).alias(c) for c in FAMILY_COLS])
    p = p.selectExpr(f"stack({len(FAMILY_COLS)}, " + ", ".join(f"'{c}', `{c}`" for c in FAMILY_COLS) + ") as (feature, n)")
    return b.unionByName(p).select("feature", S.feature_family("feature").alias("family"), "n")


@query("guidance", W("""select taphole, d_si as delta_si, d_temp as delta_temp,
  case when d_si > 0 and d_temp > 0 then 'raises both silicon and temperature'
       when d_si < 0 and d_temp < 0 then 'lowers both silicon and temperature'
       when d_si > 0 and d_temp <= 0 then 'raises silicon, not temperature'
       when d_si <= 0 and d_temp > 0 then 'raises temperature, not silicon'
       when d_si < 0 then 'lowers silicon, not temperature' when d_temp < 0 then 'lowers temperature, not silicon'
       else 'little effect on either target' end as guidance
from (select taphole, arg_max(hm_si, clock) - arg_min(hm_si, clock) as d_si,
             arg_max(hm_temp, clock) - arg_min(hm_temp, clock) as d_temp from series group by taphole)""", P.SERIES))
def q_guidance(spark, d):
    """Text from the signs of the last−first deltas of both responses."""
    from .q_windows import series
    s = series(spark, d).groupBy("taphole").agg(
        (F.max_by("hm_si", "clock") - F.min_by("hm_si", "clock")).alias("delta_si"),
        (F.max_by("hm_temp", "clock") - F.min_by("hm_temp", "clock")).alias("delta_temp"))
    return s.withColumn("guidance", S.guidance("delta_si", "delta_temp"))


GRID_FEATS = ["hbt", "oxygen_flow", "coal_actual", "ore_coke_ratio"]


@query("linspace_grid", W("select feature, cast(i as integer) as point_no, (a + (b - a) * i / 24e0) as feature_value from ("
                          + " union all ".join(
                              f"select '{c}' as feature, quantile_cont({c}, 0.01) as a, "
                              f"case when quantile_cont({c}, 0.99) = quantile_cont({c}, 0.01) "
                              f"then quantile_cont({c}, 0.01) + 1 else quantile_cont({c}, 0.99) end as b from feat"
                              for c in GRID_FEATS) + "), range(25) t(i)", P.FEATURE_CTES))
def q_linspace_grid(spark, d):
    """25 equally spaced points p01..p99 per feature (constant range guarded)."""
    r = aggs.feature_ranges(FT.feature_table(spark, d), GRID_FEATS)
    r = r.withColumn("p99", F.when(F.col("p99") == F.col("p01"), F.col("p01") + 1).otherwise(F.col("p99")))
    g = r.select("feature", F.posexplode(S.linspace("p01", "p99", K.SENSITIVITY_POINTS)).alias("point_no", "feature_value"))
    return g


@query("forecast_time", W("""select clock, strftime(clock + interval 1 hour, '%Y-%m-%d %H:%M') as forecast_for
from tap_h""", P.TAP_H))
def q_forecast_time(spark, d):
    """Next-hour label for a forecast made at the base hour."""
    return FT.tap_hourly(spark, d).select("clock", S.forecast_time("clock", 1).alias("forecast_for"))


# ------------------------------------------------------------------ lookups


@query("lookup_fallback", W(f"""select k.material, coalesce(a.w, b.w, 0e0) as weight from
  (select distinct {P.material_case()} as material from fx_burden union select 'scrap_kg') k
  left join (select {P.material_case()} as material, sum(actwt) as w from fx_burden
             where chargetime < (select min(chargetime) from fx_burden) + interval 7 day group by 1) a using (material)
  left join (select {P.material_case()} as material, sum(actwt) as w from fx_burden group by 1) b using (material)"""))
def q_lookup_fallback(spark, d):
    """First-week weight, else whole-period weight, else 0."""
    b = fx.fx_burden(spark, d).withColumn("material", S.classify_material("brandcode"))
    keys = b.select("material").distinct().unionByName(
        spark.range(1).select(F.lit("scrap_kg").alias("material"))).distinct()
    first = b.agg(F.min("chargetime")).first()[0]
    t1 = b.where(F.col("chargetime") < F.lit(first) + F.expr("interval 7 days")) \
        .groupBy("material").agg(F.sum("actwt").alias("weight"))
    t2 = b.groupBy("material").agg(F.sum("actwt").alias("weight"))
    return joins.lookup_fallback(keys, "material", [t1, t2], "weight", default=0.0)


@query("map_overlay", W("""select t.clock, f.feature, coalesce(case f.feature when 'hbt' then p.hbt
  when 'oxygen_flow' then p.oxygen_flow else p.etaco end, case f.feature when 'hbt' then m.hbt
  when 'oxygen_flow' then m.oxygen_flow else m.etaco end) as value
from tap_h t left join para_h p using (clock),
  (select avg(hbt) as hbt, avg(oxygen_flow) as oxygen_flow, avg(etaco) as etaco from para_h) m,
  (values ('hbt'), ('oxygen_flow'), ('etaco')) f(feature)""", P.TAP_H + ",\n" + P.PARA_H))
def q_map_overlay(spark, d):
    """Request map (present readings) laid over the default map (means)."""
    para = FT.para_hourly(spark, d)
    means = para.agg(*[F.avg(c).alias(c) for c in DEF_COLS]).first()
    base = F.create_map(*[x for c in DEF_COLS for x in (F.lit(c), F.lit(means[c]))])
    x = FT.tap_hourly(spark, d).select("clock").join(para.select("clock", *DEF_COLS), "clock", "left")
    req = F.map_from_arrays(F.array(*[F.lit(c) for c in DEF_COLS]), F.array(*[F.col(c) for c in DEF_COLS]))
    m = x.select("clock", joins.map_overlay(base, req).alias("m"))
    return m.select("clock", F.explode("m").alias("feature", "value"))


@query("lookup_ci", W("""select t.tapno, t.target, s.spec_lo, s.spec_hi from
  (select tapno, 'HM_SI' as target from fx_tap union all select tapno, 'Hm_Temp' from fx_tap) t
  left join spec s on lower(t.target) = s.target""", SPEC_SQL))
def q_lookup_ci(spark, d):
    """Mixed-case target names resolved against lower-case keys."""
    t = fx.fx_tap(spark, d)
    x = t.select("tapno", F.lit("HM_SI").alias("target")).unionByName(
        t.select("tapno", F.lit("Hm_Temp").alias("target")))
    spec = F.broadcast(spec_table(spark).withColumnRenamed("target", "spec_target"))
    return joins.lookup_ci(x, "target", spec, "spec_target")


# ------------------------------------------------------------------ schema repair

MESSY = {"hbt": "  HBT ", "oxygen_flow": "Oxygen  Flow", "coal_actual": "Coal Inj. SP", "etaco": "ETACO"}


@query("norm_columns", W("""select unit_id as UNIT_ID, hbt as HBT, oxygen_flow as OXYGEN_FLOW,
  coal_actual as COAL_INJ_SP, etaco as ETACO from fx_para"""))
def q_norm_columns(spark, d):
    """B1: trim → upper → whitespace to '_' → drop other characters."""
    p = fx.fx_para(spark, d).select("unit_id", *[F.col(k).alias(v) for k, v in MESSY.items()])
    return ingest.norm_columns(p)


@query("dedupe_columns", W("select unit_id, hbt as hbt, etaco as etaco from fx_para"))
def q_dedupe_columns(spark, d):
    """Duplicate-named columns, the first one is kept."""
    p = fx.fx_para(spark, d).select("unit_id", "hbt", "etaco", (F.col("hbt") * 2).alias("x"))
    return ingest.dedupe_columns(p.toDF("unit_id", "hbt", "etaco", "hbt"))


ALIAS_RULES = [("oxygen", "o_flow_act"), ("coal", "coal_act"), ("perm", "perm_index")]


@query("alias_rename", W("""select unit_id, oxygen_flow as o_flow_act, coal_actual as coal_act,
  permeability as perm_index from fx_para"""))
def q_alias_rename(spark, d):
    """Substring alias rules, first match per column."""
    p = fx.fx_para(spark, d).select("unit_id", "oxygen_flow", "coal_actual", "permeability")
    return ingest.alias_rename(p, ALIAS_RULES)


def _events_text(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select(F.col("event_id").cast("string").alias("event_id"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                     F.col("event_type"), F.col("value").cast("string").alias("value"))


@query("detect_time_column", W("""select * from (values ('event_id', 0e0), ('event_type', 0e0), ('value', 0e0)) v(column_name, parse_rate)
union all select 'ts', avg(case when try_strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') is not null
  then 1e0 else 0e0 end) from events"""))
def q_detect_time_column(spark, d):
    """B2: parse rate of every text column; the clock is the first > 0.7."""
    return ingest.parse_rates(_events_text(spark, d))


@query("time_column_choice", W("""select case when avg(case when try_strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') is not null
  then 1e0 else 0e0 end) > 0.7 then 'ts' else 'event_id' end as time_column, count(*) as n_rows from events"""))
def q_time_column_choice(spark, d):
    """B2: the column taken as the clock."""
    t = _events_text(spark, d)
    return t.agg(F.lit(ingest.detect_time_column(t)).alias("time_column"), F.count(F.lit(1)).alias("n_rows"))


@query("drop_sparse_columns", W("""select tapno, hm_si as hm_si,
  case when tapno % 50 = 0 then hm_temp end as temp_2pct from fx_tap"""))
def q_drop_sparse_columns(spark, d):
    """A column below 1 % non-null share is dropped (0.5 %), 2 % survives."""
    t = fx.fx_tap(spark, d).select(
        "tapno", "hm_si",
        F.when(F.col("tapno") % 200 == 0, F.col("hm_si")).alias("si_half_pct"),
        F.when(F.col("tapno") % 50 == 0, F.col("hm_temp")).alias("temp_2pct"))
    return ingest.drop_sparse_columns(t, 0.01)


@query("select_features", W("select clock, " + P.named(["hbt", "oxygen_flow", "coal_actual", "prod_rate", "etaco",
                                                      "permeability", "heat_flow_flux", "ore_coke_ratio",
                                                      "thermal_idx", "coal_intensity", "gas_eff"])
                            + " from feat", P.FEATURE_CTES))
def q_select_features(spark, d):
    """Numeric columns minus targets, burden weights and ratios' inputs."""
    f = FT.feature_table(spark, d)
    exclude = ["hm_si", "hm_temp", "burden_thermal", "flux_thermal", "sinter_frac", "pellet_frac",
               "flux_iron_ratio", "total_iron_kg", "total_flux_kg", "total_charge_kg"] + P.GROUPS
    return f.select("clock", *ingest.select_features(f, exclude))
