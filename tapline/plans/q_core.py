"""Registered queries: ingest, clock alignment, joins, fences, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import aggs, clean, ingest, joins
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures as W
from ..sources.tables import read_table
from . import feature_table as FT
from . import sqlparts as P
from .registry import query

FEAT_COLS = ["hbt", "oxygen_flow", "coal_actual", "prod_rate", "etaco", "permeability", "heat_flow_flux",
             "coke_kg", "sinter_kg", "pellet_kg", "ore_kg", "limestone_kg", "dolomite_kg",
             "total_iron_kg", "ore_coke_ratio", "flux_iron_ratio", "thermal_idx", "coal_intensity",
             "gas_eff", "hm_si", "hm_temp"]

# ---------------------------------------------------------------- flagship


@query("class_distribution", W("""select target, class, n, (n * 100e0 / sum(n) over (partition by target)) as pct
from (select target, class, count(*) as n from (
   select 'hm_si' as target, case when hm_si is null then 'nan' when hm_si <= 0.25 then 'Low'
          when hm_si <= 0.80 then 'Normal' else 'High' end as class from feat
   union all
   select 'hm_temp', case when hm_temp is null then 'nan' when hm_temp <= 1480 then 'Low'
          when hm_temp <= 1535 then 'Normal' else 'High' end from feat) group by 1, 2)""", P.FEATURE_CTES))
def q_class_distribution(spark, d):
    """Hourly alignment → 8 h offset join → IQR fence → labels → class shares."""
    return FT.class_counts(FT.feature_table(spark, d))


ALL_FEAT = ["clock"] + P.PARA + P.GROUPS + ["total_iron_kg", "total_flux_kg", "ore_coke_ratio", "sinter_frac",
                                            "pellet_frac", "flux_iron_ratio", "total_charge_kg", "hm_si",
                                            "hm_temp", "thermal_idx", "coal_intensity", "gas_eff",
                                            "burden_thermal", "flux_thermal"]


@query("feature_table", W(f"select clock, {P.named(ALL_FEAT[1:])} from feat", P.FEATURE_CTES))
def q_feature_table(spark, d):
    return FT.feature_table(spark, d).select(*ALL_FEAT)


# ---------------------------------------------------------------- scans / coercion

@query("scan_tap", W("select * from fx_tap"))
def q_scan_tap(spark, d):
    return fx.fx_tap(spark, d)


@query("floor_hour", W("select tapno, date_trunc('hour', sampletaken) as clock from fx_tap"))
def q_floor_hour(spark, d):
    return fx.fx_tap(spark, d).select("tapno", S.floor_hour("sampletaken").alias("clock"))


def _tap_text(spark, d):
    t = fx.fx_tap(spark, d)
    bad = (F.col("tapno") % 100) == 0
    return t.select("tapno", "sampletaken", "hm_temp",
                    F.when(bad, "bad").otherwise(F.format_number("hm_temp", 3)).alias("hm_temp_txt"),
                    F.when(bad, "n/a").otherwise(F.col("hm_si").cast("string")).alias("hm_si_txt"),
                    F.when(bad, "bad").otherwise(F.date_format("sampletaken", "dd-MM-yyyy HH:mm:ss"))
                    .alias("ts_txt"))


@query("comma_numeric", W("""select tapno, case when tapno % 100 = 0 then null else hm_temp end as hm_temp
from fx_tap"""))
def q_comma_numeric(spark, d):
    """B9: '1,519.000' → 1519.0; 'bad' → NULL."""
    return _tap_text(spark, d).select("tapno", S.comma_numeric("hm_temp_txt").alias("hm_temp"))


@query("coerce_numeric", W("""select tapno, case when tapno % 100 = 0 then null else hm_si end as hm_si
from fx_tap"""))
def q_coerce_numeric(spark, d):
    return _tap_text(spark, d).select("tapno", S.coerce_numeric("hm_si_txt").alias("hm_si"))


@query("coerce_timestamp", W("""select tapno, case when tapno % 100 = 0 then null
  else date_trunc('second', sampletaken) end as sampletaken from fx_tap"""))
def q_coerce_timestamp(spark, d):
    """Day-first text back to a timestamp; unparseable → NULL."""
    return _tap_text(spark, d).select("tapno", S.coerce_timestamp("ts_txt", dayfirst=True).alias("sampletaken"))


@query("classify_material", W(f"""select unit_id, chargetime, brandcode, {P.material_case()} as material
from fx_burden"""))
def q_classify_material(spark, d):
    b = fx.fx_burden(spark, d)
    return b.select("unit_id", "chargetime", "brandcode", S.classify_material("brandcode").alias("material"))


@query("distinct_materials", W(f"""select count(distinct trim(brandcode)) as n_brands,
  count(distinct {P.material_case()}) as n_groups from fx_burden"""))
def q_distinct_materials(spark, d):
    b = fx.fx_burden(spark, d)
    return b.agg(F.count_distinct(F.trim("brandcode")).alias("n_brands"),
                 F.count_distinct(S.classify_material("brandcode")).alias("n_groups"))


# ---------------------------------------------------------------- hourly aggregates

@query("hourly_mean", W("select clock, " + P.named(P.PARA) + " from (select date_trunc('hour', clock_raw) as clock, "
                        + ", ".join(f"avg({c}) as {c}" for c in P.PARA) + " from fx_para group by 1)"))
def q_hourly_mean(spark, d):
    return aggs.hourly_mean(fx.fx_para(spark, d), "clock_raw", fx.PARA_COLS)


@query("sensor_fault_filter", W("select clock, " + P.named(P.PARA) + " from para_h", P.PARA_H))
def q_sensor_fault_filter(spark, d):
    return FT.para_hourly(spark, d)


@query("pivot_group_sum", W("select clock, " + P.named(P.GROUPS) + " from bpiv", P.BURDEN_PIV))
def q_pivot_group_sum(spark, d):
    return ingest.burden_groups_hourly(fx.fx_burden(spark, d))


@query("ensure_columns", W("select clock, " + P.named(P.GROUPS) + ", 0e0 as scrap_kg from bpiv", P.BURDEN_PIV))
def q_ensure_columns(spark, d):
    """Expected groups that never occur (scrap) appear as 0."""
    return ingest.ensure_columns(ingest.burden_groups_hourly(fx.fx_burden(spark, d)),
                                 [g for g, _ in K.MATERIAL_RULES_WITH_SCRAP] + [K.MATERIAL_DEFAULT])


RATIO_COLS = ["total_iron_kg", "total_flux_kg", "ore_coke_ratio", "sinter_frac", "pellet_frac",
              "flux_iron_ratio", "total_charge_kg"]


@query("burden_ratios", W("select clock, " + P.named(P.GROUPS + RATIO_COLS) + " from brat",
                          P.BURDEN_PIV + ",\n" + P.BURDEN_RAT))
def q_burden_ratios(spark, d):
    return FT.burden_hourly(spark, d, shift=False)


@query("shift_clock", W("select clock, " + P.named(P.GROUPS + RATIO_COLS) + " from bshift",
                        ",\n".join([P.BURDEN_PIV, P.BURDEN_RAT, P.BURDEN_SHIFT])))
def q_shift_clock(spark, d):
    return FT.burden_hourly(spark, d, shift=True)


BRANDS = sorted({b.strip() for b in fx.FIXTURE_BRANDS})


@query("pivot_brand_sum", W("select clock, " + ", ".join(
    f"(sum(actwt) filter (where trim(brandcode) = '{b}')) as brd_{b.lower()}" for b in BRANDS)
    + " from (select date_trunc('hour', chargetime) as clock, brandcode, actwt from fx_burden) group by 1"))
def q_pivot_brand_sum(spark, d):
    """Dynamic brand pivot, absent cell stays missing, BRD_ prefix."""
    b = fx.fx_burden(spark, d).select(S.floor_hour("chargetime").alias("clock"),
                                      F.trim("brandcode").alias("brand"), "actwt")
    vals = aggs.distinct_values(b, "brand")
    return aggs.pivot_sum(b, ["clock"], "brand", "actwt", vals, fill=None,
                          names=[f"brd_{v.lower()}" for v in vals])


KW = [g for g, _ in K.KEYWORD_GROUPS]


@query("keyword_weights", W("select clock, " + ", ".join(f"sum({g}) as {g}" for g in KW)
                            + f" from (select date_trunc('hour', chargetime) as clock, {P.keyword_cols()}"
                            " from fx_burden) group by 1"))
def q_keyword_weights(spark, d):
    """B13 + E2: non-exclusive keyword weights summed per hour."""
    return ingest.keyword_weights(fx.fx_burden(spark, d))


@query("hourly_sum", W("""select clock, (coalesce(sum(actwt), 0e0)) as actwt
from (select date_trunc('hour', chargetime) as clock, actwt from fx_burden) group by 1"""))
def q_hourly_sum(spark, d):
    """Charge weight per hour (an hour whose weights are all missing sums to 0)."""
    return aggs.hourly_sum(fx.fx_burden(spark, d), "chargetime", ["actwt"])


# ---------------------------------------------------------------- joins

@query("join3_inner", W("select clock, " + P.named(P.PARA + ["coke_kg", "ore_coke_ratio", "hm_si", "hm_temp"])
                        + " from merged", P.FEATURE_CTES))
def q_join3_inner(spark, d):
    return FT.merged_hourly(spark, d).select("clock", *P.PARA, "coke_kg", "ore_coke_ratio", "hm_si", "hm_temp")


@query("offset_join", W("""select t.clock, t.hm_si as hm_si, b.coke_kg as coke_kg_8h_before
from tap_h t join bpiv b on t.clock = b.clock + interval 8 hour""", P.TAP_H + ",\n" + P.BURDEN_PIV))
def q_offset_join(spark, d):
    """Charge at t meets tap at t + 8 h."""
    b = ingest.burden_groups_hourly(fx.fx_burden(spark, d)).select(
        "clock", F.col("coke_kg").alias("coke_kg_8h_before"))
    return joins.offset_join(FT.tap_hourly(spark, d).select("clock", "hm_si"), b, K.BURDEN_DESCENT_HOURS)


def _kw_shift_sql():
    return ("kw as (select clock + interval 8 hour as clock, " + ", ".join(f"sum({g}) as {g}" for g in KW)
            + f" from (select date_trunc('hour', chargetime) as clock, {P.keyword_cols()} from fx_burden)"
            " group by 1)")


LEFT_SQL = ",\n".join([P.TAP_H, P.PARA_H, _kw_shift_sql(), """lf as (select hp.*, """ + ", ".join(
    f"coalesce(kw.{g}, 0e0) as {g}" for g in KW) + """ from (select * from tap_h join para_h using (clock)) hp
  left join kw using (clock))"""])


def _left_fill(spark, d):
    hp = joins.join_inner([FT.tap_hourly(spark, d), FT.para_hourly(spark, d)], "clock")
    kw = ingest.shift_clock(ingest.keyword_weights(fx.fx_burden(spark, d)), K.BURDEN_DESCENT_HOURS)
    return joins.join_left_fill(hp, kw, "clock", 0.0)


@query("join_left_fill", W("select clock, " + P.named(["hm_si", "hm_temp"] + P.PARA + KW) + " from lf", LEFT_SQL))
def q_join_left_fill(spark, d):
    return _left_fill(spark, d)


@query("burden_ratios_alt", W("""select clock, (ore_kg / nullif(coke_kg, 0)) as ore_coke_ratio,
  (flux_kg / nullif(ore_kg + sinter_kg + pellet_kg, 0)) as flux_iron_ratio,
  (ore_kg / nullif(ore_kg + sinter_kg + pellet_kg, 0)) as ore_frac from lf""", LEFT_SQL))
def q_burden_ratios_alt(spark, d):
    return ingest.burden_ratios_alt(_left_fill(spark, d)).select(
        "clock", "ore_coke_ratio", "flux_iron_ratio", "ore_frac")


@query("join_suffix", W("""select t.clock, t.hm_si as hm_si, s.hm_si as hm_si_p,
  s.hm_temp as hm_temp_p from tap_h t join (select date_trunc('hour', sampletaken) as clock,
  avg(pred_si) as hm_si, avg(pred_temp) as hm_temp from fx_pred group by 1) s using (clock)""", P.TAP_H))
def q_join_suffix(spark, d):
    """Colliding right-side names get the ``_p`` suffix."""
    left = FT.tap_hourly(spark, d).select("clock", "hm_si")
    p = fx.fx_pred(spark, d).select("sampletaken", F.col("pred_si").alias("hm_si"), F.col("pred_temp").alias("hm_temp"))
    right = aggs.hourly_mean(p, "sampletaken", ["hm_si", "hm_temp"])
    right = joins.suffix_overlaps(left, right, ["clock"], "_p")
    right = right.withColumnsRenamed({"hm_temp": "hm_temp_p"})
    return left.join(right, "clock")


ASOF_SQL = """select t.tapno, t.unit_id, t.sampletaken, t.hm_si as hm_si, p.clock_raw, p.hbt as hbt
from fx_tap t asof left join fx_para p on t.unit_id = p.unit_id and t.sampletaken >= p.clock_raw"""


def _asof(spark, d, tol=None):
    t = fx.fx_tap(spark, d).select("tapno", "unit_id", "sampletaken", "hm_si")
    p = fx.fx_para(spark, d).select("unit_id", "clock_raw", "hbt")
    return joins.asof_join(t, p, "sampletaken", "clock_raw", by="unit_id", right_cols=["hbt"],
                           tolerance_hours=tol)


@query("asof_backward", W(ASOF_SQL))
def q_asof_backward(spark, d):
    """Every tap with the latest process reading of the same unit at or before it."""
    return _asof(spark, d)


@query("asof_tolerance", W(f"""select *, (date_diff('microsecond', clock_raw, sampletaken) / 3.6e9) as lag_hours
from ({ASOF_SQL}) where clock_raw is not null and date_diff('microsecond', clock_raw, sampletaken) / 3.6e9 <= 4"""))
def q_asof_tolerance(spark, d):
    """As-of within 4 h, unmatched dropped; lag in hours kept."""
    return _asof(spark, d, tol=K.ASOF_TOLERANCE_HOURS)


@query("asof_global", W("""select t.tapno, t.sampletaken, b.chargetime, b.brandcode, b.actwt as actwt
from fx_tap t asof left join fx_burden b on t.sampletaken >= b.chargetime"""))
def q_asof_global(spark, d):
    """D1 without a series key: one long series, bucketed by day with carry-forward."""
    t = fx.fx_tap(spark, d).select("tapno", "sampletaken")
    b = fx.fx_burden(spark, d).select("chargetime", "brandcode", "actwt")
    return joins.asof_join(t, b, "sampletaken", "chargetime", by=None, right_cols=["brandcode", "actwt"])


# ---------------------------------------------------------------- filters / fences

@query("iqr_simultaneous", W("select clock, " + P.named(["hm_si", "hm_temp", "hbt"]) + """ from merged m, fence f
  where m.hm_si >= f.s1 - 3 * (f.s3 - f.s1) and m.hm_si <= f.s3 + 3 * (f.s3 - f.s1)
    and m.hm_temp >= f.t1 - 3 * (f.t3 - f.t1) and m.hm_temp <= f.t3 + 3 * (f.t3 - f.t1)""", P.FEATURE_CTES))
def q_iqr_simultaneous(spark, d):
    m = FT.merged_hourly(spark, d)
    return clean.iqr_simultaneous(m, ["hm_si", "hm_temp"], k=3.0).select("clock", "hm_si", "hm_temp", "hbt")


def _seq_sql(src: str, cols, k: float, guard: bool) -> str:
    ctes, prev = [], src
    for i, c in enumerate(cols):
        ctes.append(f"q{i} as (select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from {prev})")
        between = f"coalesce(s.{c} >= q.a - {k} * (q.b - q.a) and s.{c} <= q.b + {k} * (q.b - q.a), false)"
        cond = f"(coalesce(q.b - q.a > 0, false) = false or {between})" if guard else between
        ctes.append(f"s{i} as (select s.* from {prev} s, q{i} q where {cond})")
        prev = f"s{i}"
    return ",\n".join(ctes), prev


_SEQ_CTES, _SEQ_LAST = _seq_sql("merged", ["hm_si", "hm_temp"], 3.0, False)


@query("iqr_sequential", W(f"select clock, {P.named(['hm_si', 'hm_temp'])} from {_SEQ_LAST}",
                           P.FEATURE_CTES + ",\n" + _SEQ_CTES))
def q_iqr_sequential(spark, d):
    """Second fence computed on the survivors of the first."""
    m = FT.merged_hourly(spark, d)
    return clean.iqr_sequential(m, ["hm_si", "hm_temp"], k=3.0).select("clock", "hm_si", "hm_temp")


_ALLNUM = ["hm_si", "hm_temp"] + P.PARA
_ALL_CTES, _ALL_LAST = _seq_sql("lf", _ALLNUM, 3.5, True)


@query("iqr_all_numeric", W(f"select clock, {P.named(_ALLNUM)} from {_ALL_LAST}", LEFT_SQL + ",\n" + _ALL_CTES))
def q_iqr_all_numeric(spark, d):
    """Every numeric column in order, k=3.5, burden weights exempt, iqr ≤ 0 skipped."""
    lf = _left_fill(spark, d)
    out = clean.iqr_sequential(lf, _ALLNUM + KW, k=3.5, skip_nonpositive_iqr=True, exempt=KW)
    return out.select("clock", *_ALLNUM)


@query("dropna_subset", W("""select t.clock, t.hm_si, p.hbt from tap_h t left join para_h p using (clock)
where hbt is not null""", P.TAP_H + ",\n" + P.PARA_H))
def q_dropna_subset(spark, d):
    """Tap hours whose process hour is absent are dropped."""
    t = FT.tap_hourly(spark, d).select("clock", "hm_si").join(FT.para_hourly(spark, d).select("clock", "hbt"), "clock", "left")
    return clean.dropna_subset(t, ["hbt"])


@query("dropna_any", W("select clock, " + P.named(["hm_si", "hm_temp", "hbt"]) + """ from (select t.clock, t.hm_si, t.hm_temp, p.hbt
  from tap_h t left join para_h p using (clock)) where hbt is not null""", P.TAP_H + ",\n" + P.PARA_H))
def q_dropna_any(spark, d):
    t = FT.tap_hourly(spark, d)
    p = FT.para_hourly(spark, d).select("clock", "hbt")
    return clean.dropna_any(t.join(p, "clock", "left"))


# ---------------------------------------------------------------- statistics

QPROBS = [0.25, 0.33, 0.5, 0.66, 0.75]


@query("exact_quantiles", W("select taphole, " + ", ".join(
    f"quantile_cont({c}, {p}) as {c}_q{aggs._pct(p)}" for c in ["hm_si", "hm_temp"] for p in QPROBS)
    + " from fx_tap group by taphole"))
def q_exact_quantiles(spark, d):
    """E5 on raw taps per taphole: distributed exact quantiles (no group in one task)."""
    t = fx.fx_tap(spark, d)
    a = aggs.exact_quantiles_distributed(t, "hm_si", QPROBS, by="taphole")
    b = aggs.exact_quantiles_distributed(t, "hm_temp", QPROBS, by="taphole")
    return a.join(b, "taphole")


RANGE_COLS = ["hbt", "oxygen_flow", "coal_actual", "ore_coke_ratio", "thermal_idx", "hm_si", "hm_temp"]


@query("feature_ranges", W("select * from (" + " union all ".join(
    f"select '{c}' as feature, quantile_cont({c}, 0.01) as p01, quantile_cont({c}, 0.99) as p99, "
    f"avg({c}) as mean, stddev_samp({c}) as std from feat" for c in RANGE_COLS) + ")",
    P.FEATURE_CTES))
def q_feature_ranges(spark, d):
    return aggs.feature_ranges(FT.feature_table(spark, d), RANGE_COLS)


@query("data_summary", W("""select count(*) as n_records, strftime(min(clock), '%Y-%m-%d') as date_start,
  strftime(max(clock), '%Y-%m-%d') as date_end, avg(hm_si) as hm_si_mean, avg(hm_temp) as hm_temp_mean
from feat""", P.FEATURE_CTES))
def q_data_summary(spark, d):
    return aggs.data_summary(FT.feature_table(spark, d), "clock", ["hm_si", "hm_temp"])


CORR_COLS = ["hbt", "oxygen_flow", "coal_actual", "prod_rate", "etaco", "ore_coke_ratio", "thermal_idx",
             "hm_si", "hm_temp"]


@query("correlation_matrix", W("select * from (" + " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as corr from feat"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i:]) + ")", P.FEATURE_CTES))
def q_correlation_matrix(spark, d):
    return aggs.correlation_pairs(FT.feature_table(spark, d), CORR_COLS)


@query("histogram", W("""select bin, n, (mn + (mx - mn) * bin / 40e0) as bin_lo,
  (mn + (mx - mn) * (bin + 1) / 40e0) as bin_hi,
  (n / (sum(n) over () * (mx - mn) / 40e0)) as density from (
  select least(cast(floor((hm_si - mn) / ((mx - mn) / 40e0)) as int), 39) as bin, mn, mx,
         count(*) as n from fx_tap, (select min(hm_si) as mn, max(hm_si) as mx from fx_tap)
  where hm_si is not null group by 1, 2, 3) x"""))
def q_histogram(spark, d):
    return aggs.histogram(fx.fx_tap(spark, d), "hm_si", bins=40)


@query("interval_coverage", W("""select taphole, (avg(case when coalesce(hm_si >= pred_si - 0.05
  and hm_si <= pred_si + 0.05, false) then 1e0 else 0e0 end)) as coverage, count(*) as n
from fx_pred group by taphole"""))
def q_interval_coverage(spark, d):
    p = fx.fx_pred(spark, d).withColumns({"lo": F.col("pred_si") - 0.05, "hi": F.col("pred_si") + 0.05})
    return aggs.interval_coverage(p, "hm_si", "lo", "hi", by="taphole")


# ---------------------------------------------------------------- bench-scale variant

P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
DAILY_SQL = """bd as (select date_trunc('day', l_shipdate) + interval 1 day as clock, """ + ", ".join(
    f"coalesce(sum(l_quantity) filter (where trim(p_type) = '{t}'), 0e0) as brd_{t.lower()}" for t in P_TYPES) + """,
    sum(l_quantity) as total_kg
  from lineitem join part on l_partkey = p_partkey where l_shipdate is not null group by 1),
dt as (select date_trunc('day', o_orderdate) as clock, avg(o_totalprice) as target, count(*) as n_orders
  from orders where o_orderdate is not null group by 1),
dj as (select * from dt join bd using (clock)),
df as (select quantile_cont(target, 0.25) as a, quantile_cont(target, 0.75) as b from dj)"""


@query("daily_offset_join", W("select clock, n_orders, " + P.named(["target"] + [f"brd_{t.lower()}" for t in P_TYPES]
                                                               + ["total_kg", "promo_frac"])
                              + """ from (select dj.*, brd_promo / nullif(total_kg, 0) as promo_frac from dj, df
    where target >= a - 3 * (b - a) and target <= b + 3 * (b - a))""", DAILY_SQL))
def q_daily_offset_join(spark, d):
    """Bench-scale clock alignment: daily charge pivot (lineitem ⋈ part) one day ahead of
    daily order totals, IQR-fenced on the target."""
    b = fx.fx_daily_burden(spark, d).where(F.col("chargetime").isNotNull()).select(
        S.floor_day("chargetime").alias("clock"), F.trim("brandcode").alias("brand"), "actwt")
    # the charges are scanned once: brands come from part, and a brand that never occurs is a column of zeros
    vals = aggs.distinct_values(read_table(spark, d, "part", ["p_type"]).select(F.trim("p_type").alias("brand")), "brand")
    names = [f"brd_{v.lower()}" for v in vals]
    piv = aggs.pivot_sum(b, ["clock"], "brand", "actwt", vals, fill=0.0, names=names)
    # every brand has a column, so the total is their sum (no second pass over the charges)
    piv = piv.withColumn("total_kg", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    piv = piv.withColumn("clock", S.shift_hours("clock", 24))
    t = fx.fx_daily_tap(spark, d).where(F.col("sampletaken").isNotNull()).groupBy(
        S.floor_day("sampletaken").alias("clock")).agg(F.avg("target").alias("target"),
                                                       F.count(F.lit(1)).alias("n_orders"))
    # one row per day; checkpointed, so the fence statistics do not scan the charges again
    j = clean.iqr_simultaneous(t.join(piv, "clock").checkpoint(), ["target"], k=3.0)
    promo = F.col("brd_promo") if "brd_promo" in names else F.lit(0.0)
    return j.withColumn("promo_frac", F.try_divide(promo, "total_kg")).select(
        "clock", "n_orders", "target", *names, "total_kg", "promo_frac")


INTER = ["thermal_idx", "coal_intensity", "gas_eff", "burden_thermal", "flux_thermal"]


@query("interaction_features", W(f"select clock, {P.named(INTER)} from feat", P.FEATURE_CTES))
def q_interaction_features(spark, d):
    """Thermal index, coal intensity (zero production → NULL), gas efficiency, burden/flux × HBT."""
    return FT.feature_table(spark, d).select("clock", *INTER)


@query("lag_hours", W("""select t.tapno, (date_diff('microsecond', p.clock_raw, t.sampletaken) / 3.6e9) as lag_hours
from fx_tap t asof left join fx_para p on t.unit_id = p.unit_id and t.sampletaken >= p.clock_raw"""))
def q_lag_hours(spark, d):
    """Age in hours of the matched process reading for every tap (NULL when none)."""
    t = fx.fx_tap(spark, d).select("tapno", "unit_id", "sampletaken")
    p = fx.fx_para(spark, d).select("unit_id", "clock_raw")
    return joins.asof_join(t, p, "sampletaken", "clock_raw", by="unit_id", right_cols=[], lag_col="lag_hours") \
        .select("tapno", "lag_hours")


@query("row_guard", W("select count(*) as n_rows from feat", P.FEATURE_CTES))
def q_row_guard(spark, d):
    """The modelling table must keep ≥ 100 rows after merge + clean, else the job stops."""
    f = clean.row_guard(FT.feature_table(spark, d), 100, "rows after merge and clean")
    return f.agg(F.count(F.lit(1)).alias("n_rows"))
