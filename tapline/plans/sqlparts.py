"""DuckDB building blocks for the oracle SQL (independent of the Spark code).

Only the fixed rule tables (material substrings, keyword groups) are
shared with the Spark side, as data.
"""

from __future__ import annotations

from .. import constants as K

PARA = ["hbt", "oxygen_flow", "coal_actual", "prod_rate", "etaco", "permeability", "heat_flow_flux"]
GROUPS = [g for g, _ in K.MATERIAL_RULES] + [K.MATERIAL_DEFAULT]


def named(cols, prefix=""):
    return ", ".join(f"{prefix}{c} as {c}" for c in cols)


def material_case(col="brandcode", rules=None, default=K.MATERIAL_DEFAULT):
    rules = rules or K.MATERIAL_RULES
    parts = []
    for g, subs in rules:
        cond = " or ".join(f"contains(upper(trim({col})), '{s}')" for s in subs)
        parts.append(f"when {cond} then '{g}'")
    return "case " + " ".join(parts) + f" else '{default}' end"


def keyword_cols(groups=None, brand="brandcode", w="coalesce(actwt, 0e0)"):
    groups = groups or K.KEYWORD_GROUPS
    return ", ".join(
        f"case when regexp_matches(lower(trim({brand})), '{'|'.join(ws)}') then {w} else 0e0 end as {g}"
        for g, ws in groups)


TAP_H = """tap_h as (select date_trunc('hour', sampletaken) as clock, avg(hm_si) as hm_si, avg(hm_temp) as hm_temp
  from fx_tap where sampletaken is not null and hm_si is not null and hm_temp is not null group by 1)"""

PARA_H = ("para_h as (select * from (select date_trunc('hour', clock_raw) as clock, "
          + ", ".join(f"avg({c}) as {c}" for c in PARA)
          + " from fx_para where clock_raw is not null group by 1) where heat_flow_flux < 100)")

BURDEN_PIV = ("bpiv as (select date_trunc('hour', chargetime) as clock, "
              + ", ".join(f"coalesce(sum(actwt) filter (where m = '{g}'), 0e0) as {g}" for g in GROUPS)
              + f" from (select chargetime, actwt, {material_case()} as m from fx_burden"
              + " where chargetime is not null) group by 1)")

BURDEN_RAT = """brat as (select *, total_iron_kg / nullif(coke_kg, 0) as ore_coke_ratio,
    sinter_kg / nullif(total_iron_kg, 0) as sinter_frac, pellet_kg / nullif(total_iron_kg, 0) as pellet_frac,
    total_flux_kg / nullif(total_iron_kg, 0) as flux_iron_ratio, coke_kg + total_iron_kg + total_flux_kg as total_charge_kg
  from (select *, ore_kg + pellet_kg + sinter_kg + dri_kg + mixedmaterial_kg as total_iron_kg,
    limestone_kg + dolomite_kg as total_flux_kg from bpiv))"""

BURDEN_SHIFT = "bshift as (select * replace (clock + interval 8 hour as clock) from brat)"

MERGED = """merged as (select * from para_h join bshift using (clock) join tap_h using (clock))"""

FENCE = """fence as (select quantile_cont(hm_si, 0.25) as s1, quantile_cont(hm_si, 0.75) as s3,
   quantile_cont(hm_temp, 0.25) as t1, quantile_cont(hm_temp, 0.75) as t3 from merged)"""

FEAT = """feat as (select m.*, hbt * oxygen_flow / 1e6 as thermal_idx, coal_actual / nullif(prod_rate, 0) as coal_intensity,
    etaco * permeability as gas_eff, ore_coke_ratio * hbt as burden_thermal, flux_iron_ratio * hbt as flux_thermal
  from merged m, fence f
  where m.hm_si >= f.s1 - 3 * (f.s3 - f.s1) and m.hm_si <= f.s3 + 3 * (f.s3 - f.s1)
    and m.hm_temp >= f.t1 - 3 * (f.t3 - f.t1) and m.hm_temp <= f.t3 + 3 * (f.t3 - f.t1)
    and m.hm_si is not null and m.hm_temp is not null)"""

FEATURE_CTES = ",\n".join([TAP_H, PARA_H, BURDEN_PIV, BURDEN_RAT, BURDEN_SHIFT, MERGED, FENCE, FEAT])

SERIES = """series as (select taphole, date_trunc('hour', sampletaken) as clock, avg(hm_si) as hm_si,
   avg(hm_temp) as hm_temp from fx_tap where sampletaken is not null group by 1, 2)"""
