"""Schema repair and derived columns.

Schema-level operators only rewrite names/projections (no data pass);
``detect_time_column`` and ``drop_sparse_columns`` each need one
aggregate over all candidate columns at once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalars import classify_material, floor_hour, keyword_weight, safe_div, shift_hours
from .aggs import pivot_sum


def norm_name(name: str, strict: bool = True, upper: bool = True) -> str:
    """B1: trim → (upper) → whitespace runs to '_' → (drop non [A-Z0-9_])."""
    s = str(name).strip()
    if upper:
        s = s.upper()
    s = re.sub(r"\s+", "_", s)
    if strict:
        s = re.sub(r"[^A-Za-z0-9_]", "", s)
    return s


def norm_columns(df: DataFrame, strict: bool = True, upper: bool = True) -> DataFrame:
    """B1 on a DataFrame; metadata only."""
    return df.toDF(*[norm_name(c, strict, upper) for c in df.columns])


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep the first of duplicate-named columns (positional rename, then select)."""
    names = df.columns
    tmp = [f"__c{i}" for i in range(len(names))]
    seen, keep = set(), []
    for i, n in enumerate(names):
        if n.lower() not in seen:
            seen.add(n.lower())
            keep.append(F.col(tmp[i]).alias(n))
    return df.toDF(*tmp).select(*keep)


def alias_rename(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rename by substring rules, first matching rule per column."""
    mapping, used = {}, set(df.columns)
    for c in df.columns:
        for sub, target in rules:
            if sub.lower() in c.lower() and target not in used:
                mapping[c] = target
                used.add(target)
                break
    return df.withColumnsRenamed(mapping)


def detect_time_column(df: DataFrame, preferred: Sequence[str] = ("CLOCK", "CHARGETIME", "SAMPLETAKEN",
                                                                  "DATETIME", "TIMESTAMP", "DATE", "TIME"),
                       min_rate: float = 0.7) -> str:
    """B2: first preferred name present, else first column whose parse rate > min_rate.

    One aggregate scores every candidate column at once.
    """
    from ..functions.scalars import coerce_timestamp
    up = {c.upper(): c for c in df.columns}
    for p in preferred:
        if p.upper() in up:
            return up[p.upper()]
    rates = df.agg(*[F.avg(coerce_timestamp(F.col(f"`{c}`")).isNotNull().cast("double")).alias(f"r{i}")
                     for i, c in enumerate(df.columns)]).first()
    for i, c in enumerate(df.columns):
        if rates[f"r{i}"] is not None and rates[f"r{i}"] > min_rate:
            return c
    return df.columns[0]


def parse_rates(df: DataFrame) -> DataFrame:
    """Parse rate of every column as a long table (column_name, parse_rate)."""
    from ..functions.scalars import coerce_timestamp
    wide = df.agg(*[F.avg(coerce_timestamp(F.col(f"`{c}`")).isNotNull().cast("double")).alias(f"r{i}")
                    for i, c in enumerate(df.columns)])
    stack = ", ".join(f"'{c}', r{i}" for i, c in enumerate(df.columns))
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, parse_rate)")


def non_null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols else df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}")
                                                   for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return wide.selectExpr("__n as n_rows", f"stack({len(cols)}, {stack}) as (column_name, n_non_null)")


def drop_sparse_columns(df: DataFrame, min_share: float = 0.01, keep: Sequence[str] = ()) -> DataFrame:
    """Keep a column only if its non-null count ≥ int(min_share·n) (and > 0)."""
    shares = non_null_shares(df).collect()  # one row per column: schema-sized
    n = shares[0]["n_rows"] if shares else 0
    need = max(1, int(min_share * n))
    survivors = [r["column_name"] for r in shares if r["n_non_null"] >= need or r["column_name"] in keep]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in survivors])


def select_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns not in the exclusion list, in column order."""
    ex = {e.lower() for e in exclude}
    num = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() in num and f.name.lower() not in ex]


def ensure_columns(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    """Add missing expected columns with a constant."""
    return df.withColumns({c: F.lit(float(default)) for c in cols if c not in df.columns})


def shift_clock(df: DataFrame, hours: int = K.BURDEN_DESCENT_HOURS, clock: str = "clock") -> DataFrame:
    """Descent delay: a charge at t is felt at t + hours."""
    return df.withColumn(clock, shift_hours(clock, hours))


# --- burden -------------------------------------------------------------------

def burden_groups_hourly(burden: DataFrame, ts: str = "chargetime", brand: str = "brandcode",
                         weight: str = "actwt", rules=None, by=None) -> DataFrame:
    """B12 + E4 + B14: material group per charge, hourly sum per group (absent → 0)."""
    rules = rules or K.MATERIAL_RULES
    groups = [g for g, _ in rules] + [K.MATERIAL_DEFAULT]
    keys = ([by] if isinstance(by, str) else list(by or [])) + ["clock"]
    b = (burden.where(F.col(ts).isNotNull())
               .select(*(keys[:-1]), floor_hour(ts).alias("clock"),
                       classify_material(brand, rules).alias("material"), F.col(weight)))
    return pivot_sum(b, keys, "material", weight, groups, fill=0.0)


def burden_ratios(df: DataFrame) -> DataFrame:
    """Totals and ratios; zero denominators → NULL."""
    iron = (F.col("ore_kg") + F.col("pellet_kg") + F.col("sinter_kg") + F.col("dri_kg")
            + F.col("mixedmaterial_kg"))
    df = df.withColumns({"total_iron_kg": iron,
                         "total_flux_kg": F.col("limestone_kg") + F.col("dolomite_kg")})
    return df.withColumns({
        "ore_coke_ratio": safe_div("total_iron_kg", "coke_kg"),
        "sinter_frac": safe_div("sinter_kg", "total_iron_kg"),
        "pellet_frac": safe_div("pellet_kg", "total_iron_kg"),
        "flux_iron_ratio": safe_div("total_flux_kg", "total_iron_kg"),
        "total_charge_kg": F.col("coke_kg") + F.col("total_iron_kg") + F.col("total_flux_kg"),
    })


def keyword_weights(burden: DataFrame, groups=None, ts: str = "chargetime", brand: str = "brandcode",
                    weight: str = "actwt", by=None) -> DataFrame:
    """B13 + E2: one weight column per keyword group (non-exclusive), hourly sums."""
    groups = groups or K.KEYWORD_GROUPS
    keys = [by] if isinstance(by, str) else list(by or [])
    w = F.coalesce(F.col(weight), F.lit(0.0))  # weights coerced, missing → 0
    x = burden.where(F.col(ts).isNotNull()).select(
        *keys, floor_hour(ts).alias("clock"),
        *[keyword_weight(brand, w, words).alias(g) for g, words in groups])
    return x.groupBy(*keys, "clock").agg(*[F.sum(g).alias(g) for g, _ in groups])


def burden_ratios_alt(df: DataFrame) -> DataFrame:
    """ore/coke, flux/iron, ore/iron with iron = ore + sinter + pellet.

    Missing group columns default to coke=1, others 0, as in the source.
    """
    coke = F.col("coke_kg") if "coke_kg" in df.columns else F.lit(1.0)
    z = lambda c: F.col(c) if c in df.columns else F.lit(0.0)
    iron = z("ore_kg") + z("sinter_kg") + z("pellet_kg")
    iron = F.when(iron == 0, F.lit(None)).otherwise(iron)
    return df.withColumns({
        "ore_coke_ratio": safe_div(z("ore_kg"), coke),
        "flux_iron_ratio": F.try_divide(z("flux_kg"), iron),
        "ore_frac": F.try_divide(z("ore_kg"), iron),
    })


def interaction_features(df: DataFrame, thermal_scale: float = 1e6, extended: bool = False) -> DataFrame:
    """Process interactions; a feature whose inputs are absent is constant 0.

    ``extended`` adds the six-target variant's dp_ratio and pellet_thermal.
    """
    have = set(df.columns)

    def has(*cs):
        return all(c in have for c in cs)

    out = {
        "thermal_idx": (F.col("hbt") * F.col("oxygen_flow") / F.lit(thermal_scale))
        if has("hbt", "oxygen_flow") else F.lit(0.0),
        "coal_intensity": safe_div("coal_actual", "prod_rate") if has("coal_actual", "prod_rate") else F.lit(0.0),
        "gas_eff": (F.col("etaco") * F.col("permeability")) if has("etaco", "permeability") else F.lit(0.0),
        "burden_thermal": (F.col("ore_coke_ratio") * F.col("hbt")) if has("ore_coke_ratio", "hbt") else F.lit(0.0),
        "flux_thermal": (F.col("flux_iron_ratio") * F.col("hbt")) if has("flux_iron_ratio", "hbt") else F.lit(0.0),
    }
    if extended and has("top_dp", "bottom_dp"):
        out["dp_ratio"] = safe_div("top_dp", "bottom_dp")
    if extended and has("pellet_frac", "hbt"):
        out["pellet_thermal"] = F.col("pellet_frac") * F.col("hbt")
    return df.withColumns(out)
