"""Process-data views over the driver tables.

The source application reads three plant tables (tap analyses, hourly
process parameters, burden charge log).  Here they are *derived* from the
driver's ``events`` table so every operator runs on data that grows with
the input; the same views exist as DuckDB CTEs (``FIXTURE_SQL``) so each
query can be checked against an independent engine.

All views are lazy projections/filters over one parquet scan: the
``event_type`` predicate is pushed to the scan and only the used columns
are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table  # noqa: F401  (re-exported for plans)

EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _k():
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def _events(spark: SparkSession, sf_dir: str, types) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", EV_COLS)
    return ev.where(F.col("event_type").isin(*types))


def fx_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tap analyses: one row per sample (HM shape)."""
    return tap_from_events(_events(spark, sf_dir, ["purchase"]))


def tap_exprs(k=None) -> dict:
    """Tap columns as expressions over event columns (shared by batch, stream and one-pass plans).

    ``k`` may be a pre-projected column holding the parsed props field.
    """
    k = _k() if k is None else k
    return {
        "tapno": F.col("event_id"),
        "unit_id": F.col("user_id"),
        "taphole": F.col("user_id") % 4,
        "sampletaken": F.col("ts"),
        "hm_si": F.col("value") / F.lit(100.0),
        "hm_temp": F.lit(1450.0) + k,
        "hm_s": (k % 70) / F.lit(1000.0),
        "hm_p": (F.col("user_id") % 25) / F.lit(100.0),
    }


def tap_from_events(ev: DataFrame) -> DataFrame:
    """Tap projection of (already filtered) event rows; batch or stream."""
    return ev.select(*[c.alias(n) for n, c in tap_exprs().items()])


PARA_COLS = ["hbt", "oxygen_flow", "coal_actual", "prod_rate", "etaco", "permeability",
             "heat_flow_flux"]


def fx_para(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process parameters sampled within the hour (PARA shape)."""
    return para_from_events(_events(spark, sf_dir, ["click", "view", "signup"]))


def para_exprs(k=None) -> dict:
    k = _k() if k is None else k
    return {
        "unit_id": F.col("user_id"),
        "clock_raw": F.col("ts"),
        "hbt": F.lit(1100.0) + k,
        "oxygen_flow": F.lit(8000.0) + F.col("value") * 5,
        "coal_actual": F.lit(100.0) + F.col("user_id") % 100,
        "prod_rate": (F.col("user_id") % 50).cast("double"),
        "etaco": F.lit(0.4) + k / F.lit(1000.0),
        "permeability": F.lit(1.0) + (F.col("event_id") % 97) / F.lit(100.0),
        "heat_flow_flux": F.col("value"),
    }


def para_from_events(ev: DataFrame) -> DataFrame:
    return ev.select(*[c.alias(n) for n, c in para_exprs().items()])


# FIXED VALUES: brand codes assigned to fixture charges by user_id % 10.
FIXTURE_BRANDS = [" Coke3Fresh ", "NutCoke", "SmallSinter", "PelletPP2Fresh", "IronOre",
                  "BHQ", "Limestone", "Dolomite", "MIXEDMATERIAL", "Quartzite"]


def fx_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burden charge log (long shape)."""
    return burden_from_events(_events(spark, sf_dir, ["error", "signup"]))


def burden_exprs() -> dict:
    brands = F.array(*[F.lit(b) for b in FIXTURE_BRANDS])
    return {
        "unit_id": F.col("user_id"),
        "chargetime": F.col("ts"),
        "brandcode": F.get(brands, (F.col("user_id") % 10).cast("int")),
        "actwt": F.col("value") * F.lit(100.0),
    }


def burden_from_events(ev: DataFrame) -> DataFrame:
    return ev.select(*[c.alias(n) for n, c in burden_exprs().items()])


def fx_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps with deterministic pseudo-predictions (for metric operators)."""
    t = fx_tap(spark, sf_dir)
    noise = ((F.col("tapno") * 7919) % 101 - 50) / F.lit(500.0)
    return t.select(
        "tapno", "taphole", "sampletaken", "hm_si", "hm_temp",
        (F.col("hm_si") + noise).alias("pred_si"),
        (F.col("hm_temp") + noise * 40).alias("pred_temp"),
    )


def fx_daily_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench-scale charge log: lineitem joined to part (brand = p_type)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity", "l_shipdate"])
    pt = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    return li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.col("l_shipdate").alias("chargetime"), F.col("p_type").alias("brandcode"),
        F.col("l_quantity").alias("actwt"))


def fx_daily_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderdate", "o_totalprice"])
    return o.select(F.col("o_orderdate").alias("sampletaken"),
                    F.col("o_totalprice").alias("target"))


# --- DuckDB twins ----------------------------------------------------------

_K_SQL = "cast(json_extract_string(props, '$.k') as int)"

FIXTURE_SQL: dict[str, str] = {
    "fx_tap": f"""select event_id as tapno, user_id as unit_id, user_id % 4 as taphole,
        ts as sampletaken, value / 100e0 as hm_si, 1450e0 + {_K_SQL} as hm_temp,
        ({_K_SQL} % 70) / 1000e0 as hm_s, (user_id % 25) / 100e0 as hm_p
      from events where event_type = 'purchase'""",
    "fx_para": f"""select user_id as unit_id, ts as clock_raw, 1100e0 + {_K_SQL} as hbt,
        8000e0 + value * 5 as oxygen_flow, 100e0 + user_id % 100 as coal_actual,
        cast(user_id % 50 as double) as prod_rate, 4e-1 + {_K_SQL} / 1000e0 as etaco,
        1e0 + (event_id % 97) / 100e0 as permeability, value as heat_flow_flux
      from events where event_type in ('click', 'view', 'signup')""",
    "fx_burden": """select user_id as unit_id, ts as chargetime,
        case user_id % 10 when 0 then ' Coke3Fresh ' when 1 then 'NutCoke'
          when 2 then 'SmallSinter' when 3 then 'PelletPP2Fresh' when 4 then 'IronOre'
          when 5 then 'BHQ' when 6 then 'Limestone' when 7 then 'Dolomite'
          when 8 then 'MIXEDMATERIAL' else 'Quartzite' end as brandcode,
        value * 100e0 as actwt
      from events where event_type in ('error', 'signup')""",
    "fx_pred": """select tapno, taphole, sampletaken, hm_si, hm_temp,
        hm_si + ((tapno * 7919) % 101 - 50) / 500e0 as pred_si,
        hm_temp + (((tapno * 7919) % 101 - 50) / 500e0) * 40 as pred_temp
      from fx_tap""",
}


def with_fixtures(body: str, ctes: str = "") -> str:
    """Prefix DuckDB SQL with the fixture CTEs (plus optional extra CTEs)."""
    parts = [f"{n} as ({q})" for n, q in FIXTURE_SQL.items()]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    return "with " + ",\n".join(parts) + "\n" + body


TAP_TYPES = ["purchase"]
PARA_TYPES = ["click", "view", "signup"]
BURDEN_TYPES = ["error", "signup"]


#: Bytes of input files that one micro-batch may hold (at least one file).
MAX_BATCH_BYTES = 1 << 30


def events_stream(spark: SparkSession, sf_dir: str, types=None, max_files: int | None = None) -> DataFrame:
    """The events table as a file stream (parquet files matching ``events*.parquet``)."""
    import os
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    # a first run over a long history is taken in batches of bounded size
    r = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(MAX_BATCH_BYTES))
    if max_files:
        r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    ev = r.parquet(os.path.join(sf_dir, "events*.parquet")).select(*EV_COLS)
    return ev.where(F.col("event_type").isin(*types)) if types else ev
