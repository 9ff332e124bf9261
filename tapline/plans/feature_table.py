"""The clock-aligned feature table (the data path every model starts from).

    tap ─ hourly mean ──────────────────────────────┐
    para ─ hourly mean ─ fault filter ───────────────┼─ inner join on clock ─ IQR fence ─ interactions
    burden ─ material pivot ─ ratios ─ +8 h shift ───┘

Each source is reduced to one row per hour by a partial+final hash
aggregate before any join, so the joins and the fence see a table whose
size is bounded by the clock, not by the raw reading volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalars import cut_right_closed
from ..operators import aggs, clean, ingest, joins
from ..sources import fixtures as fx

TARGETS = ["hm_si", "hm_temp"]


def tap_hourly(spark: SparkSession, sf_dir: str, cols=("hm_si", "hm_temp")) -> DataFrame:
    t = clean.dropna_subset(fx.fx_tap(spark, sf_dir), ["sampletaken", "hm_si", "hm_temp"])
    return aggs.hourly_mean(t, "sampletaken", list(cols))


def para_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = aggs.hourly_mean(fx.fx_para(spark, sf_dir), "clock_raw", fx.PARA_COLS)
    return clean.sensor_fault_filter(p, "heat_flow_flux", 100.0)


def burden_hourly(spark: SparkSession, sf_dir: str, shift: bool = True) -> DataFrame:
    b = ingest.burden_ratios(ingest.burden_groups_hourly(fx.fx_burden(spark, sf_dir)))
    return ingest.shift_clock(b, K.BURDEN_DESCENT_HOURS) if shift else b


def merged_hourly_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3/D6 written as joins: process ⋈ burden(t-8h) ⋈ tap on the hourly clock."""
    return joins.join_inner([para_hourly(spark, sf_dir), burden_hourly(spark, sf_dir),
                             tap_hourly(spark, sf_dir)], "clock")


def merged_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3/D6 in one pass: every reading is stamped with the hour it is *aligned* to
    (charges +8 h), all three sources are aggregated by that hour in a single
    hash aggregate, and the inner join becomes "all three present in the hour".

    Same result as ``merged_hourly_joined`` with one scan of the events and one
    shuffle (after map-side partial aggregation) instead of three scans, three
    aggregations and two join shuffles.
    """
    from ..functions.scalars import classify_material, floor_hour, shift_hours
    ev = fx.read_table(spark, sf_dir, "events", fx.EV_COLS).where(
        F.col("event_type").isin(*(fx.TAP_TYPES + fx.PARA_TYPES + fx.BURDEN_TYPES)))
    is_tap, is_para, is_bur = (F.col("event_type").isin(*t) for t in (fx.TAP_TYPES, fx.PARA_TYPES, fx.BURDEN_TYPES))
    # parse the props field and normalise the brand once per row (CASE branches and
    # repeated uses would otherwise evaluate them again)
    ev = ev.select("*", fx._k().alias("__k"),
                   F.upper(F.trim(fx.burden_exprs()["brandcode"])).alias("__brand"))
    tap, para, bur = fx.tap_exprs(F.col("__k")), fx.para_exprs(F.col("__k")), fx.burden_exprs()
    groups = [g for g, _ in K.MATERIAL_RULES] + [K.MATERIAL_DEFAULT]
    # one row per (event, role); a 'signup' event is both a process reading and a charge
    parts = ev.select(
        tap["sampletaken"].alias("t_ts"), tap["hm_si"].alias("t_si"), tap["hm_temp"].alias("t_temp"),
        *[para[c].alias(f"p_{c}") for c in fx.PARA_COLS], para["clock_raw"].alias("p_ts"),
        bur["chargetime"].alias("b_ts"), classify_material(F.col("__brand")).alias("b_mat"), bur["actwt"].alias("b_w"),
        is_tap.alias("is_tap"), is_para.alias("is_para"), is_bur.alias("is_bur"))
    roles = F.array(
        F.when(F.col("is_tap") & F.col("t_ts").isNotNull() & F.col("t_si").isNotNull() & F.col("t_temp").isNotNull(),
               F.struct(floor_hour("t_ts").alias("clock"), F.lit(0).alias("role"))),
        F.when(F.col("is_para") & F.col("p_ts").isNotNull(),
               F.struct(floor_hour("p_ts").alias("clock"), F.lit(1).alias("role"))),
        F.when(F.col("is_bur") & F.col("b_ts").isNotNull(),
               F.struct(shift_hours(floor_hour("b_ts"), K.BURDEN_DESCENT_HOURS).alias("clock"), F.lit(2).alias("role"))))
    x = parts.select("*", F.explode(roles).alias("r")).where(F.col("r").isNotNull()) \
        .select("*", F.col("r.clock").alias("clock"), F.col("r.role").alias("role")).drop("r")
    role = F.col("role")
    aggs_ = [F.sum((role == 0).cast("long")).alias("__n_tap"), F.sum((role == 1).cast("long")).alias("__n_para"),
             F.sum((role == 2).cast("long")).alias("__n_bur"),
             F.avg(F.when(role == 0, F.col("t_si"))).alias("hm_si"),
             F.avg(F.when(role == 0, F.col("t_temp"))).alias("hm_temp")]
    aggs_ += [F.avg(F.when(role == 1, F.col(f"p_{c}"))).alias(c) for c in fx.PARA_COLS]
    aggs_ += [F.coalesce(F.sum(F.when((role == 2) & (F.col("b_mat") == g), F.col("b_w"))), F.lit(0.0)).alias(g)
              for g in groups]
    h = x.groupBy("clock").agg(*aggs_)
    h = h.where((F.col("__n_tap") > 0) & (F.col("__n_para") > 0) & (F.col("__n_bur") > 0)).drop(
        "__n_tap", "__n_para", "__n_bur")
    h = clean.sensor_fault_filter(h, "heat_flow_flux", 100.0)
    return ingest.burden_ratios(h)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the merged table is hour-bounded: keep it so the fence statistics and the
    # filtered output do not both re-read the raw readings
    from pyspark import StorageLevel
    m = merged_hourly(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    m = clean.iqr_simultaneous(m, TARGETS, k=K.IQR_K)
    m = clean.dropna_subset(m, TARGETS)
    return ingest.interaction_features(m)


def labelled(df: DataFrame) -> DataFrame:
    """Right-closed class labels for both targets."""
    return df.withColumns({
        "si_class": cut_right_closed("hm_si", K.SI_EDGES, K.SI_LABELS),
        "temp_class": cut_right_closed("hm_temp", K.TEMP_EDGES, K.TEMP_LABELS),
    })


def class_counts(df: DataFrame) -> DataFrame:
    """E8 over both label columns: (target, class, n, pct)."""
    lab = labelled(df)
    long = lab.select(F.explode(F.array(
        F.struct(F.lit("hm_si").alias("target"), F.col("si_class").alias("class")),
        F.struct(F.lit("hm_temp").alias("target"), F.col("temp_class").alias("class")))).alias("x")
    ).select("x.target", "x.class")
    return aggs.class_distribution(long, "class", by="target")
