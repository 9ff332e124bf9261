"""Registered queries: readers and writers round-tripped through the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import aggs, metrics
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import readers as R
from ..sources import sinks as SK
from ..sources.fixtures import with_fixtures as W
from . import feature_table as FT
from . import sqlparts as P
from .registry import query

HDR_COLS = ["clock_raw", "hbt", "oxygen_flow", "coal_actual", "prod_rate", "heat_flow_flux"]


HDR_NAMES = ["CLOCK", "HBT", "Oxygen Flow", "Coal Actual", "PROD_RATE", "Heat Flow Flux"]


@query("scan_multirow_header", W("""select clock_raw as CLOCK, hbt as HBT, oxygen_flow as "Oxygen Flow",
  coal_actual as "Coal Actual", prod_rate as PROD_RATE, heat_flow_flux as "Heat Flow Flux"
from fx_para"""))
def q_scan_multirow_header(spark, d):
    """A1: headerless read of a multi-file export whose names line heads every file;
    names from the first file, data rows kept by a successful timestamp parse."""
    p = fx.fx_para(spark, d).select(*[F.col(c).alias(n) for c, n in zip(HDR_COLS, HDR_NAMES)])
    path = SK.write_csv(p, scratch_path(spark, "para_export"))
    return R.read_multirow_header(spark, path, names_row=0)


@query("scan_single_header", W("select unit_id, hbt as hbt from fx_para"))
def q_scan_single_header(spark, d):
    """A2: among several exports, the one whose name says PARA/DATA/BF is read."""
    p = fx.fx_para(spark, d)
    other = SK.write_csv(fx.fx_tap(spark, d).select("tapno", "hm_si"), scratch_path(spark, "misc_log"))
    para = SK.write_csv(p.select("unit_id", "hbt"), scratch_path(spark, "bf_para"))
    df = R.read_single_header(spark, [other, para])
    return df.select(F.col("unit_id").cast("long").alias("unit_id"), S.coerce_numeric("hbt").alias("hbt"))


@query("scan_burden_csv", W("""select unit_id as UNIT_ID, chargetime as CHARGETIME, trim(brandcode) as BRANDCODE,
  actwt as ACTWT from fx_burden"""))
def q_scan_burden_csv(spark, d):
    """A4: padded header names and padded values, trimmed and normalised on read."""
    b = fx.fx_burden(spark, d)
    padded = b.select(F.col("unit_id").alias(" unit_id"), F.col("chargetime").alias(" CHARGETIME "),
                      F.col("brandcode").alias("BRANDCODE  "), F.col("actwt").alias(" ACTWT"))
    path = SK.write_table(padded, scratch_path(spark, "burden_csv"), "csv", header="true",
                          timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", ignoreLeadingWhiteSpace="false",
                          ignoreTrailingWhiteSpace="false")
    r = R.read_burden_csv(spark, path)
    return r.select(F.col("UNIT_ID").cast("long").alias("UNIT_ID"),
                    S.coerce_timestamp("CHARGETIME").alias("CHARGETIME"), "BRANDCODE",
                    S.coerce_numeric("ACTWT").alias("ACTWT"))


MCOLS = ["hbt", "oxygen_flow", "coal_actual", "hm_si", "hm_temp"]


@query("scan_matrix_unpivot", W("select * from (" + " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as value from feat"
    for a in MCOLS for b in MCOLS) + ")", P.FEATURE_CTES))
def q_scan_matrix_unpivot(spark, d):
    """Labelled correlation matrix written as CSV, read back as long pairs."""
    f = FT.feature_table(spark, d)
    wide = f.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a in MCOLS for b in MCOLS]).first()
    rows = [(a, *[wide[f"{a}__{b}"] for b in MCOLS]) for a in MCOLS]  # 5×5 scalars
    m = spark.createDataFrame(rows, "name string, " + ", ".join(f"{b} double" for b in MCOLS))
    path = SK.write_csv(m, scratch_path(spark, "corr_matrix"))
    return R.read_matrix_long(spark, path)


@query("sink_model_summary", W("""select taphole, 'noisy' as model, count(*) as n,
  (1 - sum((hm_si - pred_si) ^ 2) / (var_pop(hm_si) * count(*))) as r2,
  (avg(abs(hm_si - pred_si))) as mae, (sqrt(sum((hm_si - pred_si) ^ 2) / count(*))) as rmse
from fx_pred where hm_si is not null and pred_si is not null group by taphole"""))
def q_sink_model_summary(spark, d):
    """Model × group metric summary written as CSV and read back."""
    m = metrics.regression_metrics(fx.fx_pred(spark, d), "hm_si", "pred_si", by="taphole") \
        .withColumn("model", F.lit("noisy"))
    path = SK.write_csv(m, scratch_path(spark, "model_summary"))
    r = spark.read.option("header", True).schema(m.schema).csv(path)
    return r.select("taphole", "model", "n", "r2", "mae", "rmse")


@query("sink_labels", W("""select sampletaken, hm_si as hm_si, case when hm_si is null then 'nan'
  when hm_si <= 0.25 then 'Low' when hm_si <= 0.8 then 'Normal' else 'High' end as si_class,
  hm_temp as hm_temp, case when hm_temp is null then 'nan' when hm_temp <= 1480 then 'Low'
  when hm_temp <= 1535 then 'Normal' else 'High' end as temp_class from fx_tap"""))
def q_sink_labels(spark, d):
    """Timestamp, targets and class labels written as parquet and read back."""
    t = fx.fx_tap(spark, d).select("sampletaken", "hm_si", "hm_temp")
    t = t.withColumns({"si_class": S.cut_right_closed("hm_si", K.SI_EDGES, K.SI_LABELS),
                       "temp_class": S.cut_right_closed("hm_temp", K.TEMP_EDGES, K.TEMP_LABELS)})
    return spark.read.parquet(SK.write_table(t, scratch_path(spark, "labels")))


@query("sink_predictions", W("""select tapno, target, actual, predicted, shrunk, predicted - 2 * s as pi_lo, predicted + 2 * s as pi_hi,
  coalesce(actual between predicted - 2 * s and predicted + 2 * s, false) as in_pi, coalesce(predicted between lo and hi, false) as in_spec from (
  select tapno, 'hm_si' as target, hm_si as actual, pred_si as predicted, 0.5 * pred_si + 0.5 * (select avg(hm_si) from fx_pred) as shrunk,
    (select sqrt(avg((hm_si - pred_si) * (hm_si - pred_si))) from fx_pred) as s, 0.25e0 as lo, 0.8e0 as hi from fx_pred
  union all select tapno, 'hm_temp', hm_temp, pred_temp, 0.5 * pred_temp + 0.5 * (select avg(hm_temp) from fx_pred),
    (select sqrt(avg((hm_temp - pred_temp) * (hm_temp - pred_temp))) from fx_pred), 1470e0, 1540e0 from fx_pred)"""))
def q_sink_predictions(spark, d):
    """A10: per target the actual, a column per model, interval bounds and the spec flag of the *prediction*, partitioned by target on write."""
    p = fx.fx_pred(spark, d)
    pairs = {"hm_si": "pred_si", "hm_temp": "pred_temp"}
    st = p.agg(*[F.avg(y).alias(y) for y in pairs], *[F.sqrt(F.avg((F.col(y) - F.col(q)) * (F.col(y) - F.col(q)))).alias(q) for y, q in pairs.items()]).first()
    rows = F.explode(F.array(*[F.struct(F.lit(y).alias("target"), F.col(y).alias("actual"), F.col(q).alias("predicted"),
                                        (0.5 * F.col(q) + 0.5 * F.lit(st[y])).alias("shrunk"), F.lit(2 * st[q]).alias("w"),
                                        F.lit(float(K.SPEC_LIMITS[y][0])).alias("lo"), F.lit(float(K.SPEC_LIMITS[y][1])).alias("hi"))
                               for y, q in pairs.items()]))
    x = p.select("tapno", rows.alias("r")).select("tapno", "r.*")
    lo, hi = F.col("predicted") - F.col("w"), F.col("predicted") + F.col("w")
    x = x.select("tapno", "target", "actual", "predicted", "shrunk", lo.alias("pi_lo"), hi.alias("pi_hi"),
                 S.in_spec("actual", lo, hi).alias("in_pi"), S.in_spec("predicted", F.col("lo"), F.col("hi")).alias("in_spec"))
    path = SK.write_table(x, scratch_path(spark, "predictions"), partition_by=["target"])
    return spark.read.parquet(path).select(*x.columns)


@query("source_ranges", W("""select 'tap' as source, count(*) as n, min(sampletaken) as first_time, max(sampletaken) as last_time from fx_tap
union all select 'process', count(*), min(clock_raw), max(clock_raw) from fx_para
union all select 'burden', count(*), min(chargetime), max(chargetime) from fx_burden"""))
def q_source_ranges(spark, d):
    """Row count and time range of every source."""
    out = None
    for name, t, c in (("tap", fx.fx_tap(spark, d), "sampletaken"), ("process", fx.fx_para(spark, d), "clock_raw"), ("burden", fx.fx_burden(spark, d), "chargetime")):
        r = t.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.min(c).alias("first_time"), F.max(c).alias("last_time"))
        out = r if out is None else out.unionByName(r)
    return out


@query("sink_importance", W("""select feature, importance as importance from (
  select feature, abs(c) / sum(abs(c)) over () as importance from (""" + " union all ".join(
    f"select '{c}' as feature, corr({c}, hm_si) as c from feat" for c in ["hbt", "oxygen_flow", "coal_actual", "etaco"])
    + "))", P.FEATURE_CTES))
def q_sink_importance(spark, d):
    """(feature, importance) table written and read back."""
    from pyspark.sql import Window
    f = FT.feature_table(spark, d)
    cs = ["hbt", "oxygen_flow", "coal_actual", "etaco"]
    w = f.agg(*[F.corr(c, "hm_si").alias(c) for c in cs])
    long = w.selectExpr(f"stack({len(cs)}, " + ", ".join(f"'{c}', `{c}`" for c in cs) + ") as (feature, c)")
    imp = long.select("feature", (F.abs("c") / F.sum(F.abs("c")).over(Window.partitionBy())).alias("importance"))
    return spark.read.parquet(SK.write_table(imp, scratch_path(spark, "importance")))


@query("sink_feature_meta", W("select * from (" + " union all ".join(
    f"select '{c}' as feature, quantile_cont({c}, 0.01) as p01, quantile_cont({c}, 0.99) as p99, "
    f"avg({c}) as mean, stddev_samp({c}) as std from feat" for c in ["hbt", "hm_si", "hm_temp"])
    + ")", P.FEATURE_CTES))
def q_sink_feature_meta(spark, d):
    """Feature-range metadata table written as parquet and read back."""
    r = aggs.feature_ranges(FT.feature_table(spark, d), ["hbt", "hm_si", "hm_temp"])
    return spark.read.parquet(SK.write_table(r, scratch_path(spark, "feature_range")))


@query("scan_model_store")
def q_scan_model_store(spark, d):
    """A5 + A12: fitted pipeline saved to the shared folder, loaded back, test rows scored."""
    from ..ml import training as TR
    ctx = TR.context(spark, d)
    f = TR.fit_regression(ctx, "hm_si", "Random Forest")
    path = SK.save_model(f["pm"], scratch_path(spark, "model_reg_hm_si"))
    pm = SK.load_model(path)
    test = f["split"].where("split = 'test'")
    return pm.transform(test).select("clock", "hm_si", "prediction")


@query("scan_sensitivity")
def q_scan_sensitivity(spark, d):
    """A6 + A14: sensitivity table partitioned by feature; one feature read with partition
    pruning, a missing feature falls back to an empty frame of the same schema."""
    from .q_ml import _curves
    c = _curves(spark, d)
    path = SK.write_table(c, scratch_path(spark, "sensitivity"), partition_by=["feature"])
    first = c.select("feature").orderBy("feature").first()[0]
    schema = "point_no int, feature_value double, pred_si double, pred_temp double, feature string"
    hit = R.read_partition(spark, path, "feature", first, schema)
    miss = R.read_partition(spark, os.path.join(path, "missing"), "feature", "none", schema)
    return hit.unionByName(miss, allowMissingColumns=True)
