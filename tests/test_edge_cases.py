"""Tiny literal frames for the semantic edge cases (NaN vs NULL, bin edges, ties, gaps)."""

import math
import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from tapline import constants as K
from tapline.functions import scalars as S
from tapline.operators import aggs, clean, ingest, joins, metrics, windows
from tapline.sources import readers as R


def test_nan_becomes_null_and_fault_filter(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (99.9,), (100.0,), (100.1,)], "x double")
    x = df.select(S.nan_to_null("x").alias("x"))
    assert clean.sensor_fault_filter(x, "x").count() == 1  # NaN and NULL dropped, like pandas
    assert x.agg(F.avg("x")).first()[0] == (99.9 + 100.0 + 100.1) / 3


def test_si_edges_cut_vs_spec(spark):
    rows = [(0.2499,), (0.25,), (0.2501,), (0.80,), (0.8001,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    got = df.select(S.cut_right_closed("x", K.SI_EDGES, K.SI_LABELS).alias("c"),
                    S.in_spec("x", *K.SI_SPEC).alias("ok")).collect()
    assert [r.c for r in got] == ["Low", "Low", "Normal", "Normal", "High", "nan"]
    assert [r.ok for r in got] == [False, True, True, True, False, False]


def test_temp_edges(spark):
    df = spark.createDataFrame([(1479.9,), (1480.0,), (1535.0,), (1535.1,)], "x double")
    got = [r[0] for r in df.select(S.cut_right_closed("x", K.TEMP_EDGES, K.TEMP_LABELS_HOTCOLD)).collect()]
    assert got == ["Cold", "Cold", "Normal", "Hot"]


def test_zero_denominators_training_vs_inference(spark):
    df = spark.createDataFrame([(100.0, 0.0), (0.0, 0.0)], "iron double, coke double")
    r = df.select(S.safe_div("iron", "coke").alias("train"), S.guarded_ratio("iron", "coke", 1.0).alias("infer")).collect()
    assert r[0].train is None and r[0].infer == 100.0
    assert r[1].train is None and r[1].infer == 0.0


def test_all_null_group_sums_to_zero(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), 1.0), (datetime(2024, 1, 1, 1, 5), None)],
                               "ts timestamp_ntz, w double")
    got = {r.clock.hour: r.w for r in aggs.hourly_sum(df, "ts", ["w"]).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_iqr_zero_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None)] * 5 + [(5.0, None)], "a double, b double")
    # iqr = 0 keeps only the constant; unguarded all-null column empties the table
    assert clean.iqr_simultaneous(df, ["a"]).count() == 5
    assert clean.iqr_simultaneous(df, ["a", "b"]).count() == 0
    # guarded sequential variant skips both columns
    assert clean.iqr_sequential(df, ["a", "b"], k=3.5, skip_nonpositive_iqr=True, checkpoint_every=0).count() == 6


def test_material_first_match_vs_keywords(spark):
    df = spark.createDataFrame([("NutCoke", 1.0), (" smallsinter ", 2.0), ("Quartzite", 3.0)], "brandcode string, actwt double")
    mats = [r[0] for r in df.select(S.classify_material("brandcode")).collect()]
    assert mats == ["coke_kg", "sinter_kg", "other_kg"]
    kw = df.select(*[S.keyword_weight("brandcode", "actwt", w).alias(g) for g, w in K.KEYWORD_GROUPS]).collect()
    assert kw[0].coke_kg == 1.0 and kw[0].nutcoke_kg == 1.0  # non-exclusive
    assert kw[2].flux_kg == 3.0


def test_asof_ties_and_carry_across_buckets(spark):
    left = spark.createDataFrame([(1, datetime(2024, 1, 3, 5)), (2, datetime(2024, 1, 3, 6)), (3, datetime(2024, 1, 1, 0))],
                                 "id int, t timestamp_ntz")
    right = spark.createDataFrame([(datetime(2024, 1, 1, 23), 10.0), (datetime(2024, 1, 3, 6), 20.0)],
                                  "rt timestamp_ntz, v double")
    got = {r.id: r.v for r in joins.asof_join(left, right, "t", "rt", right_cols=["v"]).collect()}
    # id 1: carried from two days earlier; id 2: exact match; id 3: nothing earlier
    assert got == {1: 10.0, 2: 20.0, 3: None}


def test_gap_series_row_offsets(spark):
    hours = [0, 1, 2, 5, 6]
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, h), float(h)) for h in hours], "s int, clock timestamp_ntz, x double")
    got = [r.x_lag1 for r in windows.add_lags(df, ["x"], [1], by="s").orderBy("clock").collect()]
    assert got == [None, 0.0, 1.0, 2.0, 5.0]  # previous *available* hour
    tl = [r.x_tlag1 for r in windows.add_time_lags(df, ["x"], [1], by="s").orderBy("clock").collect()]
    assert tl == [None, 0.0, 1.0, None, 5.0]  # exactly one hour earlier


def test_short_rolling_windows(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, h), float(h + 1)) for h in range(3)], "s int, clock timestamp_ntz, x double")
    r = windows.add_rolling_mean_prior(windows.add_rolling_mean(df, ["x"], [4], by="s"), ["x"], [2], by="s")
    got = r.orderBy("clock").collect()
    assert [g.x_roll4 for g in got] == [None, 1.5, 2.0]
    assert [g.x_proll2 for g in got] == [None, None, 1.5]


def test_class_never_predicted_zero_division(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "A"), ("C", "C")], "y string, p string")
    m = metrics.classification_metrics(df, "y", "p").first()
    # B: precision 0 (never predicted), recall 0 → F1 0
    assert abs(m.precision_macro - (0.5 + 0 + 1) / 3) < 1e-12
    assert abs(m.recall_macro - (1 + 0 + 1) / 3) < 1e-12


def test_multirow_header_and_bom_csv(spark):
    d = tempfile.mkdtemp(prefix="tapline-test-")
    p = os.path.join(d, "para.csv")
    with open(p, "w") as f:
        f.write("PARA export,,,\n")
        f.write("Time,HBT,,Coal Inj. SP\n")
        f.write(",degC,x,t/h\n")
        f.write("2024-01-01 00:00:00,1100,1,2\n2024-01-01 01:00:00,abc,1,2\n2024-01-01 02:00:00,1102,1,\n")
    df = R.read_multirow_header(spark, p)
    assert df.columns == ["CLOCK", "HBT", "col_2", "Coal Inj. SP"]
    rows = df.orderBy("CLOCK").collect()
    assert len(rows) == 3 and rows[1].HBT is None and rows[2]["Coal Inj. SP"] is None
    b = os.path.join(d, "burden.csv")
    with open(b, "w", encoding="utf-8-sig") as f:
        f.write(" CHARGETIME , BRANDCODE ,ACTWT\n01-01-2024 08:00, Coke3Fresh ,1200\n")
    r = R.read_burden_csv(spark, b)
    assert r.columns == ["CHARGETIME", "BRANDCODE", "ACTWT"]
    row = r.select(S.coerce_timestamp("CHARGETIME", dayfirst=True).alias("t"), "BRANDCODE").first()
    assert row.BRANDCODE == "Coke3Fresh" and row.t == datetime(2024, 1, 1, 8, 0)


def test_norm_and_dedupe_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("  Coal Inj. SP ", "x", "x")
    assert ingest.norm_columns(df).columns == ["COAL_INJ_SP", "X", "X"]
    assert ingest.dedupe_columns(df).columns == ["  Coal Inj. SP ", "x"]
    assert ingest.dedupe_columns(df).first()[1] == 2


def test_source_choice_and_spark_file_listing(spark):
    assert R.choose_source(["/x/misc_log", "/x/BF4_para_export", "/x/other"]) == "/x/BF4_para_export"
    assert R.choose_source(["/x/a", "/x/b"]) == "/x/b"  # no hint → the last one
    from tapline.session import scratch_path
    path = scratch_path(spark, "listing")  # a URI under the shared checkpoint folder
    spark.range(10).repartition(3).write.csv(path)
    files = R.list_files(spark, path)
    assert len(files) >= 3 and all(f.endswith(".csv") for f in files)
    assert R.read_partition(spark, path + "-missing", "id", 1, "id long").count() == 0
