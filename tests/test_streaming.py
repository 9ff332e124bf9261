"""Streaming forms: closed windows equal the batch operator; a late row is dropped."""

import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapline.streaming import streams as ST


def test_late_row_beyond_watermark_is_dropped(spark):
    d = tempfile.mkdtemp(prefix="tapline-stream-")
    src_dir, out, ck = os.path.join(d, "src"), os.path.join(d, "out"), os.path.join(d, "ck")
    schema = "ts timestamp_ntz, x double"
    first = [(datetime(2024, 1, 1, h, 30), float(h)) for h in range(0, 6)]
    late = [(datetime(2024, 1, 1, 1, 10), 100.0), (datetime(2024, 1, 1, 7, 10), 7.0)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(os.path.join(src_dir, "b1"))

    def drain():
        src = spark.readStream.schema(schema).parquet(os.path.join(src_dir, "b*"))
        return ST.run_available_now(ST.hourly_mean_stream(src, "ts", ["x"]), "late", out=out, checkpoint=ck)
    drain()
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(os.path.join(src_dir, "b2"))
    got = {r.clock.hour: r.x for r in drain().collect()}
    # the restarted query restores watermark 04:30: the 01:10 row is late and dropped
    assert got[1] == 1.0
    assert got[5] == 5.0 and 7 not in got  # 05:00 closes at 06:10 − 1 h; 07:00 still open


def test_stream_hourly_equals_batch(spark):
    from tapline.operators import aggs
    d = tempfile.mkdtemp(prefix="tapline-stream-")
    rows = [(datetime(2024, 1, 1, h, m), float(h * 10 + m)) for h in range(6) for m in (5, 35)]
    spark.createDataFrame(rows, "ts timestamp_ntz, x double").write.parquet(os.path.join(d, "b1"))
    src = spark.readStream.schema("ts timestamp_ntz, x double").parquet(os.path.join(d, "b*"))
    s = ST.run_available_now(ST.hourly_mean_stream(src, "ts", ["x"]), "eq-test")
    b = aggs.hourly_mean(spark.read.parquet(os.path.join(d, "b1")), "ts", ["x"])
    closed = b.where(F.col("clock") <= F.lit("2024-01-01 03:00:00").cast("timestamp_ntz"))
    assert sorted(map(tuple, s.select("clock", "x").collect())) == sorted(map(tuple, closed.collect()))


def _two_batches(spark, rows_1, rows_2, build):
    """The stream's result over two arrivals of (event_id, ts, user_id, event_type, value, props) rows."""
    d = tempfile.mkdtemp(prefix="tapline-stream-")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    for i, rows in enumerate((rows_1, rows_2)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(d, "src", f"b{i}"))
        src = spark.readStream.schema(schema).parquet(os.path.join(d, "src", "b*"))
        got = ST.run_available_now(build(src), "two", out=out, checkpoint=ck)
    return got


def _event(i, hour, kind, value=1.0, user=4):
    return (i, datetime(2024, 1, 1) + timedelta(hours=hour), user, kind, value, '{"k": 5}')


END = 40  # hours; far ahead of the rest, so that the watermark passes everything


def test_stream_asof_over_batches_out_of_order(spark):
    from tapline.sources import fixtures as fx
    one = [_event(1, 1, "click"), _event(2, 6, "view"), _event(3, 6.2, "purchase")]
    two = [_event(4, 5.5, "purchase"), _event(5, 5.4, "click"), _event(6, 2, "purchase"), _event(7, END, "click")]
    got = _two_batches(spark, one, two, lambda s: ST.asof_stream(s, fx.TAP_TYPES, fx.PARA_TYPES, delay="5 hours"))
    match = {r.tapno: r.clock_raw.hour + r.clock_raw.minute / 60 for r in got.collect()}
    # tap 4 meets the reading that came with it, tap 6 the old one, tap 3 the one in order
    assert match == {3: 6.0, 4: 5.4, 6: 1.0}


def test_stream_lags_over_batches_out_of_order(spark):
    from tapline.sources import fixtures as fx
    one = [_event(1, 1, "purchase", 100.0), _event(3, 3, "purchase", 300.0)]
    two = [_event(2, 2, "purchase", 200.0), _event(4, 4, "purchase", 400.0), _event(5, END, "purchase", 0.0)]
    got = _two_batches(spark, one, two, lambda s: ST.lags_stream(fx.tap_from_events(s.where("event_type = 'purchase'")), delay="5 hours"))
    lags = {r.tapno: (r.hm_si_lag1, r.hm_si_lag2, r.hm_si_diff1) for r in got.collect()}
    assert lags == {1: (None, None, None), 2: (1.0, None, 1.0), 3: (2.0, 1.0, 1.0), 4: (3.0, 2.0, 1.0)}


def test_stream_asof_equals_batch_over_random_batches(spark):
    """Five arrivals, rows shuffled within the delay, spans and tolerances crossed: the batch as-of's rows."""
    import bisect
    import random
    from tapline.sources import fixtures as fx
    rng = random.Random(11)
    events = [_event(i, round(rng.uniform(0, 120), 4), rng.choice(["purchase", "click", "view"]), user=rng.randint(1, 3)) for i in range(600)]
    events.sort(key=lambda e: e[1] + timedelta(hours=rng.uniform(0, 4)))  # late by less than the delay
    events += [_event(10_000 + u, 400, "click", user=u) for u in (1, 2, 3)]
    d = tempfile.mkdtemp(prefix="tapline-stream-")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    for i in range(5):
        part = events[i * 121:(i + 1) * 121]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(os.path.join(d, "src", f"b{i}"))
        src = spark.readStream.schema(schema).parquet(os.path.join(d, "src", "b*"))
        got = ST.run_available_now(ST.asof_stream(src, fx.TAP_TYPES, fx.PARA_TYPES, delay="5 hours"), "many", out=out, checkpoint=ck)
    table = spark.createDataFrame(events, schema)
    taps = [(r.unit_id, r.sampletaken, r.tapno) for r in fx.tap_from_events(table.where(F.col("event_type").isin(*fx.TAP_TYPES))).collect()]
    para = {}
    for r in fx.para_from_events(table.where(F.col("event_type").isin(*fx.PARA_TYPES))).collect():
        para.setdefault(r.unit_id, []).append(r.clock_raw)
    want = set()
    for unit, ts, tapno in taps:
        times = sorted(para.get(unit, []))
        at = bisect.bisect_right(times, ts) - 1
        if at >= 0 and ts - times[at] <= timedelta(hours=4):
            want.add((tapno, unit, ts, times[at]))
    rows = got.collect()
    assert len(want) > 50 and len(rows) == len(want) and {(r.tapno, r.unit_id, r.sampletaken, r.clock_raw) for r in rows} == want


def test_stream_lags_of_a_large_series(spark):
    """One series with 60,000 rows in a batch: chunks join without a seam."""
    from tapline.streaming.streams import EMIT_ROWS
    n = 6 * EMIT_ROWS
    d = tempfile.mkdtemp(prefix="tapline-stream-")
    ts = F.timestamp_add("SECOND", F.col("id") % n, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("taphole"), F.col("id").alias("tapno"), ts.alias("sampletaken"), F.col("id").cast("double").alias("hm_si"))
    last = rows.limit(1).withColumn("sampletaken", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).withColumn("tapno", F.lit(n).cast("long"))
    rows.unionByName(last).orderBy(F.xxhash64("tapno")).write.parquet(os.path.join(d, "b"))
    src = spark.readStream.schema(rows.schema).parquet(os.path.join(d, "b"))
    got = ST.run_available_now(ST.lags_stream(src), "large")
    assert got.count() == n
    wrong = got.where("hm_si <> tapno or (tapno >= 1 and coalesce(hm_si_lag1, -1) <> tapno - 1) or (tapno >= 3 and coalesce(hm_si_lag3, -1) <> tapno - 3)")
    assert wrong.count() == 0


def test_stream_left_join_over_batches(spark):
    """Charges arrive after their taps and before: closed tap hours meet the charges of 8 h earlier, others stay with NULLs."""
    from tapline.sources import fixtures as fx
    one = [_event(1, 9.5, "purchase", 100.0), _event(2, 10.5, "purchase", 200.0), _event(3, 1.2, "error", 10.0), _event(4, 10.1, "error", 5.0)]
    two = [_event(5, 1.4, "error", 30.0), _event(6, 12.5, "purchase", 300.0), _event(7, 12.7, "purchase", 500.0), _event(8, 4.1, "error", 7.0),
           _event(9, END, "purchase", 1.0), _event(10, END, "error", 1.0)]
    got = _two_batches(spark, one, two, lambda s: ST.offset_left_join_stream(s, fx.TAP_TYPES, fx.BURDEN_TYPES, delay="12 hours"))
    rows = {r.clock.hour: (r.n_tap, r.n_burden) for r in got.collect()}
    assert rows == {9: (1, 2), 10: (1, None), 12: (2, 1)}


def test_results_do_not_depend_on_session_time_zone(spark):
    """Clock math stays on wall-clock NTZ values: a half-hour-offset zone changes nothing."""
    import __spark_entry__ as E
    from conftest import SF_CHECK
    q = E.queries()
    keys = ["floor_hour", "stream_hourly_mean", "asof_global"]
    base = {k: sorted(map(tuple, q[k](spark, SF_CHECK).collect())) for k in keys}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        other = {k: sorted(map(tuple, q[k](spark, SF_CHECK).collect())) for k in keys}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base == other


def test_stream_asof_of_many_units_shares_keys(spark):
    """2,000 units of few rows in one span, one of them missing: rows of the plain pairing, by no more keys than buckets."""
    from tapline.sources import fixtures as fx
    n = 2_000
    at = lambda u, minute: datetime(2024, 1, 1, 1) + timedelta(minutes=minute, seconds=u % 50)
    kinds = [("click", 0), ("view", 30), ("purchase", 45)]
    rows = [(3 * u + i, at(u, m), u, kind, 1.0, '{"k": 5}') for u in range(n) for i, (kind, m) in enumerate(kinds)]
    rows += [(9_000, at(0, 10), None, "click", 1.0, '{"k": 5}'), (9_001, at(0, 20), None, "purchase", 1.0, '{"k": 5}'),
             (9_002, None, 3, "purchase", 1.0, '{"k": 5}'), (9_003, datetime(2024, 1, 9), 1, "click", 1.0, '{"k": 5}')]
    d = tempfile.mkdtemp(prefix="tapline-stream-")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ck = os.path.join(d, "ck")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(d, "b"))
    src = spark.readStream.schema(schema).parquet(os.path.join(d, "b"))
    stream = ST.asof_stream(src, fx.TAP_TYPES, fx.PARA_TYPES)
    q = (stream.writeStream.format("parquet").option("path", os.path.join(d, "out")).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.tapno, r.unit_id, r.clock_raw) for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    assert got == {(3 * u + 2, u, at(u, 30)) for u in range(n)}
    entries = max(s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"])
    assert entries <= 10 * ST.ASOF_BUCKETS  # a key each unit wrote some thousands
