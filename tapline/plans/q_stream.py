"""Registered queries: streaming forms (P1s-P7s), drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures as W
from ..streaming import streams as ST
from .registry import query

SCOLS = ["hbt", "oxygen_flow", "heat_flow_flux"]


def _para_stream(spark, d):
    return fx.para_from_events(fx.events_stream(spark, d, fx.PARA_TYPES))


@query("stream_hourly_mean", W("select clock, " + ", ".join(f"{c} as {c}" for c in SCOLS) + """, n from (
  select date_trunc('hour', clock_raw) as clock, """ + ", ".join(f"avg({c}) as {c}" for c in SCOLS) + """, count(*) as n
  from fx_para group by 1) where clock + interval 1 hour <= (select max(clock_raw) from fx_para) - interval 1 hour"""))
def q_stream_hourly_mean(spark, d):
    """P1s: tumbling 1-hour means with a 1-hour watermark (closed windows only)."""
    return ST.run_available_now(ST.hourly_mean_stream(_para_stream(spark, d), "clock_raw", SCOLS), "p1s")


@query("stream_sliding_mean", W("""select clock, avg(hbt) as hbt, count(*) as n from (
  select date_trunc('hour', clock_raw) - to_hours(k) as clock, hbt from fx_para, range(0, 4) t(k))
group by clock having clock + interval 4 hour <= (select max(clock_raw) from fx_para) - interval 1 hour"""))
def q_stream_sliding_mean(spark, d):
    """P2s: 4-hour windows sliding by 1 hour (time-based twin of the 4-row rolling mean)."""
    s = ST.hourly_mean_stream(_para_stream(spark, d), "clock_raw", ["hbt"], size="4 hours", slide="1 hour")
    return ST.run_available_now(s, "p2s")


@query("stream_sliding_mean_8h", W("""select clock, avg(hbt) as hbt, count(*) as n from (
  select date_trunc('hour', clock_raw) - to_hours(k) as clock, hbt from fx_para, range(0, 8) t(k))
group by clock having clock + interval 8 hour <= (select max(clock_raw) from fx_para) - interval 1 hour"""))
def q_stream_sliding_mean_8h(spark, d):
    """P2s: 8-hour windows sliding by 1 hour."""
    s = ST.hourly_mean_stream(_para_stream(spark, d), "clock_raw", ["hbt"], size="8 hours", slide="1 hour")
    return ST.run_available_now(s, "p2s-8h")


@query("stream_offset_join", W("""select t.clock, t.hm_si as hm_si, b.actwt as actwt_8h_before,
  t.n as n_tap, b.n as n_burden
from (select date_trunc('hour', sampletaken) as clock, avg(hm_si) as hm_si, count(*) as n from fx_tap group by 1) t
join (select date_trunc('hour', chargetime) + interval 8 hour as clock, sum(actwt) as actwt, count(*) as n
      from fx_burden group by 1) b using (clock)
where t.clock + interval 1 hour <= greatest((select max(sampletaken) from fx_tap),
                                            (select max(chargetime) + interval 8 hour from fx_burden)) - interval 1 hour"""))
def q_stream_offset_join(spark, d):
    """P3s: tap hour t ⋈ burden hour t−8 h as one windowed streaming aggregation."""
    ev = fx.events_stream(spark, d, fx.TAP_TYPES + fx.BURDEN_TYPES)
    return ST.run_available_now(ST.offset_join_stream(ev, fx.TAP_TYPES, fx.BURDEN_TYPES), "p3s")


@query("stream_offset_left_join", W("""select t.clock, t.hm_si as hm_si, b.actwt as actwt_8h_before, t.n as n_tap, b.n as n_burden
from (select date_trunc('hour', sampletaken) as clock, avg(hm_si) as hm_si, count(*) as n from fx_tap group by 1) t
left join (select date_trunc('hour', chargetime) + interval 8 hour as clock, sum(actwt) as actwt, count(*) as n
      from fx_burden group by 1) b using (clock)
where t.clock + interval 1 hour <= least((select max(sampletaken) from fx_tap), (select max(chargetime) from fx_burden)) - interval 1 hour"""))
def q_stream_offset_left_join(spark, d):
    """P3s: stream-stream join of hourly taps and charges behind two watermarks; taps without charges stay."""
    ev = fx.events_stream(spark, d, fx.TAP_TYPES + fx.BURDEN_TYPES)
    return ST.run_available_now(ST.offset_left_join_stream(ev, fx.TAP_TYPES, fx.BURDEN_TYPES), "p3s-join")


@query("stream_dedupe", W("""select distinct taphole, date_trunc('hour', sampletaken) as clock from fx_tap"""))
def q_stream_dedupe(spark, d):
    """P7s: one tap per (taphole, hour) within the watermark."""
    taps = fx.tap_from_events(fx.events_stream(spark, d, fx.TAP_TYPES))
    from ..functions.scalars import floor_hour
    taps = taps.withColumn("clock", floor_hour("sampletaken"))
    out = ST.run_available_now(ST.dedupe_stream(taps, ["taphole", "clock"], "sampletaken"), "p7s")
    return out.select("taphole", "clock")


@query("stream_asof", W("""select tapno, unit_id, sampletaken, hm_si as hm_si, clock_raw, hbt as hbt,
  lag_hours as lag_hours from (
  select t.tapno, t.unit_id, t.sampletaken, t.hm_si, p.clock_raw, p.hbt,
         date_diff('microsecond', p.clock_raw, t.sampletaken) / 3.6e9 as lag_hours
  from fx_tap t asof left join fx_para p on t.unit_id = p.unit_id and t.sampletaken >= p.clock_raw)
where clock_raw is not null and lag_hours <= 4 and sampletaken < (
  select date_trunc('milliseconds', max(ts)) - interval 1 hour from events where event_type in ('purchase', 'click', 'view', 'signup'))"""))
def q_stream_asof(spark, d):
    """P4s: stateful as-of: each tap the watermark has passed meets its unit's latest process reading ≤ 4 h old."""
    ev = fx.events_stream(spark, d, fx.TAP_TYPES + fx.PARA_TYPES)
    return ST.run_available_now(ST.asof_stream(ev, fx.TAP_TYPES, fx.PARA_TYPES), "p4s")


@query("stream_lags", W("""select * from (select taphole, tapno, sampletaken, hm_si as hm_si,
  (lag(hm_si, 1) over w) as hm_si_lag1, (lag(hm_si, 2) over w) as hm_si_lag2,
  (lag(hm_si, 3) over w) as hm_si_lag3, (hm_si - lag(hm_si, 1) over w) as hm_si_diff1
from fx_tap window w as (partition by taphole order by sampletaken, tapno))
where sampletaken < (select date_trunc('milliseconds', max(sampletaken)) - interval 1 hour from fx_tap)"""))
def q_stream_lags(spark, d):
    """P5s: per-taphole lag-1..3 and first difference from state (last 12 values)."""
    taps = fx.tap_from_events(fx.events_stream(spark, d, fx.TAP_TYPES))
    return ST.run_available_now(ST.lags_stream(taps), "p5s")


@query("stream_score_alert")
def q_stream_score_alert(spark, d):
    """P6s: process readings scored as they arrive by the batch-trained forest + spec alert."""
    from ..ml import scoring as SC
    from ..ml import training as TR
    ctx = TR.context(spark, d)
    f = TR.fit_regression(ctx, "hm_si", "Random Forest")
    s = _para_stream(spark, d)
    out = ST.score_stream(s, f["pm"], SC.train_means(f)).select("unit_id", "clock_raw", "prediction", "alert")
    return ST.run_available_now(out, "p6s")
