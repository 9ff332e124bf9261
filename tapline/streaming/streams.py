"""Structured Streaming forms of the batch operators (P1s-P7s).

Event time arrives as TIMESTAMP_NTZ; watermarks need TIMESTAMP, so the
wall clock is mapped to an instant *as if UTC* (and back) with
time-zone-free arithmetic — results do not depend on the session zone.
Queries run with ``trigger(availableNow=True)`` into a parquet sink with a
checkpoint under the shared checkpoint folder (exactly-once file sink,
restartable after executor or driver loss).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .. import constants as K
from ..functions import scalars as S
from ..session import scratch_path

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_instant(col: str) -> F.Column:
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{col}`)"))


def instant_to_ntz(c: F.Column) -> F.Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def run_available_now(df: DataFrame, name: str, mode: str = "append", out: str | None = None,
                      checkpoint: str | None = None) -> DataFrame:
    """Drain a streaming DataFrame once (availableNow) into parquet; return the table.

    Passing the same ``out``/``checkpoint`` again resumes the query: offsets,
    state and the watermark come back from the checkpoint.
    """
    spark = df.sparkSession
    out = out or scratch_path(spark, name)
    ck = checkpoint or scratch_path(spark, name + "-ckpt")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def hourly_mean_stream(s: DataFrame, ts: str, cols: Sequence[str], by: Sequence[str] = (),
                       delay: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """P1s/P2s: tumbling (or sliding) event-time means, late data cut by the watermark."""
    x = s.withColumn("__et", ntz_to_instant(ts)).withWatermark("__et", delay)
    w = F.window("__et", size, slide) if slide else F.window("__et", size)
    g = x.groupBy(*by, w.alias("w")).agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n"))
    return g.select(*by, instant_to_ntz(F.col("w.start")).alias("clock"), *cols, "n")


def offset_join_stream(ev: DataFrame, tap_types: Sequence[str], burden_types: Sequence[str],
                       hours: int = K.BURDEN_DESCENT_HOURS, delay: str = "1 hour") -> DataFrame:
    """P3s: tap hour t meets burden hour t − 8 h as ONE windowed aggregation.

    Charges are re-stamped to t + 8 h, taps keep t; grouping both by the
    aligned hour gives the inner join of the two hourly tables without
    ever pairing individual events (no hot-key pair explosion).
    """
    from ..sources.fixtures import burden_from_events, tap_from_events
    none = F.lit(None).cast("double")
    tap = tap_from_events(ev.where(F.col("event_type").isin(*tap_types))).select(
        F.col("sampletaken").alias("aligned"), F.lit("tap").alias("side"), "hm_si", none.alias("actwt"))
    bur = burden_from_events(ev.where(F.col("event_type").isin(*burden_types))).select(
        S.shift_hours("chargetime", hours).alias("aligned"), F.lit("burden").alias("side"),
        none.alias("hm_si"), "actwt")
    rows = tap.unionByName(bur)
    y = rows.withColumn("__et", ntz_to_instant("aligned")).withWatermark("__et", delay)
    g = y.groupBy(F.window("__et", "1 hour").alias("w")).agg(
        F.avg("hm_si").alias("hm_si"), F.sum("actwt").alias("actwt_8h_before"),
        F.sum((F.col("side") == "tap").cast("long")).alias("n_tap"),
        F.sum((F.col("side") == "burden").cast("long")).alias("n_burden"))
    return g.where((F.col("n_tap") > 0) & (F.col("n_burden") > 0)).select(
        instant_to_ntz(F.col("w.start")).alias("clock"), "hm_si", "actwt_8h_before", "n_tap", "n_burden")


def dedupe_stream(s: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """P7s: drop repeated keys that arrive within the watermark delay."""
    x = s.withColumn("__et", ntz_to_instant(ts)).withWatermark("__et", delay)
    return x.dropDuplicatesWithinWatermark(list(keys)).drop("__et")


def offset_left_join_stream(ev: DataFrame, tap_types: Sequence[str], burden_types: Sequence[str],
                            hours: int = K.BURDEN_DESCENT_HOURS, delay: str = "1 hour") -> DataFrame:
    """P3s as a stream-stream join: hourly taps LEFT JOIN hourly charges of ``hours`` before.

    Either side is reduced to closed hours behind its own watermark, so a hot
    hour never pairs events.  The interval condition on the two event times
    bounds the join's state: a charge hour is evicted once no tap hour can meet
    it, and a tap hour without charges comes out with NULLs once the watermark
    has passed the hour it waits for.
    """
    from ..sources.fixtures import burden_from_events, tap_from_events

    def hourly(rows: DataFrame, ts: str, *aggs: F.Column) -> DataFrame:
        x = rows.withColumn("__et", ntz_to_instant(ts)).withWatermark("__et", delay)
        g = x.groupBy(F.window("__et", "1 hour").alias("w")).agg(*aggs)
        return g.withColumn("et", F.window_time("w")).withColumn("clock", instant_to_ntz(F.col("w.start"))).drop("w")

    tap = hourly(tap_from_events(ev.where(F.col("event_type").isin(*tap_types))), "sampletaken",
                 F.avg("hm_si").alias("hm_si"), F.count(F.lit(1)).alias("n_tap"))
    bur = hourly(burden_from_events(ev.where(F.col("event_type").isin(*burden_types))), "chargetime",
                 F.sum("actwt").alias("actwt_8h_before"), F.count(F.lit(1)).alias("n_burden"))
    bur = bur.withColumn("aligned", S.shift_hours("clock", hours)).withColumnRenamed("et", "bur_et").drop("clock")
    gap = F.expr(f"INTERVAL {hours} HOURS")
    met = (F.col("clock") == F.col("aligned")) & (F.col("et") >= F.col("bur_et") + gap) & (F.col("et") <= F.col("bur_et") + gap)
    return tap.join(bur, met, "left_outer").select("clock", "hm_si", "actwt_8h_before", "n_tap", "n_burden")


# ---------------------------------------------------------------- stateful

MICROS_H = 3_600_000_000
#: Rows of one emitted frame.
EMIT_ROWS = 10_000
#: A unit's events are dealt to spans of so many tolerances, each a state key of its own.
SPAN_TOLERANCES = 4
#: Units are dealt to so many buckets; a state key is one bucket in one span.
ASOF_BUCKETS = 16
#: Packed state rows of the as-of.
TAP = np.dtype([("us", "i8"), ("unit_id", "i8"), ("tapno", "i8"), ("hm_si", "f8")])
READING = np.dtype([("us", "i8"), ("unit_id", "i8"), ("hbt", "f8")])


def _entry_state(df: DataFrame) -> DataFrame:
    """Keyed entry state lives in RocksDB: a key's list is appended to, never rewritten as one value."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


def _micros(col: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{col}`)")


def _packed(pdf: pd.DataFrame, kind: np.dtype) -> bytes:
    out = np.empty(len(pdf), kind)
    for name in kind.names:
        out[name] = pdf[name].to_numpy(kind[name])
    return out.tobytes()


def _ntz(col: str) -> F.Column:
    return instant_to_ntz(F.timestamp_micros(F.col(col)))


class _EventTimeBuffer(StatefulProcessor):
    """Pending entries of a key in list state, released in event-time order once the watermark has passed them.

    An entry is a row, or a frame of rows under its earliest time.  One timer a
    key wakes it for its earliest pending entry (or for its end, where the key's
    state goes); new entries are appended frame by frame.
    """

    pending_schema: str

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.pending_schema)
        self.wake = handle.getValueState("wake", "ms long")

    def take(self, pdf: pd.DataFrame) -> list[tuple]:
        """Pending entries (time in microseconds first) of a frame; other rows go to the key's own state."""
        raise NotImplementedError

    def due(self, rows: list[tuple], before_us: int) -> tuple[list, list[tuple]]:
        """Pending entries parted into the rows before a time, sorted, and the entries that go on waiting."""
        early = sorted((r for r in rows if r[0] < before_us), key=lambda r: r[:2])
        return early, [r for r in rows if r[0] >= before_us]

    def release(self, key, due) -> Iterator[pd.DataFrame]:
        """Results of the rows the watermark has passed, as ``due`` gives them."""
        raise NotImplementedError

    def end_ms(self, key) -> int | None:
        """When the key can meet no more rows."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = self.take(pdf)
            if new:
                self.pending.appendList(new)
                low = min(new)[0]
                first = low if first is None else min(first, low)
        at = [x for x in (None if first is None else first // 1000, self.end_ms(key)) if x is not None]
        held = self.wake.get()
        if at and (held is None or min(at) < held[0]):
            self._set_wake(held, min(at))
        yield from self._settle(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues)

    def _set_wake(self, held, ms: int | None) -> None:
        if held is not None:
            self.handle.deleteTimer(held[0])
        if ms is None:
            self.wake.clear()
        else:
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def _settle(self, key, timerValues) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self.wake.get()
        if held is None or held[0] >= now:
            return
        due, rest = self.due([tuple(row) for row in self.pending.get()], now * 1000)
        if len(due):
            yield from self.release(key, due)
            self.pending.put(rest) if rest else self.pending.clear()
        end = self.end_ms(key)
        if end is not None and end < now and not rest:
            self._set_wake(held, None)
            self.finish()
            return
        times = [min(rest)[0] // 1000] if rest else []
        times += [end] if end is not None else []
        self._set_wake(held, max(min(times), now) if times else None)

    def finish(self) -> None:
        """Drop the key's own state."""

    def close(self) -> None:
        pass


class _Asof(_EventTimeBuffer):
    """Taps of one (bucket of units, span) against the readings of their units.

    Every frame of taps or readings is one state entry of packed columns, so the
    work of a key is a few calls however many rows it holds.
    """

    pending_schema = "us long, taps binary"

    def __init__(self, tolerance_us: int, span_us: int):
        self.tolerance, self.span = tolerance_us, span_us

    def init(self, handle) -> None:
        super().init(handle)
        self.readings = handle.getListState("readings", "rows binary")

    def take(self, pdf):
        pdf = pdf[pdf["has_unit"].to_numpy(bool)]  # a missing unit meets no reading
        tap = pdf["is_tap"].to_numpy(bool)
        para, some = pdf[~tap], pdf[tap]
        if len(para):
            self.readings.appendList([(_packed(para, READING),)])
        return [(int(some["us"].min()), _packed(some, TAP))] if len(some) else []

    def end_ms(self, key):
        return (int(key[1]) + 1) * self.span // 1000

    def due(self, rows: list[tuple], before_us: int) -> tuple[list, list[tuple]]:
        taps = np.concatenate([np.frombuffer(r[1], TAP) for r in rows]) if rows else np.zeros(0, TAP)
        late = taps["us"] >= before_us
        rest = taps[late]
        return taps[~late], [(int(rest["us"].min()), rest.tobytes())] if len(rest) else []

    def release(self, key, due):
        held = [np.frombuffer(r[0], READING) for r in self.readings.get()]
        if not held:
            return
        para = pd.DataFrame(np.concatenate(held)).rename(columns={"us": "para_us"})
        para = para.sort_values(["para_us", "hbt"], kind="mergesort")
        taps = pd.DataFrame(due).sort_values(["us", "tapno"], kind="mergesort")
        m = pd.merge_asof(taps, para, left_on="us", right_on="para_us", by="unit_id", direction="backward", tolerance=self.tolerance)
        m = m[m["para_us"].notna()].astype({"para_us": "int64"})
        for lo in range(0, len(m), EMIT_ROWS):
            yield m.iloc[lo:lo + EMIT_ROWS][["tapno", "unit_id", "us", "hm_si", "para_us", "hbt"]]

    def finish(self) -> None:
        self.readings.clear()


def asof_stream(ev: DataFrame, tap_types, para_types, tolerance_h: float = K.ASOF_TOLERANCE_HOURS, delay: str = "1 hour",
                buckets: int = ASOF_BUCKETS) -> DataFrame:
    """P4s: each tap meets the unit's latest process reading within ``tolerance_h``.

    A unit's events are dealt to time spans of SPAN_TOLERANCES tolerances; the
    readings of a span's last tolerance also go to the next span, which is all a
    tap there can reach back to.  Units are dealt to ``buckets`` by hash, and every
    (bucket, span) is a state key: many small units share the cost of a key, and
    a hot unit spreads over its spans.  Taps wait until the watermark passes
    them, a span's state goes once the watermark has passed its end, and rows
    may arrive in any order within the delay.  A restarted query must keep its buckets.
    """
    from ..sources.fixtures import para_from_events, tap_from_events
    none = F.lit(None)
    tolerance_us = int(tolerance_h * MICROS_H)
    span_us = SPAN_TOLERANCES * tolerance_us
    taps = tap_from_events(ev.where(F.col("event_type").isin(*tap_types))).select(
        "unit_id", F.col("sampletaken").alias("ts"), "tapno", F.lit(True).alias("is_tap"), "hm_si",
        none.cast("double").alias("hbt"))
    para = para_from_events(ev.where(F.col("event_type").isin(*para_types))).select(
        "unit_id", F.col("clock_raw").alias("ts"), F.lit(0).cast("long").alias("tapno"), F.lit(False).alias("is_tap"),
        none.cast("double").alias("hm_si"), "hbt")
    x = taps.unionByName(para).withColumn("__et", ntz_to_instant("ts")).withWatermark("__et", delay).withColumn("us", _micros("ts"))
    span = F.floor(F.col("us") / F.lit(span_us)).cast("long")
    carried = ~F.col("is_tap") & (F.pmod("us", F.lit(span_us)) >= span_us - tolerance_us)
    x = x.withColumn("span", F.explode(F.when(carried, F.array(span, span + 1)).otherwise(F.array(span)))).where("span is not null")
    x = x.withColumns({"bucket": F.pmod(F.xxhash64("unit_id"), F.lit(buckets)), "has_unit": F.col("unit_id").isNotNull(),
                       "unit_id": F.coalesce("unit_id", F.lit(0))})
    out = _entry_state(x.drop("ts")).groupBy("bucket", "span").transformWithStateInPandas(
        _Asof(tolerance_us, span_us), "tapno long, unit_id long, us long, hm_si double, para_us long, hbt double", "append", "EventTime")
    return out.select("tapno", "unit_id", _ntz("us").alias("sampletaken"), "hm_si", _ntz("para_us").alias("clock_raw"), "hbt",
                      ((F.col("us") - F.col("para_us")) / F.lit(float(MICROS_H))).alias("lag_hours"))


class _Lags(_EventTimeBuffer):
    """Rows of one series with the values before them."""

    pending_schema = "us long, tapno long, hm_si double"

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", "hm_si double")

    def take(self, pdf):
        return list(zip(pdf["us"].tolist(), pdf["tapno"].astype("int64").tolist(), pdf["hm_si"].astype(float).tolist()))

    def release(self, key, due):
        values = [r[0] for r in self.last.get()]
        for lo in range(0, len(due), EMIT_ROWS):
            out = pd.DataFrame(due[lo:lo + EMIT_ROWS], columns=["us", "tapno", "hm_si"])
            n, series = len(values), pd.Series(values + out["hm_si"].tolist(), dtype="float64")
            for k in (1, 2, 3):
                out[f"hm_si_lag{k}"] = series.shift(k).iloc[n:].to_numpy()
            out["hm_si_diff1"] = (series - series.shift(1)).iloc[n:].to_numpy()
            values = series.iloc[-self.keep:].tolist()
            yield out.assign(taphole=int(key[0]))[["taphole", "tapno", "us", "hm_si", "hm_si_lag1", "hm_si_lag2", "hm_si_lag3", "hm_si_diff1"]]
        self.last.put([(v,) for v in values])


def lags_stream(taps: DataFrame, keep: int = 12, delay: str = "1 hour") -> DataFrame:
    """P5s: per-series lag/diff features in event-time order.

    State per series, in entries: the last ``keep`` values and the rows the
    watermark has not passed yet.
    """
    x = taps.select("taphole", "tapno", "sampletaken", "hm_si").withColumn("__et", ntz_to_instant("sampletaken")).withWatermark("__et", delay)
    x = x.withColumn("us", _micros("sampletaken")).drop("sampletaken")
    out = _entry_state(x).groupBy("taphole").transformWithStateInPandas(
        _Lags(keep), "taphole long, tapno long, us long, hm_si double, hm_si_lag1 double, hm_si_lag2 double, hm_si_lag3 double, hm_si_diff1 double",
        "append", "EventTime")
    return out.withColumn("sampletaken", _ntz("us")).drop("us")


def score_stream(s: DataFrame, pipeline_model, means: dict, target: str = "hm_si") -> DataFrame:
    """P6s: continuous scoring with the batch-trained pipeline + spec alert."""
    x = s.withColumns({c: (F.coalesce(F.col(c), F.lit(v)) if c in s.columns else F.lit(v)) for c, v in means.items()})
    y = pipeline_model.transform(x)
    lo, hi = K.SPEC_LIMITS[target]
    ok = S.in_spec("prediction", lo, hi)
    return y.withColumn("alert", F.when(ok, "OK").otherwise("OFF-SPEC"))
