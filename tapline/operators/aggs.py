"""Aggregation operators.

All are single ``groupBy/agg`` passes, so Spark runs a partial (map-side)
aggregate before the shuffle: raw readings collapse to one row per
(key, hour) before anything crosses the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floor_hour


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def hourly_mean(df: DataFrame, ts: str, cols: Sequence[str], by=None,
                out: str = "clock") -> DataFrame:
    """Mean of every column per floored hour; rows with no clock dropped."""
    keys = _by(by)
    return (df.where(F.col(ts).isNotNull())
              .groupBy(*keys, floor_hour(ts).alias(out))
              .agg(*[F.avg(c).alias(c) for c in cols]))


def hourly_sum(df: DataFrame, ts: str, cols: Sequence[str], by=None,
               out: str = "clock") -> DataFrame:
    """Per-hour sum; an all-missing group sums to 0 like pandas."""
    keys = _by(by)
    return (df.where(F.col(ts).isNotNull())
              .groupBy(*keys, floor_hour(ts).alias(out))
              .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols]))


def pivot_sum(df: DataFrame, keys: Sequence[str], pivot_col: str, value_col: str,
              values: Sequence[str], fill: float | None = 0.0, prefix: str = "",
              names: Sequence[str] | None = None) -> DataFrame:
    """Pivot with a *fixed* value list as conditional sums.

    A fixed list keeps the schema static (no distinct pre-pass) and the
    whole pivot is one hash aggregate.  ``fill=None`` keeps absent cells
    NULL (E3), ``fill=0`` fills them (E4).
    """
    names = list(names) if names else [f"{prefix}{v}" for v in values]
    aggs = []
    for v, n in zip(values, names):
        s = F.sum(F.when(F.col(pivot_col) == F.lit(v), F.col(value_col)))
        if fill is not None:
            # a present group whose weights are all missing is 0 as well
            s = F.coalesce(s, F.lit(float(fill)))
        aggs.append(s.alias(n))
    return df.groupBy(*keys).agg(*aggs)


def distinct_values(df: DataFrame, col: str) -> list:
    """Distinct values of a pivot column, which become columns (so the driver holds them in the schema anyway)."""
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).toLocalIterator()]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by=None, approx: bool = False, accuracy: int = 10_000) -> DataFrame:
    """E5: exact linear-interpolated quantiles, one row per group.

    Output columns ``<col>_q<pct>`` (pct = prob·100 with '.' → '_').
    ``percentile`` is exact and meant for hour-bounded tables (raw-volume
    inputs: ``exact_quantiles_distributed``).  ``approx=True`` is the flagged
    fast path: ``percentile_approx`` sketches (rank error ≈ 1/accuracy, no
    interpolation), one bounded sketch per group.
    """
    keys = _by(by)
    parr = F.array(*[F.lit(float(p)) for p in probs])
    # one buffer per column serves every requested probability
    arrs = [(F.percentile_approx(F.col(c), parr, accuracy) if approx else F.percentile(F.col(c), parr)).alias(f"__{c}")
            for c in cols]
    g = df.groupBy(*keys).agg(*arrs)
    return g.select(*keys, *[F.get(F.col(f"__{c}"), i).alias(f"{c}_q{_pct(p)}")
                             for c in cols for i, p in enumerate(probs)])


def exact_quantiles_distributed(df: DataFrame, col: str, probs: Sequence[float], by=None) -> DataFrame:
    """E5 for raw-volume inputs: exact linear-interpolated quantiles, no group buffered in one task.

    Distinct values are counted per group and ranked by a distributed running
    count (``prefix_sum`` by group); the values at ranks floor/ceil(p·(n−1)) are
    then picked with range predicates inside one aggregate.  Output: one row per
    group with ``<col>_q<pct>`` columns (same names as ``exact_quantiles``);
    groups without a value, and an empty input, give no row.
    """
    from .windows import prefix_sum
    keys = _by(by)
    x = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("__v"))
    g = x.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    g = prefix_sum(g, "__v", ["__c"], by=keys, inclusive=False, fmt="__below", total_fmt="__n")
    aggs = []
    for p in probs:
        pos = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda r: F.max(F.when((F.col("__below") <= r) & (r < F.col("__below") + F.col("__c")), F.col("__v")))
        aggs += [at(lo).alias(f"__lo{_pct(p)}"), at(hi).alias(f"__hi{_pct(p)}"),
                 F.first(pos - lo).alias(f"__f{_pct(p)}")]
    r = (g.groupBy(*keys) if keys else g.groupBy(F.lit(1).alias("__g"))).agg(*aggs)
    return r.select(*keys, *[(F.col(f"__lo{_pct(p)}") + F.col(f"__f{_pct(p)}")
                              * (F.col(f"__hi{_pct(p)}") - F.col(f"__lo{_pct(p)}"))).alias(f"{col}_q{_pct(p)}")
                             for p in probs])


def _pct(p: float) -> str:
    s = f"{p * 100:g}"
    return s.replace(".", "_")


def feature_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """p01, p99, mean, sample std per feature, long form (feature, ...)."""
    aggs = []
    for c in cols:
        aggs += [F.percentile(c, 0.01).alias(f"{c}__p01"), F.percentile(c, 0.99).alias(f"{c}__p99"),
                 F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    stack = ", ".join(
        f"'{c}', `{c}__p01`, `{c}__p99`, `{c}__mean`, `{c}__std`" for c in cols)
    return wide.selectExpr(
        f"stack({len(cols)}, {stack}) as (feature, p01, p99, mean, std)")


def data_summary(df: DataFrame, clock: str, targets: Sequence[str]) -> DataFrame:
    """Row count, first/last date and target means."""
    return df.agg(F.count(F.lit(1)).alias("n_records"),
                  F.date_format(F.min(clock), "yyyy-MM-dd").alias("date_start"),
                  F.date_format(F.max(clock), "yyyy-MM-dd").alias("date_end"),
                  *[F.avg(t).alias(f"{t}_mean") for t in targets])


def class_distribution(df: DataFrame, label: str, by=None) -> DataFrame:
    """Count and percent per class (percent within the ``by`` group)."""
    keys = _by(by)
    from pyspark.sql import Window
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    cnt = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    # the window runs on the tiny per-class table, never on raw rows
    return cnt.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(w))


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form (a, b, corr)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) as (col_a, col_b, corr)")


def histogram(df: DataFrame, col: str, bins: int = 40, by=None) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is right-closed."""
    keys = _by(by)
    from pyspark.sql import Window
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    rng = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(
        F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    if keys:
        x = df.where(F.col(col).isNotNull()).join(rng, keys)
    else:
        mn, mx = rng.first() or (None, None)
        x = df.where(F.col(col).isNotNull()).withColumn("__mn", F.lit(mn)).withColumn("__mx", F.lit(mx))
    width = (F.col("__mx") - F.col("__mn")) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("__mn")) / width).cast("int"), F.lit(bins - 1)))
    h = x.groupBy(*keys, b.alias("bin"), "__mn", "__mx").agg(F.count(F.lit(1)).alias("n"))
    h = h.withColumn("bin_lo", F.col("__mn") + (F.col("__mx") - F.col("__mn")) * F.col("bin") / F.lit(float(bins)))
    h = h.withColumn("bin_hi", F.col("__mn") + (F.col("__mx") - F.col("__mn")) * (F.col("bin") + 1) / F.lit(float(bins)))
    h = h.withColumn("density", F.col("n") / (F.sum("n").over(w) * (F.col("__mx") - F.col("__mn")) / F.lit(float(bins))))
    return h.drop("__mn", "__mx")


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str, by=None) -> DataFrame:
    """Share of actuals inside [lo, hi]."""
    keys = _by(by)
    inside = F.coalesce((F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi)), F.lit(False))
    return df.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("coverage"),
                                 F.count(F.lit(1)).alias("n"))


def sensitivity_summary(curves: DataFrame, feature: str = "feature", x: str = "feature_value",
                        ys: Sequence[str] = ("pred_si", "pred_temp")) -> DataFrame:
    """Per feature min/max/delta of each response, first/last grid value."""
    aggs = [F.min(x).alias("x_first"), F.max(x).alias("x_last")]
    for y in ys:
        aggs += [F.min(y).alias(f"{y}_min"), F.max(y).alias(f"{y}_max"),
                 (F.max(y) - F.min(y)).alias(f"{y}_range"),
                 (F.max_by(y, x) - F.min_by(y, x)).alias(f"{y}_delta")]
    return curves.groupBy(feature).agg(*aggs)
