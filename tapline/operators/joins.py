"""Join operators.

Equi joins are left to Catalyst + AQE: no broadcast hint on data-derived
sides, so AQE broadcasts only what its runtime statistics show is below
``spark.sql.autoBroadcastJoinThreshold`` and falls back to sort-merge
otherwise.  Explicit ``broadcast`` is used only for lookup tables whose
size is fixed by construction (limits, rule tables).

The as-of join has no public DataFrame API, so it is a union + window
rewrite that is partitioned by ``(series, time bucket)``; matches that
cross a bucket boundary come from a small per-bucket "last row" table
carried forward with a second window, so one long series never
collapses into a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lag_hours, shift_hours
from .aggs import _by


def join_inner(dfs: Sequence[DataFrame], on: Sequence[str] | str = "clock") -> DataFrame:
    """D3: chain of inner equi joins on the shared clock."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, on=on, how="inner")
    return out


def suffix_overlaps(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str) -> DataFrame:
    """Rename right columns that collide with the left (``suffixes=('', s)``)."""
    on = set(on)
    clash = {c: c + suffix for c in right.columns if c in set(left.columns) and c not in on}
    return right.withColumnsRenamed(clash) if clash else right


def join_left_fill(left: DataFrame, right: DataFrame, on: Sequence[str] | str = "clock",
                   fill: float = 0.0, suffix: str = "_b") -> DataFrame:
    """Left join, right-side value columns filled with ``fill``."""
    on_l = [on] if isinstance(on, str) else list(on)
    right = suffix_overlaps(left, right, on_l, suffix)
    vals = [c for c in right.columns if c not in on_l]
    return left.join(right, on=on_l, how="left").fillna(fill, subset=vals)


def offset_join(left: DataFrame, right: DataFrame, hours: int, on: str = "clock",
                how: str = "inner") -> DataFrame:
    """Right row at t meets left row at t + hours (shift, then equi join)."""
    r = right.withColumn(on, shift_hours(on, hours))
    return left.join(r, on=on, how=how)


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
              by: Sequence[str] | str | None = None, right_cols: Sequence[str] | None = None,
              tolerance_hours: float | None = None, lag_col: str | None = None) -> DataFrame:
    """Backward as-of join (latest right row with ``right_on <= left_on``).

    Left rows are all kept (``tolerance_hours=None``); with a tolerance,
    unmatched or too-old matches are dropped (D2).  Exact matches count; of
    right rows at the same time the one with the greatest payload matches.

    Both sides are one table, range-partitioned on (series, time); a match in
    the row's own bucket comes from a window inside it, an older one from the
    (bucket, series) table of last right rows.  A hot series, or a burst inside
    a minute, spreads over as many buckets as its rows need.
    """
    from .windows import ranged, with_groups
    keys = _by(by)
    right_cols = list(right_cols) if right_cols else [
        c for c in right.columns if c not in keys and c != right_on]
    payload = [right_on] + [c for c in right_cols if c != right_on]
    rtype = right.select(F.struct(*payload)).schema[0].dataType
    L = left.withColumns({"__t": F.col(left_on), "__side": F.lit(1), "__r": F.lit(None).cast(rtype)})
    R = right.select(*keys, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), F.struct(*payload).alias("__r")) \
        .where(F.col("__t").isNotNull())
    # right rows sort before left rows at equal time, so an exact match counts
    sort = [F.col("__t").asc_nulls_first(), F.col("__side"), F.col("__r")]
    U = ranged(L.unionByName(R, allowMissingColumns=True), keys, sort)
    w = (Window.partitionBy("__bk", *keys).orderBy(*sort)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    M = U.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    # last right row of every (bucket, series), carried over the buckets behind it
    last = U.groupBy("__bk", *keys).agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__r"))).alias("__last"))
    wb = Window.partitionBy(*keys).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("__bk", *keys, F.last("__last.__r", ignorenulls=True).over(wb).alias("__c"))
    out = with_groups(M, carry, keys)
    # a row without a time matches nothing
    match = F.when(F.col("__t").isNotNull(), F.coalesce("__m", "__c"))
    res = out.withColumn("__m", match).select(*left.columns, *[F.col("__m")[c].alias(c) for c in payload])
    if tolerance_hours is not None or lag_col:
        res = res.withColumn(lag_col or "lag_hours", lag_hours(left_on, right_on))
    if tolerance_hours is not None:
        res = res.where(F.col(lag_col or "lag_hours") <= F.lit(float(tolerance_hours)))
    return res


def lookup_fallback(keys_df: DataFrame, key: str, tables: Sequence[DataFrame], value: str,
                    default=None, out: str | None = None) -> DataFrame:
    """Value from the first table that has the key, else ``default``."""
    cur = keys_df
    names = []
    for i, t in enumerate(tables):
        n = f"__v{i}"
        cur = cur.join(t.select(F.col(key), F.col(value).alias(n)), on=key, how="left")
        names.append(F.col(n))
    if default is not None:
        names.append(F.lit(default))
    return cur.withColumn(out or value, F.coalesce(*names)).drop(*[f"__v{i}" for i in range(len(tables))])


def map_overlay(base, override):
    """Request values override defaults (``{**base, **override}``)."""
    return F.map_zip_with(base, override, lambda k, b, o: F.coalesce(o, b))


def lookup_ci(df: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Case-insensitive key lookup (join on lower-cased keys)."""
    t = table.withColumn("__lk", F.lower(F.col(table_key)))
    return df.withColumn("__lk", F.lower(F.col(key))).join(t.drop(table_key), "__lk", "left").drop("__lk")
