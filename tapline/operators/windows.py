"""Row-offset window features over clock-ordered series.

A window with a series key is ``partitionBy(series).orderBy(clock)``; one
without a key is dealt into blocks of consecutive rows that also hold their
neighbours' edge rows (``_Frame``), so no window gathers a table in one task.
Offsets are *row* offsets (the previous available hour), as in the
source; the ``add_time_*`` variants use ``rangeBetween`` on epoch hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggs import _by


def _w(by, clock: str):
    keys = _by(by)
    return Window.partitionBy(*keys).orderBy(clock) if keys else Window.orderBy(clock)


def add_lags(df: DataFrame, cols: Sequence[str], lags: Sequence[int], by=None,
             clock: str = "clock", fmt: str = "{c}_lag{k}") -> DataFrame:
    """``shift(k)`` for every column and lag."""
    f = _Frame(df, by, clock, before=max(lags))
    return f.add({fmt.format(c=c, k=k): F.lag(c, k).over(f.window) for c in cols for k in lags})


def add_leads(df: DataFrame, cols: Sequence[str], k: int = 1, by=None, clock: str = "clock",
              fmt: str = "{c}_next") -> DataFrame:
    """``shift(-k)`` (future target)."""
    f = _Frame(df, by, clock, after=k)
    return f.add({fmt.format(c=c, k=k): F.lead(c, k).over(f.window) for c in cols})


def add_diffs(df: DataFrame, cols: Sequence[str], by=None, clock: str = "clock",
              fmt: str = "{c}_diff1") -> DataFrame:
    """first difference."""
    f = _Frame(df, by, clock, before=1)
    return f.add({fmt.format(c=c): F.col(c) - F.lag(c, 1).over(f.window) for c in cols})


def add_rolling_mean(df: DataFrame, cols: Sequence[str], windows: Sequence[int], by=None,
                     clock: str = "clock", min_periods: int = 2,
                     fmt: str = "{c}_roll{w}") -> DataFrame:
    """mean of the last w rows *including* the current one, ≥ min_periods values."""
    frame = _Frame(df, by, clock, before=max(windows))
    out = {}
    for c in cols:
        for n in windows:
            f = frame.window.rowsBetween(-(n - 1), 0)
            out[fmt.format(c=c, w=n)] = F.when(F.count(c).over(f) >= min_periods, F.avg(c).over(f))
    return frame.add(out)


def add_rolling_mean_prior(df: DataFrame, cols: Sequence[str], windows: Sequence[int], by=None,
                           clock: str = "clock", fmt: str = "{c}_proll{w}") -> DataFrame:
    """mean of the *previous* w rows; needs all w present (``shift(1).rolling(w)``)."""
    frame = _Frame(df, by, clock, before=max(windows))
    out = {}
    for c in cols:
        for n in windows:
            f = frame.window.rowsBetween(-n, -1)
            out[fmt.format(c=c, w=n)] = F.when(F.count(c).over(f) == n, F.avg(c).over(f))
    return frame.add(out)


def add_rolling_std(df: DataFrame, cols: Sequence[str], window: int = 4, by=None,
                    clock: str = "clock", min_periods: int = 2,
                    fmt: str = "{c}_rstd{w}") -> DataFrame:
    """rolling sample std (min periods), missing → 0."""
    frame = _Frame(df, by, clock, before=window)
    f = frame.window.rowsBetween(-(window - 1), 0)
    return frame.add({
        fmt.format(c=c, w=window): F.coalesce(
            F.when(F.count(c).over(f) >= min_periods, F.stddev_samp(c).over(f)), F.lit(0.0))
        for c in cols})


def chrono_split(df: DataFrame, by=None, clock: str = "clock", train_frac: float = 0.8,
                 min_test: int | None = None, out: str = "split") -> DataFrame:
    """F8: first ``int(n·frac)`` rows of each series are train, the rest test.

    ``min_test`` gives the variant test = max(int(n·(1-frac)), min_test).
    """
    keys = _by(by)
    if keys:
        x = df.withColumn("row_no", F.row_number().over(_w(by, clock))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    else:
        x = numbered(df, clock, out="__i", total="__n").withColumn("row_no", (F.col("__i") + 1).cast("int")).drop("__i")
    n = F.col("__n")
    if min_test is None:
        cut = F.floor(n * F.lit(train_frac))
    else:
        cut = n - F.greatest(F.floor(n * F.lit(1.0 - train_frac)), F.lit(min_test))
    return x.withColumn(out, F.when(F.col("row_no") <= cut, "train").otherwise("test")).drop("__n")


def lookback_sequences(df: DataFrame, cols: Sequence[str], steps: int = 24, by=None,
                       clock: str = "clock", out: str = "seq") -> DataFrame:
    """for each row the previous ``steps`` rows × k columns (only full windows)."""
    frame = _Frame(df, by, clock, before=steps)
    seq = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(frame.window.rowsBetween(-steps, -1))
    return frame.add({out: seq}).where(F.size(out) == steps)


def rank_numbers(df: DataFrame, order_col: str, by=None, desc: bool = True,
                 out: str = "rank", tie: str | None = None, digits: int | None = None) -> DataFrame:
    """1-based rank numbering of an ordered list."""
    keys = _by(by)
    k = F.round(F.col(order_col), digits) if digits is not None else F.col(order_col)
    o = [k.desc() if desc else k.asc()] + ([F.col(tie).asc()] if tie else [])
    w = Window.partitionBy(*keys).orderBy(*o) if keys else Window.orderBy(*o)
    return df.withColumn(out, F.row_number().over(w))


def ranged(df: DataFrame, by, sort: Sequence) -> DataFrame:
    """``df`` range-partitioned on (group, sort columns), with the partition number in ``__bk``.

    Spark samples the edges, so the number of buckets follows the data and the
    shuffle settings, and no group or dense stretch meets in one task.  Input
    and result are checkpointed: the input is computed once, and a row's bucket
    stays the same however often it is read.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    placed = df.checkpoint().repartitionByRange(*[F.col(k) for k in _by(by)], *sort)
    return placed.withColumn("__bk", F.spark_partition_id()).checkpoint()


def with_groups(x: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table of one row per (bucket, group) on; NULL groups match.  The keys of ``table`` are dropped."""
    t = table.withColumnsRenamed({k: f"__o_{k}" for k in ["__bk", *keys]})
    same = F.col("__bk") == F.col("__o___bk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    return x.join(t, same, how).drop(*[f"__o_{k}" for k in ["__bk", *keys]])


def prefix_sum(df: DataFrame, order, cols: Sequence[str], desc: bool = False, inclusive: bool = True, by=None,
               fmt: str = "{c}_cum", total_fmt: str | None = None, tiebreak=None) -> DataFrame:
    """Exact running sums (and, with ``total_fmt``, totals) per ``by`` group without a one-task window.

    Running sums are taken inside the buckets of ``ranged``, and every (bucket,
    group) gets the sum of the group's earlier buckets.

    NULL keys come first (last with ``desc``) and count like any value; NULL
    groups are a group; an empty input gives an empty result.  Rows that tie on
    order and tiebreak share one bucket and are taken in any order.
    """
    keys, order, tie = _by(by), _by(order), _by(tiebreak)
    sort = [F.col(o).desc_nulls_last() if desc else F.col(o).asc_nulls_first() for o in order] + [F.col(t) for t in tie]
    placed = ranged(df, keys, sort)
    tot = placed.groupBy("__bk", *keys).agg(*[F.sum(c).alias(c) for c in cols])
    before = Window.partitionBy(*keys).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)  # over one row per (bucket, group)
    off = tot.select("__bk", *keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__off_{c}") for c in cols],
                     *[F.sum(c).over(whole).alias(f"__all_{c}") for c in cols if total_fmt])
    inside = Window.partitionBy("__bk", *keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    y = placed.withColumns({f"__in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols})
    y = with_groups(y, off, keys)
    out = {fmt.format(c=c): F.col(f"__off_{c}") + F.col(f"__in_{c}") for c in cols}
    if total_fmt:
        out |= {total_fmt.format(c=c): F.col(f"__all_{c}") for c in cols}
    return y.select(*df.columns, *[v.alias(n) for n, v in out.items()])


def numbered(df: DataFrame, order, by=None, out: str = "__i", total: str | None = None, tiebreak=None) -> DataFrame:
    """0-based position of every row in its group's order (and the group size), distributed."""
    x = prefix_sum(df.withColumn("__one", F.lit(1).cast("long")), order, ["__one"], by=by, inclusive=False, fmt=out,
                   total_fmt=total, tiebreak=tiebreak)
    return x.drop("__one")


#: Rows of a block of a series that has no key to partition by.
BLOCK_ROWS = 100_000


class _Frame:
    """A row-offset window over a series, for ``before`` rows back and ``after`` rows ahead.

    With a key, the window is partitioned by it.  Without one, rows are numbered
    (distributed) and dealt into blocks of consecutive rows; each block also
    gets its neighbours' edge rows, which are dropped again after the window.
    """

    def __init__(self, df: DataFrame, by, clock: str, before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS):
        self.blocked = not _by(by)
        if not self.blocked:
            self.df, self.window = df, _w(by, clock)
            return
        size = max(block_rows, before, after)
        x = numbered(df, clock)
        b, at = F.floor(F.col("__i") / size), F.col("__i") % size
        copies = [F.struct(b.alias("b"), F.lit(False).alias("halo"))]
        if before:
            copies.append(F.when(at >= size - before, F.struct((b + 1).alias("b"), F.lit(True).alias("halo"))))
        if after:
            copies.append(F.when((at < after) & (b > 0), F.struct((b - 1).alias("b"), F.lit(True).alias("halo"))))
        x = x.withColumn("__c", F.explode(F.array_compact(F.array(*copies))))
        self.df = x.select(*df.columns, "__i", F.col("__c.b").alias("__b"), F.col("__c.halo").alias("__halo"))
        self.window = Window.partitionBy("__b").orderBy("__i")

    def add(self, columns: dict) -> DataFrame:
        out = self.df.withColumns(columns)
        return out.where(~F.col("__halo")).drop("__i", "__b", "__halo") if self.blocked else out


def _epoch_hours(clock: str):
    return F.expr(f"timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{clock}`)")


def add_time_lags(df: DataFrame, cols: Sequence[str], hours: Sequence[int], by=None, clock: str = "clock",
                  fmt: str = "{c}_tlag{k}") -> DataFrame:
    """F1 with *time* offsets: the value exactly k hours earlier, NULL when that hour is
    missing (the row-offset variant returns the previous available hour instead).
    A one-point ``rangeBetween`` frame on epoch hours, partitioned like every window."""
    keys = _by(by)
    x = df.withColumn("__eh", _epoch_hours(clock))
    base = Window.partitionBy(*keys).orderBy("__eh") if keys else Window.orderBy("__eh")
    return x.withColumns({fmt.format(c=c, k=k): F.first(c).over(base.rangeBetween(-k, -k))
                          for c in cols for k in hours}).drop("__eh")


def add_time_rolling_mean(df: DataFrame, cols: Sequence[str], windows: Sequence[int], by=None,
                          clock: str = "clock", min_periods: int = 2, fmt: str = "{c}_troll{w}") -> DataFrame:
    """F5 with a time frame: mean over the last w *hours* (current included), ≥ min_periods values."""
    keys = _by(by)
    x = df.withColumn("__eh", _epoch_hours(clock))
    base = Window.partitionBy(*keys).orderBy("__eh") if keys else Window.orderBy("__eh")
    out = {}
    for c in cols:
        for n in windows:
            f = base.rangeBetween(-(n - 1), 0)
            out[fmt.format(c=c, w=n)] = F.when(F.count(c).over(f) >= min_periods, F.avg(c).over(f))
    return x.withColumns(out).drop("__eh")
