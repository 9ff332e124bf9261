"""Row filters, outlier fences, imputers and scalers.

Fences and scaler parameters are *scalar* statistics: they are computed by
one aggregate (one row per group) and applied as column expressions.  For
a global fence the single stats row is read back as literals, which also
lets the filter be pushed into the parquet scan when it sits right above
it; for grouped fences the stats table is joined on the group key (AQE
broadcasts it when it is small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggs import _by
from .selection import quantiles


def dropna_subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows missing any of ``cols``."""
    return df.dropna(how="any", subset=list(cols))


def dropna_any(df: DataFrame) -> DataFrame:
    """Drop rows missing anything."""
    return df.dropna(how="any")


def sensor_fault_filter(df: DataFrame, col: str = "heat_flow_flux", limit: float = 100.0) -> DataFrame:
    """Keep ``col < limit``; missing readings are dropped too."""
    return df.where(F.col(col) < F.lit(float(limit)))


def _fence_stats(df: DataFrame, cols: Sequence[str], keys: list[str]) -> DataFrame:
    arrs = [F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.75))).alias(f"__q_{c}") for c in cols]
    return df.groupBy(*keys).agg(*arrs)


def _between(c: str, q1, q3, k: float):
    iqr = q3 - q1
    return (F.col(c) >= q1 - F.lit(float(k)) * iqr) & (F.col(c) <= q3 + F.lit(float(k)) * iqr)


def iqr_simultaneous(df: DataFrame, cols: Sequence[str], k: float = 3.0, by=None) -> DataFrame:
    """Every fence from the *input*, conditions AND-ed (missing → dropped)."""
    keys = _by(by)
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if not keys:
        found = quantiles(df, {c: [0.25, 0.75] for c in cols})
        cond = None
        for c in cols:
            q1, q3 = found[c] or (None, None)
            if q1 is None or q3 is None:
                t = F.lit(False)  # all-missing column: pandas keeps nothing
            else:
                t = _between(c, F.lit(float(q1)), F.lit(float(q3)), k)
            cond = t if cond is None else (cond & t)
        return df.where(cond)
    stats = _fence_stats(df, cols, keys)
    cond = None
    for c in cols:
        q = F.col(f"__q_{c}")
        t = _between(c, F.get(q, 0), F.get(q, 1), k)
        cond = t if cond is None else (cond & t)
    return df.join(stats, keys).where(cond).drop(*[f"__q_{c}" for c in cols])


def iqr_sequential(df: DataFrame, cols: Sequence[str], k: float = 3.0,
                   skip_nonpositive_iqr: bool = False, exempt: Sequence[str] = (),
                   checkpoint_every: int = 10) -> DataFrame:
    """One column at a time, each fence computed on the survivors.

    Inherently sequential (column j's fence depends on the filter of
    column j-1), so it is a driver loop of scalar aggregates over a
    persisted input; the lineage is cut with a reliable checkpoint every
    ``checkpoint_every`` columns.  ``skip_nonpositive_iqr`` reproduces the
    guarded variant (k=3.5, iqr ≤ 0 or missing → column skipped).
    """
    cur = df.persist(StorageLevel.MEMORY_AND_DISK)
    todo = [c for c in cols if c in df.columns and c not in set(exempt)]
    rows = cur.count() if todo else 0  # fills the persisted input; later steps only have fewer
    for i, c in enumerate(todo):
        q1, q3 = quantiles(cur, {c: [0.25, 0.75]}, rows)[c] or (None, None)
        if skip_nonpositive_iqr:
            if q1 is None or q3 is None or not (q3 - q1 > 0):
                continue
        if q1 is None or q3 is None:
            cur = cur.where(F.lit(False))
            continue
        cur = cur.where(_between(c, F.lit(float(q1)), F.lit(float(q3)), k))
        if checkpoint_every and (i + 1) % checkpoint_every == 0:
            cur = cur.checkpoint(eager=True)
    return cur


def row_guard(df: DataFrame, min_rows: int, what: str = "rows") -> DataFrame:
    """Raise in the driver when fewer than ``min_rows`` rows survive."""
    n = df.count()
    if n < min_rows:
        raise ValueError(f"only {n} {what} (< {min_rows}) — check the clock overlap of the inputs")
    return df


# --- J1-J5: imputers and scalers (exact, SQL-expressible) ------------------

def impute_median(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Exact median fill (Spark ML's Imputer median is approximate)."""
    src = fit_on if fit_on is not None else df
    med = quantiles(src, {c: [0.5] for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c][0] if med[c] else None).cast("double")) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Constant 0 fill."""
    return df.fillna(0.0, subset=list(cols)) if cols else df.fillna(0.0)


def scale_standard(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                   suffix: str = "") -> DataFrame:
    """(x - mean) / population std; zero std → divide by 1."""
    src = fit_on if fit_on is not None else df
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    st = src.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = st[f"{c}__m"], st[f"{c}__s"]
        s = 1.0 if (s is None or s == 0) else s
        out[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(float(s))
    return df.withColumns(out)


def scale_robust(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                 suffix: str = "") -> DataFrame:
    """(x - median) / IQR with exact quantiles; zero IQR → divide by 1."""
    src = fit_on if fit_on is not None else df
    st = quantiles(src, {c: [0.25, 0.5, 0.75] for c in cols})
    out = {}
    for c in cols:
        q1, med, q3 = st[c]
        iqr = q3 - q1
        iqr = 1.0 if iqr == 0 else iqr
        out[c + suffix] = (F.col(c) - F.lit(float(med))) / F.lit(float(iqr))
    return df.withColumns(out)


def minmax_params(src: DataFrame, col: str) -> tuple[float, float]:
    r = src.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    return r["mn"], r["mx"]


def scale_minmax(df: DataFrame, col: str, fit_on: DataFrame | None = None,
                 out: str | None = None) -> DataFrame:
    """(x - min) / (max - min); constant column → 0."""
    mn, mx = minmax_params(fit_on if fit_on is not None else df, col)
    rng = (mx - mn) or 1.0
    return df.withColumn(out or col, (F.col(col) - F.lit(float(mn))) / F.lit(float(rng)))


def inverse_minmax(df: DataFrame, col: str, mn: float, mx: float, out: str | None = None) -> DataFrame:
    rng = (mx - mn) or 1.0
    return df.withColumn(out or col, F.col(col) * F.lit(float(rng)) + F.lit(float(mn)))
