"""Sorts, top-k, best-of and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggs import _by


def sort_clock(df: DataFrame, clock: str = "clock") -> DataFrame:
    """G1: global sort (range-partitioned by Spark)."""
    return df.orderBy(clock)


def head_n(df: DataFrame, n: int, order: Sequence[str] | str = "clock") -> DataFrame:
    """First n rows in order (TakeOrderedAndProject: a per-task top-n)."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)


def topk_per_group(df: DataFrame, k: int, by, order_col: str, desc: bool = True,
                   tie: str | None = None, out: str = "rank") -> DataFrame:
    """Top-k rows per group by ``order_col`` (window only on that table)."""
    o = [F.col(order_col).desc() if desc else F.col(order_col).asc()]
    if tie:
        o.append(F.col(tie).asc())
    w = Window.partitionBy(*_by(by)).orderBy(*o)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def _key(c, digits):
    return F.round(c, digits) if digits is not None else c


def topk_abs(df: DataFrame, k: int, col: str, by=None, tie: str | None = None,
             out: str = "rank", digits: int | None = None) -> DataFrame:
    """Top-k by absolute value (``digits`` makes float-noise ties exact)."""
    o = [_key(F.abs(F.col(col)), digits).desc()] + ([F.col(tie).asc()] if tie else [])
    keys = _by(by)
    w = Window.partitionBy(*keys).orderBy(*o) if keys else Window.orderBy(*o)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def best_model(df: DataFrame, by, metric: str, order_col: str = "model_order",
               model_col: str = "model") -> DataFrame:
    """Arg-max of ``metric`` per group; the first listed model wins ties."""
    w = Window.partitionBy(*_by(by)).orderBy(F.col(metric).desc(), F.col(order_col).asc())
    return (df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
              .select(*_by(by), F.col(model_col).alias("best_model"), F.col(metric)))


def importance_table(df: DataFrame, feature: str = "feature", imp: str = "importance",
                     by=None, digits: int | None = None) -> DataFrame:
    """Ranking with percent score rounded to 2 digits."""
    keys = _by(by)
    o = [_key(F.col(imp), digits).desc(), F.col(feature).asc()]
    w = Window.partitionBy(*keys).orderBy(*o) if keys else Window.orderBy(*o)
    return df.select(*keys, feature, imp, F.row_number().over(w).alias("rank"),
                     F.round(F.col(imp) * 100, 2).alias("score_pct"))


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """H1: union matching columns by name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def ordered_union(lists: Sequence[DataFrame], item: str = "feature", pos: str = "pos") -> DataFrame:
    """H2: order-preserving distinct union of ranked lists (first occurrence wins)."""
    tagged = [d.select(F.col(item), F.lit(i).alias("__list"), F.col(pos)) for i, d in enumerate(lists)]
    u = union_by_name(*tagged)
    first = u.groupBy(item).agg(F.min(F.struct("__list", pos)).alias("__f"))
    w = Window.orderBy(F.col("__f.__list"), F.col(f"__f.{pos}"))
    # the window runs on the de-duplicated list (feature names), not on data rows
    return first.select(item, F.row_number().over(w).alias("order_no"))


def distinct_by_key(df: DataFrame, key, order_col: str, keep: str = "last") -> DataFrame:
    """H3: one row per key; ``keep='last'`` lets the highest ``order_col`` win."""
    o = F.col(order_col).desc() if keep == "last" else F.col(order_col).asc()
    w = Window.partitionBy(*_by(key)).orderBy(o)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
