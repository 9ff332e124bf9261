"""Exact quantiles of columns of any size, selected between brackets that mergeable sketches give.

A KLL sketch per column (combined before the shuffle, a few kilobytes each)
gives two values around every wanted rank; a scan counts the rows below and
between them, which proves the bracket.  What lies between is sketched again
until at most ``KEEP`` values are left, and only those are collected and sorted
in one aggregate.  So no value outside a bracket is ever shuffled, no task holds
more than ``KEEP`` values a rank, and the result equals ``percentile``.

NULL and NaN count as missing.  Ties: a rank that falls on a bracket's end is
that value.  A column without values has no quantiles (None).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a column that one aggregate may buffer.
KEEP = 100_000
#: Size of the sketches and the share of rows a bracket reaches to either side of its rank, about three times their rank error.
SKETCH_K, MARGIN = 800, 0.012


@dataclass
class _Rank:
    """A wanted order statistic: it lies above ``lo`` and below ``hi`` (open ends; None is unbounded), ``below`` rows do not exceed lo."""

    column: str
    rank: int
    inside: int
    below: int = 0
    lo: float | None = None
    hi: float | None = None
    margin: float = MARGIN
    value: float | None = None

    def within(self, x: Column) -> Column:
        """x where it lies in the bracket, else NULL."""
        ok = F.lit(True)
        if self.lo is not None:
            ok = ok & (x > F.lit(self.lo))
        if self.hi is not None:
            ok = ok & (x < F.lit(self.hi))
        return F.when(ok, x)


def _value(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _narrow(df: DataFrame, ranks: list[_Rank]) -> None:
    """One round: sketch every bracket, then count at its new ends."""
    shares = [((r.rank - r.below) / r.inside - r.margin, (r.rank - r.below + 1) / r.inside + r.margin) for r in ranks]
    ends = df.agg(*[F.kll_sketch_get_quantile_double(
        F.kll_sketch_agg_double(r.within(_value(r.column)), F.lit(SKETCH_K)),
        F.array(F.lit(float(max(0.0, lo))), F.lit(float(min(1.0, hi))))).alias(f"q{i}") for i, (r, (lo, hi)) in enumerate(zip(ranks, shares))]).first()
    new = [(float(ends[i][0]), float(ends[i][1])) for i in range(len(ranks))]
    aggs = []
    for i, (r, (lo, hi)) in enumerate(zip(ranks, new)):
        x = _value(r.column)
        aggs += [F.count_if(x < F.lit(lo)).alias(f"b{i}"), F.count_if(x == F.lit(lo)).alias(f"l{i}"),
                 F.count_if(x == F.lit(hi)).alias(f"h{i}"), F.count_if((x > F.lit(lo)) & (x < F.lit(hi))).alias(f"m{i}")]
    row = df.agg(*aggs).first()
    for i, (r, (lo, hi)) in enumerate(zip(ranks, new)):
        at, at_lo, between, at_hi = r.rank - row[f"b{i}"], row[f"l{i}"], row[f"m{i}"], row[f"h{i}"] if lo < hi else 0
        if 0 <= at < at_lo:
            r.value = lo
        elif at_lo <= at < at_lo + between:
            r.lo, r.hi, r.below, r.inside, r.margin = lo, hi, row[f"b{i}"] + at_lo, between, MARGIN
        elif 0 <= at < at_lo + between + at_hi:
            r.value = hi
        else:  # the sketch was off by more than the margin: a wider bracket next time
            r.margin *= 4


def order_statistics(df: DataFrame, wanted: Mapping[str, Sequence[int]], sizes: Mapping[str, int]) -> dict[tuple[str, int], float]:
    """{(column, rank): value} for ranks counted from 0 among a column's ``sizes`` values."""
    ranks = [_Rank(c, k, sizes[c]) for c, ks in wanted.items() for k in sorted(set(ks))]
    while wide := [r for r in ranks if r.value is None and r.inside > KEEP]:
        _narrow(df, wide)
    last = [r for r in ranks if r.value is None]
    if last:
        row = df.agg(*[F.element_at(F.sort_array(F.collect_list(r.within(_value(r.column)))), F.lit(r.rank - r.below + 1)).alias(f"v{i}")
                       for i, r in enumerate(last)]).first()
        for i, r in enumerate(last):
            r.value = float(row[f"v{i}"])
    return {(r.column, r.rank): r.value for r in ranks}


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], rows: int | None = None) -> dict[str, list[float] | None]:
    """Interpolated quantiles like ``percentile``: {column: one value per share, or None without values}.

    ``rows`` is an upper bound on the table's rows where the caller knows one.
    With at most KEEP values a column, one aggregate does it all.
    """
    wanted = {c: [float(p) for p in ps] for c, ps in wanted.items() if len(ps)}
    if not wanted:
        return {}
    sizes = None
    if rows is None or rows > KEEP:
        first = df.agg(*[F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
        sizes = {c: first[f"n{i}"] for i, c in enumerate(wanted)}
    if sizes is None or max(sizes.values()) <= KEEP:
        row = df.agg(*[F.percentile(_value(c), F.array(*[F.lit(p) for p in ps])).alias(f"q{i}") for i, (c, ps) in enumerate(wanted.items())]).first()
        return {c: None if row[f"q{i}"] is None else [float(v) for v in row[f"q{i}"]] for i, c in enumerate(wanted)}
    places = {c: [p * (sizes[c] - 1) for p in ps] for c, ps in wanted.items() if sizes[c]}
    found = order_statistics(df, {c: [f(x) for x in xs for f in (math.floor, math.ceil)] for c, xs in places.items()}, sizes)
    out: dict[str, list[float] | None] = {c: None for c in wanted}
    for c, xs in places.items():
        out[c] = []
        for x in xs:
            low, high = found[c, math.floor(x)], found[c, math.ceil(x)]
            out[c].append(low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high)
    return out
