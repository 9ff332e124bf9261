"""Quantiles between sketch brackets equal ``percentile``, and nothing outside a bracket is collected."""

import pytest
from pyspark.sql import functions as F

from tapline.operators import clean, selection

SHARES = [0.0, 0.01, 0.25, 0.33, 0.5, 0.66, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    n = 20_000
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    return spark.range(n).select(
        (-F.log(u + 1e-9) ** 3).alias("skewed"), F.floor(u * 3).cast("int").alias("ties"), F.when(u < 0.7, u * 100 - 50).alias("holes"),
        F.lit(4.5).alias("constant"), F.lit(None).cast("double").alias("empty"), F.when(F.col("id") < 7, F.col("id").cast("double")).alias("few"),
        F.when(u < 0.1, float("inf")).when(u < 0.2, float("-inf")).when(u < 0.3, float("nan")).otherwise(u).alias("ends"),
        F.when(u < 0.5, 0.0).otherwise(F.col("id").cast("double")).alias("half")).repartition(5).cache()


def same(table, shares, got):
    for c in table.columns:
        want = table.agg(F.percentile(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.array(*map(F.lit, shares))).alias("q")).first().q
        assert got[c] == (None if want is None else pytest.approx(list(want), rel=1e-12, nan_ok=True)), c


@pytest.mark.parametrize("keep", [1, 50, 3_000])
def test_equals_percentile(table, monkeypatch, keep):
    monkeypatch.setattr(selection, "KEEP", keep)
    same(table, SHARES, selection.quantiles(table, {c: SHARES for c in table.columns}))


def test_small_tables_take_one_aggregate(table):
    same(table, SHARES, selection.quantiles(table, {c: SHARES for c in table.columns}, rows=20_000))


def test_a_poor_sketch_only_costs_rounds(table, monkeypatch):
    """Brackets that miss their rank are found out by the counts."""
    monkeypatch.setattr(selection, "KEEP", 20)
    monkeypatch.setattr(selection, "SKETCH_K", 8)
    monkeypatch.setattr(selection, "MARGIN", 0.0005)
    rounds, narrow = [], selection._narrow
    monkeypatch.setattr(selection, "_narrow", lambda df, ranks: (rounds.append(len(ranks)), narrow(df, ranks)))
    same(table.select("skewed", "half"), [0.25, 0.9], selection.quantiles(table, {"skewed": [0.25, 0.9], "half": [0.25, 0.9]}))
    assert 1 < len(rounds) < 30


def test_brackets_shrink_fast(table, monkeypatch):
    monkeypatch.setattr(selection, "KEEP", 1_000)
    rounds, narrow = [], selection._narrow
    monkeypatch.setattr(selection, "_narrow", lambda df, ranks: (rounds.append(max(r.inside for r in ranks)), narrow(df, ranks)))
    selection.quantiles(table, {"skewed": [0.5]})
    assert rounds == [20_000]  # one round leaves about a fortieth


def test_fences_and_fills_are_the_same_beyond_the_bound(table, monkeypatch):
    cols = ["skewed", "half"]
    base = [clean.iqr_simultaneous(table, cols).count(), clean.iqr_sequential(table, cols).count(),
            clean.impute_median(table, ["holes"]).agg(F.sum("holes")).first()[0], clean.scale_robust(table, cols).agg(F.sum("skewed")).first()[0]]
    monkeypatch.setattr(selection, "KEEP", 200)
    beyond = [clean.iqr_simultaneous(table, cols).count(), clean.iqr_sequential(table, cols).count(),
              clean.impute_median(table, ["holes"]).agg(F.sum("holes")).first()[0], clean.scale_robust(table, cols).agg(F.sum("skewed")).first()[0]]
    assert beyond == pytest.approx(base, rel=1e-9)


def test_no_rows(spark):
    assert selection.quantiles(spark.createDataFrame([], "a double"), {"a": [0.5]}) == {"a": None}
    assert selection.quantiles(spark.range(3), {}) == {}
