"""Training-set preparation (J6-J12): encoding, splits, class weights, SMOTE.

Splits are deterministic functions of a row key (md5), so they are
stable under repartitioning and executor loss.  Exact per-class counts use
the distributed ``prefix_sum`` (range-partitioned running counts) instead of
a per-class window, so one dominant class never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import prefix_sum
from .neighbours import nearest


def key_hash(key_cols: Sequence[str], seed: int = 42) -> F.Column:
    """md5 of the key's text and the seed: an order any engine can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))


def hash_unit(key_cols: Sequence[str], seed: int = 42) -> F.Column:
    """Uniform [0, 1): the first 52 bits of ``key_hash``."""
    return F.conv(F.substring(key_hash(key_cols, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _by_class(df: DataFrame, label: str, order: Sequence, out: str, total: str | None = None) -> DataFrame:
    """0-based position of each row in its class (a NULL label is a class) and, if asked, the class size; distributed."""
    x = prefix_sum(df.withColumn("__one", F.lit(1)), order[0], ["__one"], by=label, inclusive=False, fmt=out, total_fmt=total, tiebreak=order[1:])
    return x.drop("__one")


def _hash_order(df: DataFrame, key_cols: Sequence[str], seed: int) -> DataFrame:
    """``__h``: the whole hash of the key; callers order by it, then by the key."""
    return df.withColumn("__h", key_hash(key_cols, seed))


def label_encode(df: DataFrame, col: str, out: str | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """Alphabetical label codes (High=0, Low=1, Normal=2) as a SQL twin of StringIndexer."""
    out = out or f"{col}_idx"
    if labels is None:
        labels = sorted(r[0] for r in df.select(col).distinct().collect() if r[0] is not None)  # label set only
    m = F.create_map(*[x for i, lab in enumerate(sorted(labels)) for x in (F.lit(lab), F.lit(i))])
    return df.withColumn(out, F.try_element_at(m, F.col(col)))


def label_decode(df: DataFrame, col: str, labels: Sequence[str], out: str) -> DataFrame:
    """J6 inverse: alphabetical code → label; a code without a label → NULL."""
    names = F.array(*[F.lit(x) for x in sorted(labels)])
    code = F.col(col).cast("int")
    return df.withColumn(out, F.when(code >= 0, F.get(names, code)))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k · n_c) attached to every row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("n"), F.count(F.lit(1)).alias("k")).first()
    w = counts.withColumn(out, F.lit(float(tot["n"])) / (F.lit(float(tot["k"])) * F.col("__nc"))).drop("__nc")
    w = w.withColumnRenamed(label, "__label")
    # one row per class; adaptive execution broadcasts it when it is small
    return df.join(w, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


def random_split(df: DataFrame, key_cols: Sequence[str], train_frac: float = 0.8, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Hash split, stable under repartitioning (unlike randomSplit)."""
    return df.withColumn(out, F.when(hash_unit(key_cols, seed) < train_frac, "train").otherwise("test"))


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str], train_frac: float = 0.8,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """Exactly floor(frac·n_c) rows of every class go to train (hash order inside a class)."""
    x = _by_class(_hash_order(df, key_cols, seed), label, ["__h", *key_cols], "__g", "__nc")
    return x.withColumn(out, F.when(F.col("__g") < F.floor(F.col("__nc") * train_frac), "train").otherwise("test")) \
        .drop("__h", "__g", "__nc")


def kfold_ids(df: DataFrame, k: int, key_cols: Sequence[str], label: str | None = None, seed: int = 42,
              out: str = "fold") -> DataFrame:
    """Shuffled (optionally stratified) fold ids 0..k-1 from hash order."""
    if label is None:
        return df.withColumn(out, F.floor(hash_unit(key_cols, seed) * k).cast("int"))
    x = _by_class(_hash_order(df, key_cols, seed), label, ["__h", *key_cols], "__g")
    return x.withColumn(out, (F.col("__g") % k).cast("int")).drop("__h", "__g")


# --------------------------------------------------------------------- SMOTE

def smote(df: DataFrame, label: str, key: str, feats: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Oversample every minority class to the majority size by interpolating towards
    one of the k nearest same-class neighbours (features already scaled).

    Output = original rows (``synthetic=false``) + synthetic rows.  Each
    minority row gets floor(need/n_c) children, and the first need % n_c
    rows in hash order one more, so the class sizes come out exact.  A minority
    class with one complete row has no neighbour to move towards: ValueError.
    Rows with a NULL label pass through and are no class.
    """
    counted = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(sum((F.col(f).isNull().cast("int") for f in feats), F.lit(0)).cast("boolean").cast("int")).alias("bad"))
    rows = list(counted.toLocalIterator())  # the label set
    counts = {r[0]: r["n"] for r in rows}
    n_max = max(counts.values(), default=0)
    need = {c: n_max - n for c, n in counts.items() if n < n_max}
    lone = [r[0] for r in rows if r[0] in need and r["n"] - r["bad"] < 2]
    if lone:
        raise ValueError(f"SMOTE needs at least two complete rows of every minority class; too few of {lone}")
    base = df.select(key, label, *feats).withColumn("synthetic", F.lit(False))
    if not need:
        return base
    minority = df.where(F.col(label).isin(list(need))).select(key, label, *feats)
    nn = nearest(minority, label, key, feats, k)
    # per-row child counts with exact class totals
    x = minority.withColumn("__u", hash_unit([key], seed))
    rk = stratified_rank(x, label, "__u", key)
    cnt_map = F.create_map(*[v for c, n in counts.items() if c in need for v in (F.lit(c), F.lit(n))])
    need_map = F.create_map(*[v for c, n in need.items() for v in (F.lit(c), F.lit(n))])
    nc, nd = F.try_element_at(cnt_map, F.col(label)), F.try_element_at(need_map, F.col(label))
    rk = rk.withColumn("__m", F.floor(nd / nc) + F.when(F.col("__r") < nd % nc, 1).otherwise(0))
    kids = rk.where(F.col("__m") > 0).select(key, label, *feats, F.explode(F.sequence(F.lit(1), F.col("__m").cast("int"))).alias("__c"))
    kids = kids.withColumn("__j", (F.floor(hash_unit([key, "__c"], seed + 1) * k) + 1).cast("int")) \
        .withColumn("__lam", hash_unit([key, "__c"], seed + 2))
    nbr = nn.select(key, F.col("__rk").alias("__j"), *[F.col(f).alias(f"nb_{f}") for f in feats])
    # a row with fewer than k neighbours uses its last available one
    nmax = nn.groupBy(key).agg(F.max("__rk").alias("__jmax"))
    kids = kids.join(nmax, key).withColumn("__j", F.least("__j", "__jmax")).join(nbr, [key, "__j"])
    syn = kids.select(F.concat_ws("#", F.col(key).cast("string"), F.col("__c").cast("string")).alias(key), label,
                      *[(F.col(f) + F.col("__lam") * (F.col(f"nb_{f}") - F.col(f))).alias(f) for f in feats],
                      F.lit(True).alias("synthetic"))
    return base.withColumn(key, F.col(key).cast("string")).unionByName(syn)


def stratified_rank(df: DataFrame, label: str, order_col: str, key: str, out: str = "__r") -> DataFrame:
    """0-based rank of each row inside its class by ``order_col``, ties by ``key`` (distributed)."""
    return _by_class(df, label, [order_col, key], out)
