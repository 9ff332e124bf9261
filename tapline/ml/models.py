"""Model training on the clock-aligned feature table.

The estimators are Spark ML's (distributed tree/linear learners) and the
histogram boosting of ``boosting``.  Exact
preprocessing (median fill, population-std scaling) is done with SQL
aggregates so the numbers match the source's definitions; the fitted
preprocessing and model go into one ``PipelineModel`` that can be saved
to and loaded from the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import NewtonBoosting

# --------------------------------------------------------------- preprocessing


@dataclass
class Prep:
    """Exact median fill + population-std scaling, as a SQL transform."""
    features: list[str]
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], scale: bool = True) -> "Prep":
        feats = list(features)
        aggs = [F.median(c).alias(f"md_{i}") for i, c in enumerate(feats)]
        r = df.agg(*aggs).first()
        med = {c: (r[f"md_{i}"] if r[f"md_{i}"] is not None else 0.0) for i, c in enumerate(feats)}
        filled = {c: F.coalesce(F.col(c), F.lit(float(med[c]))) for c in feats}
        if scale:
            s = df.agg(*[F.avg(filled[c]).alias(f"m_{i}") for i, c in enumerate(feats)],
                       *[F.stddev_pop(filled[c]).alias(f"s_{i}") for i, c in enumerate(feats)]).first()
            means = {c: float(s[f"m_{i}"] or 0.0) for i, c in enumerate(feats)}
            stds = {c: float(s[f"s_{i}"] or 0.0) or 1.0 for i, c in enumerate(feats)}
        else:
            means = {c: 0.0 for c in feats}
            stds = {c: 1.0 for c in feats}
        return cls(feats, med, means, stds)

    def sql(self) -> SQLTransformer:
        exprs = [f"((coalesce(`{c}`, {float(self.medians[c])!r}) - {self.means[c]!r}) / {self.stds[c]!r}) as `z_{c}`"
                 for c in self.features]
        return SQLTransformer(statement="select *, " + ", ".join(exprs) + " from __THIS__")

    def zcols(self) -> list[str]:
        return [f"z_{c}" for c in self.features]


def assemble(prep: Prep, out: str = "features") -> list:
    return [prep.sql(), VectorAssembler(inputCols=prep.zcols(), outputCol=out, handleInvalid="keep")]


# --------------------------------------------------------------- estimators
# Candidate sizes are the source's (regression: RF 200×10, GBM 150×5 lr .08).

def ridge(label: str, alpha: float = 1.0, n: int = 1, y_std: float = 1.0):
    """K1: ridge = ‖y − Xβ‖² + α‖β‖².

    Spark's normal-equation solver works on the standardised label and divides
    the penalty by its (population) std, so the matching per-row parameter is
    regParam = α·σ_y / n.
    """
    return LinearRegression(featuresCol="features", labelCol=label, regParam=alpha * y_std / max(n, 1),
                            elasticNetParam=0.0, standardization=False, solver="normal")


def rf_reg(label: str, trees: int = 200, depth: int = 10, min_leaf: int = 1, seed: int = 42):
    return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth,
                                 minInstancesPerNode=min_leaf, seed=seed)


def gbt_reg(label: str, iters: int = 150, depth: int = 5, lr: float = 0.08, sub: float = 1.0, l2: float = 0.0, seed: int = 42):
    """K3: histogram Newton boosting of the squared error; ``l2`` = 0 is plain gradient boosting."""
    return NewtonBoosting(label, "squared", trees=iters, depth=depth, rate=lr, rows=sub, l2=l2, seed=seed)


def rf_cls(label: str, trees: int = 200, depth: int = 10, seed: int = 42, weight: str | None = None):
    est = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return est.setWeightCol(weight) if weight else est


def gbt_cls(label: str, iters: int = 150, depth: int = 5, lr: float = 0.08, classes: int = 3, seed: int = 42):
    """K5: softmax Newton boosting; the trees of all classes grow in the same passes."""
    return NewtonBoosting(label, "softmax", classes=classes, trees=iters, depth=depth, rate=lr, seed=seed)


def logreg(label: str, C: float = 1.0, n: int = 1):
    """K6: multinomial logistic regression; sklearn C ↔ regParam = 1/(C·n)."""
    return LogisticRegression(featuresCol="features", labelCol=label, family="multinomial",
                              regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False)


def tree_cls(label: str, depth: int = 8, min_leaf: int = 5, seed: int = 42):
    return DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=depth,
                                  minInstancesPerNode=min_leaf, seed=seed)


def mlp_cls(label: str, n_in: int, n_out: int = 3, hidden=(128, 64, 32), seed: int = 42):
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                          layers=[n_in, *hidden, n_out], seed=seed, maxIter=200)


class PresentOneVsRest(Estimator):
    """One-vs-rest over the classes that have training rows; ``OneVsRest`` itself fails on a class without any.

    A class no training row has is never predicted; one class alone is predicted for every
    row.  The result is made of Spark ML's own stages, so it is saved like any pipeline.
    """

    def __init__(self, classifier, features: str, label: str, parallelism: int = 3):
        super().__init__()
        self.classifier, self.features, self.label, self.parallelism = classifier, features, label, parallelism

    def _fit(self, df: DataFrame) -> PipelineModel:
        present = sorted(r[0] for r in df.select(F.col(self.label).cast("double")).distinct().collect() if r[0] is not None)  # label set only
        if not present:
            raise ValueError(f"no row with a label in {self.label!r} to train on")
        if len(present) == 1:
            return PipelineModel([SQLTransformer(statement=f"select *, {present[0]!r}D as prediction from __THIS__")])
        codes = F.create_map(*[x for i, c in enumerate(present) for x in (F.lit(c), F.lit(float(i)))])
        data = df.withColumn("__code", F.try_element_at(codes, F.col(self.label).cast("double"))).where("__code is not null")
        ovr = OneVsRest(classifier=self.classifier, featuresCol=self.features, labelCol="__code", predictionCol="__place", parallelism=self.parallelism)
        names = ", ".join(f"{c!r}D" for c in present)
        back = SQLTransformer(statement=f"select * except (__place), element_at(array({names}), cast(__place as int) + 1) as prediction from __THIS__")
        return PipelineModel([ovr.fit(data), back])


def svm_cls(label: str, C: float = 10.0, n: int = 1, features: str = "kernel"):
    """K9: max-margin classifier, linear in ``features`` (approximate kernel or degree-2 features), one-vs-rest."""
    return PresentOneVsRest(LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=100), features, label, parallelism=3)


def fit(train: DataFrame, prep: Prep, estimator, extra_stages: Sequence = ()) -> PipelineModel:
    return Pipeline(stages=[*assemble(prep), *extra_stages, estimator]).fit(train)


# --------------------------------------------------------------- model facts

def forest_model(pm: PipelineModel):
    return pm.stages[-1]


def importances(pm: PipelineModel, prep: Prep) -> list[tuple[str, float]]:
    m = pm.stages[-1]
    imp = m.featureImportances.toArray() if hasattr(m, "featureImportances") else None
    if imp is None:
        return []
    return list(zip(prep.features, [float(v) for v in imp]))


def top_features(pm: PipelineModel, prep: Prep, k: int = 9) -> list[str]:
    """Top-k by importance (ties by name)."""
    return [f for f, _ in sorted(importances(pm, prep), key=lambda t: (-t[1], t[0]))[:k]]


def _debug_lines(debug: str):
    """(indent, kind, text) for each node line of a tree's ``toDebugString``."""
    import re
    out = []
    for line in debug.splitlines():
        t = line.strip()
        ind = len(line) - len(line.lstrip())
        if t.startswith("If ("):
            out.append((ind, "if", t[4:-1]))
        elif t.startswith("Else ("):
            out.append((ind, "else", t[6:-1]))
        elif t.startswith("Predict:"):
            out.append((ind, "leaf", float(re.sub(r"[^0-9eE+\-.]", "", t.split(":", 1)[1]))))
    return out


def tree_rules(dt_model, features: Sequence[str], max_depth: int = 5) -> list[tuple[int, int, str, float]]:
    """K7: one readable rule per leaf path (depth ≤ ``max_depth`` kept by the caller)."""
    import re
    rules, stack = [], []
    for ind, kind, text in _debug_lines(dt_model.toDebugString):
        while stack and stack[-1][0] >= ind:
            stack.pop()
        if kind in ("if", "else"):
            cond = re.sub(r"feature (\d+)", lambda m: features[int(m.group(1))], text)
            stack.append((ind, cond))
        else:
            path = [c for _, c in stack]
            if len(path) <= max_depth:
                rules.append((len(rules) + 1, len(path), " AND ".join(path) or "(root)", text))
    return rules


def leaf_values(rf_model) -> list[list[float]]:
    """Per tree the predictions of its leaves from left to right, as ``leafCol`` numbers them; sized by the model."""
    import re
    return [[float(v) for v in re.findall(r"Predict: ([0-9eE+\-.]+)", tree.toDebugString)] for tree in rf_model.trees]


def forest_leaf_values(spark, rf_model) -> DataFrame:
    """(tree, leaf_no) → leaf prediction, leaves numbered left to right.

    This numbering is the one ``leafCol`` reports.  Size is bounded by the
    model (trees × 2^depth), never by data.
    """
    rows = [(t, i, v) for t, leaves in enumerate(leaf_values(rf_model)) for i, v in enumerate(leaves)]
    return spark.createDataFrame(rows, "tree int, leaf int, value double")


def forest_interval(spark, pm: PipelineModel, df: DataFrame, lo: float = 2.5, hi: float = 97.5,
                    out: str = "pi") -> DataFrame:
    """Percentile interval of the per-tree predictions (plus their mean and std).

    ``leafCol`` yields one leaf index per tree.  The (tree × leaf) value
    table is model-sized (trees × 2^depth), shipped once as a broadcast
    variable, and looked up per Arrow batch with numpy fancy indexing
    inside ``mapInPandas`` — no explode, no shuffle of the scored rows.
    """
    import numpy as np
    import pandas as pd

    rf = forest_model(pm)
    rf.setLeafCol("__leaf")
    scored = pm.transform(df).withColumn("__li", vector_to_array("__leaf")).drop("__leaf")
    rf.setLeafCol("")
    vals = leaf_values(rf)
    lut = np.full((len(vals), max(map(len, vals))), np.nan)
    for t, leaves in enumerate(vals):
        lut[t, :len(leaves)] = leaves
    blut = spark.sparkContext.broadcast(lut)
    cols = [f for f in scored.schema.fields if f.name != "__li"]
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType(cols + [StructField(f"{out}_lo", DoubleType()), StructField(f"{out}_hi", DoubleType()),
                                StructField("tree_mean", DoubleType()), StructField("tree_std", DoubleType())])
    names = [f.name for f in cols]

    def per_batch(it):
        table = blut.value
        rows = np.arange(table.shape[0])
        for pdf in it:
            if len(pdf) == 0:
                continue
            idx = np.stack(pdf["__li"].to_numpy()).astype(int)  # batch × trees
            pt = table[rows[None, :], idx]
            o = pdf[names].copy()
            o[f"{out}_lo"] = np.percentile(pt, lo, axis=1)
            o[f"{out}_hi"] = np.percentile(pt, hi, axis=1)
            o["tree_mean"] = pt.mean(axis=1)
            o["tree_std"] = pt.std(axis=1)
            yield o
    return scored.mapInPandas(per_batch, schema)


def probability_map(df: DataFrame, labels: Sequence[str], prob_col: str = "probability",
                    out: str = "probabilities") -> DataFrame:
    """O2: class → probability map from the probability vector."""
    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), vector_to_array(prob_col)))


def poly_stage():
    return PolynomialExpansion(degree=2, inputCol="features", outputCol="poly")
