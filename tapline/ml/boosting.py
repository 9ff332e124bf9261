"""Histogram Newton boosting as Spark jobs (K3, K5).

Features are binned once by quantile sketches and kept as blocks of up to 65,536 rows.
Up to ``LONE`` blocks one task grows all rounds and sends the driver their splits. With more
a tree grows level by level: every block sums gradients and Hessians per (class, node,
feature, bin); the blocks' sums of a node meet in one task, which picks its split, for all
classes of a round in the same pass. The driver sees one split a node and sends the splits
along with the next pass, so what it holds does not depend on rows, blocks or bins. Leaf
values come out of the last level's histograms. Margins live beside the blocks and are
renewed and checkpointed every ``REFRESH`` rounds, which also cuts the lineage; in between a
pass replays the few trees grown since. Blocks and margins are a stored table, not a cached
Python RDD: a task needs one Python worker, where filling such a cache takes two. A scored
row passes one Python function once, and no worker loads pandas: an executor keeps a worker
a core for the passes and one for packing and scoring, each of the size of its libraries.

Rows with a NULL or NaN label, or without a positive weight, do not train. A NaN feature
goes right at every split. A table without training rows is a ValueError; a class no row
has keeps a probability near 0. Equal gains take the first feature and bin, so repeated
rows only add weight, and refits of a stored table give the same model.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import arrowrows as A
from . import histograms as H
from .histograms import grow as _grow

BLOCK = 65_536
REFRESH = 10
#: Up to so many blocks one task grows all rounds: the jobs of a level take longer than its sums over these rows.
LONE = 3


# ---------------------------------------------------------------------- blocks

def _edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Ascending upper bin edges of every feature: all gaps of a feature with few values, quantiles otherwise."""
    cols = rows.select(*[F.col("x")[i].alias(f"f{i}") for i in range(width)])
    at = [k / bins for k in range(1, bins)]
    found = cols.approxQuantile(cols.columns, at, 0.1 / bins) if width else []
    return [np.unique(np.array(q, float)) if q else np.zeros(0) for q in found]


#: A packed block: its name, then bins (a feature after the other), labels, weights and margins as bytes.
PACKED = "part int, number int, bins binary, y binary, w binary, margin binary"


def _blocks(rows: DataFrame, edges: list[np.ndarray], base: np.ndarray) -> DataFrame:
    """A stored table of packed blocks, every margin at ``base``."""
    block = BLOCK

    def pack(batches):
        from pyspark import TaskContext
        part, number, held = TaskContext.get().partitionId(), 0, []

        def row():
            x, y, w = (np.concatenate(a) for a in zip(*held))
            ids = [A.cell(pa.int32(), np.int32(i).tobytes()) for i in (part, number)]
            content = (H.binned(x, edges).T.tobytes(), y.tobytes(), w.tobytes(), np.tile(base, (len(y), 1)).tobytes())
            return pa.RecordBatch.from_arrays([*ids, *(A.cell(pa.binary(), b) for b in content)], ["part", "number", "bins", "y", "w", "margin"])
        for batch in batches:
            x = A.vectors(batch.column("x"), len(edges))
            y, w = (A.floats(batch.column(c)) for c in ("y", "w"))
            for at in range(0, len(y), block):
                piece = tuple(a[at:at + block] for a in (x, y, w))
                if held and sum(len(h[1]) for h in held) + len(piece[1]) > block:
                    yield row()
                    number, held = number + 1, []
                held.append(piece)
        if held:
            yield row()

    return _kept(rows.mapInArrow(pack, PACKED))


def _kept(table: DataFrame) -> DataFrame:
    """The table checkpointed, and held in memory from the first pass on."""
    return table.checkpoint().persist(StorageLevel.MEMORY_AND_DISK)


# ------------------------------------------------------------------- estimator

class NewtonBoosting(Estimator):
    """Boosted trees by histograms. ``loss``: ``squared`` or ``softmax`` (labels 0 .. classes-1).

    ``rows`` and ``columns`` are the shares drawn for every tree, ``l2`` the ridge penalty on
    leaf values, ``min_child`` the least Hessian of a child, ``min_gain`` the least gain of a split.
    """

    def __init__(self, label: str, loss: str = "squared", classes: int = 1, trees: int = 150, depth: int = 5, rate: float = 0.08,
                 rows: float = 1.0, columns: float = 1.0, l2: float = 1.0, min_child: float = 1.0, min_gain: float = 0.0,
                 bins: int = 64, seed: int = 42, weight: str | None = None, features: str = "features"):
        super().__init__()
        if loss not in ("squared", "softmax") or not 2 <= bins <= 256 or not 0 < rows <= 1 or not 0 < columns <= 1:
            raise ValueError("loss: squared or softmax; bins: 2 to 256; rows and columns: above 0, up to 1")
        self.label, self.weight, self.features = label, weight, features
        self.cfg = dict(loss=loss, outputs=1 if loss == "squared" else classes, trees=trees, depth=depth, rate=rate, rows=rows,
                        columns=columns, l2=l2, min_child=min_child, min_gain=min_gain, bins=bins, seed=seed)

    def _fit(self, df: DataFrame) -> "NewtonBoostingModel":
        cfg, spark = self.cfg, df.sparkSession
        ensure_checkpoint_dir(spark)
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), weight.alias("w"))
        rows = rows.where("y is not null and not isnan(y) and w > 0").persist(StorageLevel.MEMORY_AND_DISK)
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.min("y").alias("lo"), F.max("y").alias("hi"),
                         F.sum("w").alias("w"), F.sum(F.col("y") * F.col("w")).alias("wy"),
                         *[F.sum(F.when(F.col("y") == k, F.col("w"))).alias(f"c{k}") for k in range(cfg["outputs"])]).first()
        if not total["n"]:
            raise ValueError(f"no row with a label in {self.label!r} to train on")
        if cfg["loss"] == "softmax":
            if total["lo"] < 0 or total["hi"] >= cfg["outputs"]:
                raise ValueError(f"labels must lie in 0 .. {cfg['outputs'] - 1}")
            base = np.log([max(total[f"c{k}"] or 0.0, 1e-6) / total["w"] for k in range(cfg["outputs"])])
        else:
            base = np.array([total["wy"] / total["w"]])
        edges = _edges(rows, total["d"], cfg["bins"])
        # a small table needs no more tasks than it has blocks, a large one in few partitions as many
        parts = max(1, -(-total["n"] // BLOCK))
        parts = 1 if parts <= LONE else parts
        state = _blocks(rows.coalesce(parts) if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts), edges, base)
        done, recent, gains, depth = [], [], np.zeros(len(edges)), cfg["depth"]
        allowed = _allowed(cfg, len(edges))
        lone = _lone(state, cfg, allowed) if state.rdd.getNumPartitions() == 1 else None
        for number in range(cfg["trees"]):
            trees = H.empty(depth, len(base))
            for level in range(depth):
                found = lone[number][level] if lone else _level(state, recent, trees, level, cfg, number, allowed[number])
                if not _grow(trees, found, level, cfg, gains):
                    break
            done.append(trees)
            recent = recent + [trees]
            if len(recent) == REFRESH and number + 1 < cfg["trees"] and not lone:
                state = _renewed(state, recent, depth)
                recent = []
        state.unpersist()
        rows.unpersist()
        forest = {"loss": cfg["loss"], "depth": depth, "base": base.tolist(), "edges": [e.tolist() for e in edges], "gains": gains.tolist(),
                  "rounds": [[[a.tolist() for a in tree] for tree in trees] for trees in done]}
        return NewtonBoostingModel(forest=json.dumps(forest), features=self.features)


def _allowed(cfg: dict, width: int) -> list:
    """Per round and output, the features drawn for the tree."""
    out, take = [], max(1, round(cfg["columns"] * width))
    for number in range(cfg["trees"]):
        draw = np.random.default_rng([cfg["seed"], number])
        out.append([np.isin(np.arange(width), draw.permutation(width)[:take]) for _ in range(cfg["outputs"])])
    return out


def _lone(state: DataFrame, cfg: dict, allowed: list) -> list:
    """Per round and level, ``best`` of every node, of a table in one partition: one task grows all rounds."""
    def run(items):
        blocks = [H.unpacked(item, cfg["outputs"]) for item in items]
        return H.rounds(blocks, cfg, allowed) if blocks else ()
    return state.rdd.mapPartitions(run).collect()


def _level(state, recent, trees, level, cfg, number, allowed) -> dict:
    """``best`` of every node of a level, found where the histograms are summed: the driver never holds a histogram.

    A partition sums its blocks; the parts of a node meet in one task, in the order of
    their partitions.
    """
    depth, packed = cfg["depth"], state.rdd

    def sums(part, items):
        total = None
        for item in items:
            block, margin = H.unpacked(item, len(trees))
            one = H.histogram(block, H.margins(margin, recent, block[1], depth), trees, level, cfg, number)
            total = one if total is None else total + one
        if total is not None:
            for node, hist in H.nodes(total):
                yield node, (part, hist)

    def best(item):
        (k, i), parts = item
        hist = None
        for _, one in sorted(parts, key=lambda p: p[0]):
            hist = one if hist is None else hist + one
        return (k, i), H.best(hist[0], hist[1], cfg, allowed[k])

    found = packed.mapPartitionsWithIndex(sums).groupByKey(max(1, min(packed.getNumPartitions(), len(trees) * 2 ** level)))
    return dict(found.map(best).collect())


def _renewed(state: DataFrame, recent, depth: int) -> DataFrame:
    """The blocks with the recent trees added to their margins; checkpointed, so that no pass reaches back further."""
    outputs = len(recent[0])

    def renew(r):
        block, margin = H.unpacked(r, outputs)
        return r["part"], r["number"], r["bins"], r["y"], r["w"], H.margins(margin, recent, block[1], depth).tobytes()
    fresh = _kept(state.sparkSession.createDataFrame(state.rdd.map(renew), PACKED, verifySchema=False))
    state.unpersist()
    return fresh


class NewtonBoostingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; adds ``prediction`` and, for classes, ``rawPrediction`` and ``probability``. Saved as one JSON parameter."""

    forest = Param(Params._dummy(), "forest", "trees, bin edges and start values as JSON", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "name of the feature vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, forest: str | None = None, features: str = "features"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _loaded(self) -> dict:
        return json.loads(self.getOrDefault(self.forest))

    @property
    def featureImportances(self):
        """Share of every feature in the gain of all splits."""
        g = np.array(self._loaded()["gains"])
        return Vectors.dense(g / g.sum() if g.sum() > 0 else g)

    def _transform(self, df: DataFrame) -> DataFrame:
        m = self._loaded()
        edges, base, depth = [np.array(e, float) for e in m["edges"]], np.array(m["base"]), m["depth"]
        rounds = [[(np.array(f, np.int16), np.array(c, np.int16), np.array(v)) for f, c, v in trees] for trees in m["rounds"]]

        classes = m["loss"] == "softmax"

        def score(x: pa.Array) -> pa.Array:
            raw = H.margins(np.tile(base, (len(x), 1)), rounds, H.binned(A.vectors(x, len(edges)), edges), depth)
            return A.lists(np.hstack([raw, H.softmax(raw)]) if classes else raw)

        # said not to be deterministic: a filter on the prediction would otherwise score every row a second time, in a second worker
        scored = F.arrow_udf(score, "array<double>").asNondeterministic()(vector_to_array(self.getOrDefault(self.features)))
        if not classes:
            return df.withColumn("__scored", scored).withColumn("prediction", F.col("__scored")[0]).drop("__scored")
        raw, shares = (F.slice("__scored", at, len(base)) for at in (1, 1 + len(base)))
        best = F.array_position(raw, F.array_max(raw)) - 1  # ties: the smaller code
        return df.withColumn("__scored", scored).withColumns({
            "rawPrediction": array_to_vector(raw), "probability": array_to_vector(shares), "prediction": best.cast("double")}).drop("__scored")
