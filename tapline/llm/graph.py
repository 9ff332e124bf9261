"""Connected components of an edge table, without ever holding the graph in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: A round at least halves the longest chain, so this many rounds reach any graph that fits in 64-bit ids.
MAX_ROUNDS = 64


def spanning(pairs: np.ndarray) -> np.ndarray:
    """(node, root) rows of the components among some (a, b) rows; roots are smallest nodes and not listed."""
    if not len(pairs):
        return pairs
    nodes, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(pairs.shape).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return np.stack([nodes[own], nodes[root[own]]], axis=1)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch's edges by a spanning forest of them."""
    for batch in batches:
        out = spanning(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) edges; the component is its smallest node.

    Alternating large-star and small-star steps; each is one aggregate (combined
    before the shuffle, so a hub costs no more than another node) and one join
    that adaptive execution splits when a node is hot.  Every round is written
    to the shared folder.  Self-loops are ignored; null ends are dropped; an
    empty table gives an empty table.
    """
    e = (edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v"))
         .where("u is not null and v is not null and u <> v").mapInArrow(_contract, "u long, v long").distinct())
    e = stored(e, "edges")
    last = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = stored(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        seen = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == last:
            break
        last = seen
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
