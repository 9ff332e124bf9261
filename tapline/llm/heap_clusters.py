"""Exact k-means on integer vectors, with heap-ordered bounds.

Vectors are packed once into blocks of ``BLOCK`` rows, written as a table
bucketed by block.  Per block and cluster a binary heap holds one key a vector:
the gap between its distance to the second nearest and to its own centroid
(lower minus upper bound), plus the drift its cluster had accumulated when the
vector was last scanned.  A round adds to a cluster's drift how far its own
centroid moved and how far any other one moved at most; a key not above the
accumulated drift has expired.  Only expired vectors are popped from the heaps,
compared with all centroids and pushed back; a heap whose root still holds is
not even unpacked.  Every other vector provably keeps its nearest centroid, so
the clusters are those of the plain algorithm.

A round is one scan of the blocks joined with the small heap table (the
bucketing of the blocks saves their shuffle).  Sums and counts of the clusters
change only by the vectors that moved; components are integers, so sums are
exact, and the driver receives clusters x (components + 1) numbers a round.

Rows: vectors that are null, of another length, or hold null or non-finite
components are left out.  Components x become floor(1024 * x), held within
+-2**27 so that every squared distance fits in 64 bits.  A null id never seeds
and is clustered like any other.  Repeated rows count as often as they occur;
equal hashes are ordered by components.  With fewer vectors than clusters there
are as many centroids as vectors; an empty table gives no rows.  Inertias that
exceed 64 bits are given as the largest long.  Extra columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_path, small_batches, stored

#: Vectors of a block (slots are 16-bit), blocks of an Arrow batch.
BLOCK, BATCH_BLOCKS = 512, 64
SCALE, BOUND = 1024, 1 << 27
#: Components up to this size are compared by exact products of doubles, larger ones by 64-bit integers.
SMALL = 1 << 20
#: Share of the distances by which bounds are narrowed, far above the rounding error of square roots.
SLACK = 1e-9

_STATE = "block long, sizes array<int>, slots binary, keys binary, delta array<long>, scanned long"
_LONG = (1 << 63) - 1


@contextmanager
def _few_rows(spark: SparkSession):
    """Arrow batches of BATCH_BLOCKS rows while blocks are read or written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def usable(vectors: DataFrame, dim: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors with ``dim`` components, none null or non-finite."""
    fine = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(vector_column).isNotNull() & (F.size(vector_column) == dim) & fine).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -BOUND, BOUND).astype(np.int64)


def blocks(rows: DataFrame, dim: int) -> DataFrame:
    """(block, ids, data) of at most BLOCK vectors each: 16-bit components where they fit, else 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        number = ctx.partitionId() << 32
        ids, held, n = [], [], 0

        def flush(size: int):
            nonlocal ids, held, n, number
            i, v = pa.concat_arrays(ids), np.concatenate(held)
            part = v[:size]
            kind = "<i2" if np.abs(part).max(initial=0) < 1 << 15 else "<i4"
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), i.slice(0, size)),
                                              pa.array([part.astype(kind).tobytes()], pa.binary())], names=["block", "ids", "data"])
            ids, held, n, number = [i.slice(size)], [v[size:]], n - size, number + 1
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0))
            held.append(integers(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
            n += batch.num_rows
            while n >= BLOCK:
                yield flush(BLOCK)
        if n:
            yield flush(n)

    return rows.mapInArrow(run, "block long, ids array<long>, data binary")


def unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * dim else "<i4").reshape(n, dim).astype(np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors x centroids)."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number in a tie; safe gap to the second nearest, infinite without one)."""
    d = squared(v, centroids)
    best = d.argmin(1)
    if d.shape[1] == 1:
        return best, np.full(len(v), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return best, two[:, 1] - two[:, 0] - SLACK * (two[:, 1] + two[:, 0])


class Heaps:
    """A block's heaps, one a cluster, as (key, slot) pairs; untouched ones stay packed."""

    def __init__(self, k: int, sizes=(), slots: bytes = b"", keys: bytes = b""):
        slot, key, at = np.frombuffer(slots, "<i2"), np.frombuffer(keys, "<f8"), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.packed = [(key[at[a]:at[a + 1]], slot[at[a]:at[a + 1]]) if len(sizes) else (key, slot) for a in range(k)]
        self.open: dict[int, list] = {}

    def _list(self, a: int) -> list:
        if a not in self.open:
            key, slot = self.packed[a]
            self.open[a] = list(zip(key.tolist(), slot.tolist()))
        return self.open[a]

    def expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pop what the drift has used up: (slots, the clusters they were in)."""
        slots, owners = [], []
        for a, (key, _) in enumerate(self.packed):
            if not len(key) or key[0] > drift[a]:
                continue
            heap, limit = self._list(a), drift[a]
            while heap and heap[0][0] <= limit:
                slots.append(heapq.heappop(heap)[1])
                owners.append(a)
        return np.array(slots, np.int64), np.array(owners, np.int64)

    def push(self, slots: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> None:
        for slot, a, key in zip(slots.tolist(), clusters.tolist(), keys.tolist()):
            heapq.heappush(self._list(a), (key, slot))

    def arrays(self) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(heap sizes, slots, keys), every heap in its heap order."""
        parts = [(np.array([x[0] for x in self.open[a]], "<f8"), np.array([x[1] for x in self.open[a]], "<i2")) if a in self.open else p
                 for a, p in enumerate(self.packed)]
        return [len(p[0]) for p in parts], np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts])


def _advance(heaps: Heaps | None, v: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray]:
    """Rescan a block's expired vectors: (heaps, slots, old clusters or -1, new clusters)."""
    if heaps is None:
        heaps, slots, old = Heaps(len(centroids)), np.arange(len(v)), np.full(len(v), -1)
    else:
        slots, old = heaps.expired(drift)
    if not len(slots):
        return heaps, slots, old, old
    new, gap = nearest(v[slots], centroids)
    heaps.push(slots, new, gap + drift[new])
    return heaps, slots, old, new


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, dim = centroids.shape
    for batch in batches:
        rows, delta, scanned = batch.to_pylist(), np.zeros((k, dim + 1), np.int64), 0
        out = []
        for row in rows:
            v = unpack(row["data"], row["n"], dim)
            old = Heaps(k, row["sizes"], row["slots"], row["keys"]) if row.get("sizes") is not None else None
            heaps, slots, was, now = _advance(old, v, centroids, drift)
            moved = was != now
            scanned += len(slots)
            for a in range(k):
                gone, come = v[slots[moved & (was == a)]], v[slots[moved & (now == a)]]
                delta[a, :dim] += come.sum(0) - gone.sum(0)
                delta[a, dim] += len(come) - len(gone)
            sizes, slot, key = heaps.arrays()
            out.append((row["block"], sizes, slot.tobytes(), key.tobytes()))
        if out:  # one row of a batch carries its sums
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.list_(pa.int32())), pa.array([r[2] for r in out], pa.binary()),
                 pa.array([r[3] for r in out], pa.binary()), pa.array([delta.ravel().tolist()] + [[]] * (len(out) - 1), pa.list_(pa.int64())),
                 pa.array([scanned] + [0] * (len(out) - 1), pa.int64())], names=["block", "sizes", "slots", "keys", "delta", "scanned"])


def _final(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, dim = centroids.shape
    for batch in batches:
        for i, row in enumerate(batch.to_pylist()):
            v = unpack(row["data"], row["n"], dim)
            old = Heaps(k, row["sizes"], row["slots"], row["keys"]) if row.get("sizes") is not None else None
            sizes, slot, _ = _advance(old, v, centroids, drift)[0].arrays()
            cluster = np.empty(len(v), np.int64)
            cluster[slot] = np.repeat(np.arange(k), sizes)
            d = ((v - centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.array(cluster.astype(np.int32)), pa.array(d)],
                                             names=["id", "cluster", "distance"])


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What a round adds to each cluster's drift: its own move and the largest of the others."""
    p = np.sqrt(np.array([sum(int(x) ** 2 for x in row) for row in new - old], dtype=np.float64)) * (1 + SLACK)
    others = np.array([max([p[j] for j in range(len(p)) if j != a], default=0.0) for a in range(len(p))])
    return p + others


class Clustering:
    """Rows (id, cluster, distance), the final centroids, and the vectors scanned in each round."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, scanned: list[int]):
        self.rows, self.centroids, self.scanned = rows, centroids, scanned


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3", id_column: str = "vec_id",
        vector_column: str = "embedding") -> Clustering:
    """Cluster all usable vectors; seeds are those with the smallest sha256 of ``seed:id``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, dim, id_column, vector_column)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").orderBy(order, "v").limit(k).collect()
    centroids = integers(np.array([r.v for r in first], np.float64).reshape(-1, dim))
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "id long, cluster int, distance long"), centroids, [])
    k = len(centroids)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"blocks_{uuid.uuid4().hex[:12]}"
    (blocks(rows, dim).repartition(width, "block").write.bucketBy(width, "block").sortBy("block")
     .option("path", shared_path(spark, "blocks")).saveAsTable(table))
    held = spark.table(table)
    held = held.withColumn("n", F.size("ids"))
    drift, totals, state, scanned = np.zeros(k), np.zeros((k, dim + 1), object), None, []

    def step(fn, schema: str, columns: list[str]) -> DataFrame:
        c, d = centroids, drift  # the task's own copy: k x dim numbers
        joined = held if state is None else held.join(state.drop("delta", "scanned"), "block")
        return joined.select(*columns, *([] if state is None else ["sizes", "slots", "keys"])).mapInArrow(lambda it: fn(it, c, d), schema)

    with _few_rows(spark):
        for _ in range(rounds):
            state = stored(step(_round, _STATE, ["block", "n", "data"]), "heaps")
            for r in state.select(F.posexplode("delta").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
                totals[r.at // (dim + 1), r.at % (dim + 1)] += int(r.x)
            scanned.append(state.agg(F.sum("scanned")).first()[0])
            moved = np.array([[int(s) // int(t[dim]) for s in t[:dim]] if t[dim] else old.tolist() for t, old in zip(totals, centroids)], np.int64)
            centroids, drift = moved, drift + _moves(centroids, moved)
        out = stored(step(_final, "id long, cluster int, distance long", ["block", "n", "data", "ids"]), "clusters")
    spark.sql(f"drop table {table}")  # the name only; the files belong to the scratch folder
    return Clustering(out, centroids, scanned)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3", id_column: str = "vec_id",
             vector_column: str = "embedding") -> DataFrame:
    """(id_column, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable vector."""
    found = fit(vectors, k, rounds, dim, seed, id_column, vector_column)
    spark = vectors.sparkSession
    sums = {r.cluster: int(r.s) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), _LONG)
    facts = [(c, min(sums.get(c, 0), _LONG), total, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest())
             for c, row in enumerate(found.centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
