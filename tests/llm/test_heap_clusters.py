"""Heap-ordered k-means against plain k-means with Python integers."""

import hashlib
import random

import numpy as np
import pytest

from tapline.llm import heap_clusters as H


def plain(rows, k, rounds, dim, seed):
    """{position: (cluster, distance)} and the centroids by the textbook loop."""
    kept = [(i, r[0], [min(max(int(np.floor(1024 * float(x))), -H.BOUND), H.BOUND) for x in r[1]], list(r[1])) for i, r in enumerate(rows)
            if r[1] is not None and len(r[1]) == dim and all(x is not None and np.isfinite(x) for x in r[1])]
    seeds = sorted((hashlib.sha256(f"{seed}:{r[1]}".encode()).hexdigest(), r[3], r[2]) for r in kept if r[1] is not None)[:k]
    cs = [s[2] for s in seeds]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        best = {r[0]: min((far(r[2], c), j) for j, c in enumerate(cs)) for r in kept}
        if step == rounds:
            return {r[0]: (r[1], best[r[0]][1], best[r[0]][0]) for r in kept}, cs
        for j in range(len(cs)):
            own = [r[2] for r in kept if best[r[0]][1] == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own)]


def check(spark, rows, k=4, rounds=6, dim=3, seed="7"):
    want, centroids = plain(rows, k, rounds, dim, seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"cluster": H.F.lit("x"), "block": H.F.lit("y"), "v": H.F.lit(0)})
    got = sorted((r.vec_id is None, r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in H.clusters(df, k, rounds, dim, seed).collect())
    whole = sum(d for _, _, d in want.values())
    own = [sum(d for _, c, d in want.values() if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert got == sorted((v is None, v, c, d, own[c], whole, sha[c]) for v, c, d in want.values())


def blobs(n, dim, seed, spread=0.05):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 9])
def test_equals_plain_k_means(spark, dim):
    check(spark, blobs(300, dim, dim), k=5, dim=dim)


def test_ties_repeated_and_unusable_rows(spark):
    grid = [(i, [(i % 4) / 1024, (i // 4 % 4) / 1024, 0.0]) for i in range(64)]
    bad = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 0.0]), (104, [float("nan"), 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0])]
    check(spark, grid + grid[:20] + bad)


def test_far_and_close_vectors_stay_exact(spark):
    big = [(i, [1e30 * (i % 2), 9e4 + i, -1e5 + i]) for i in range(12)]
    close = [(50 + i, [9e4 + i / 1024, 1e5, 0.0]) for i in range(12)]
    check(spark, big + close, k=3)


def test_fewer_vectors_than_clusters_and_none(spark):
    check(spark, [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])])
    check(spark, [(1, [0.5, 0.0, 0.0])])
    assert H.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_null_id_is_clustered_but_no_seed(spark):
    got = H.clusters(spark.createDataFrame([(None, [0.0]), (1, [0.0]), (2, [1.0])], "vec_id long, embedding array<double>"), 2, 3, 1).collect()
    assert len(got) == 3 and {r.cluster for r in got if r.vec_id in (None, 1)} == {next(r.cluster for r in got if r.vec_id == 1)}


def test_heaps_spare_scans(spark):
    """On separate clusters only few vectors are scanned after the first rounds."""
    rows = blobs(3000, 8, 1, 0.02)
    found = H.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 6, 8, 8, "3")
    assert found.scanned[0] == 3000 and sum(found.scanned[3:]) < 3000
