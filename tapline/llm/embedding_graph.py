"""Embedding near-duplicates by search in a robust-pruned flat graph.

Vectors with equal labels (and equal dimension) are linked if their cosine, in
double precision, is at least ``THRESHOLD``.

1. Equal vectors of a label form a class; its smallest id stands for it, and
   its size is the weight it adds to others' link counts.
2. Spherical k-means centroids per label are fitted on a bounded sample
   (``SAMPLE`` rows by hash order); every vector goes to its ``OVERLAP`` nearest
   clusters, so shards overlap.  Clusters whose centroids are in link range of
   each other (a large family draws many) are one dense shard, whose members are
   compared with all of it by block products, without a graph.
3. Per shard, every node's nearest members are robustly pruned (a candidate that
   a kept neighbour is ALPHA times closer to is dropped) to ``DEGREE`` edges,
   and edges go both ways.  Parts of the graph that hang together only inside
   (families larger than POOL) are joined by edges to the nearest members
   outside.  The adjacency lists of all shards are then united per vector.
4. Per shard, every member searches the united graph: greedy beam search from
   its own node and the shard's medoids, then a range expansion that follows every node within
   ``SLACK`` of the threshold until no new one turns up.  Found pairs are
   verified in double precision.  A pair counts in the smallest shard that
   holds both, so overlapping shards count no link twice.
5. Links leave a shard as counts and a spanning forest, never as pairs.

``audit`` measures recall against brute force for the vectors whose id is
divisible by 50.

A shard of more than ``BLOCK`` members is searched by several tasks, each with
the shard's graph and a block of its members as queries.

Rows: a vector that is null, empty, zero or holds null or non-finite components,
and one with a null label or null id, links with nothing (n_links 0, its own
component, kept; a null id has a null component).  Rows that share a vec_id are
one vector; repeated rows come back as often as they occur, but do not link with
themselves.  Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, spanning
from .scratch import stored

THRESHOLD = 0.93
#: Rows the centroids are fitted on; members of a shard, clusters of a vector, most clusters of a label.
SAMPLE, TARGET, OVERLAP, MOST_CLUSTERS = 20_000, 500, 4, 2_000
DEGREE, POOL, ALPHA = 24, 64, 1.2
BEAM, ENTRIES, SLACK = 24, 8, 0.06
BLOCK, LOCKSTEP = 4_096, 128
#: Added to the number of a dense shard; cells of one block product.
DENSE, CELLS = 1 << 40, 1 << 19


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, v, label) of the vectors that can link: v is an array of finite doubles that is not zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    df = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), F.col(label).alias("label"))
    return df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
                    & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def centroids(sample: pd.DataFrame, sizes: dict) -> dict:
    """Spherical k-means centroids per (label, dimension); with OVERLAP homes a vector, about TARGET members to a shard."""
    out = {}
    for key, rows in sample.groupby(["label", "dim"], sort=True):
        x = unit(np.stack(rows["v"].to_numpy()).astype(np.float64))
        k = round(OVERLAP * sizes[key] / TARGET)
        k = int(min(k if k > OVERLAP else 1, MOST_CLUSTERS, len(x)))  # with few clusters every shard would hold the whole label
        rng = np.random.default_rng(7)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
        out[key] = c
    return out


def shards(c: np.ndarray, first: int, threshold: float) -> np.ndarray:
    """Shard of every centroid of a label: its own, or the dense one of the centroids that hang together in link range."""
    out = first + np.arange(len(c))
    a, b = np.nonzero(np.triu(unit(c) @ unit(c).T >= threshold, 1))
    tree = spanning(np.stack([a, b], axis=1))
    out[tree[:, 0]] = DENSE + first + tree[:, 1]
    out[tree[:, 1]] = DENSE + first + tree[:, 1]
    return out


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL) -> list[np.ndarray]:
    """Neighbours of every row of a shard (unit vectors): nearest candidates, robustly pruned, edges both ways."""
    m = len(x)
    if m == 1:
        return [np.zeros(0, np.int64)]
    pool = min(pool, m - 1)
    kept: list[list[int]] = [[] for _ in range(m)]
    for lo in range(0, m, 512):
        hi = min(m, lo + 512)
        sim = x[lo:hi] @ x.T
        sim[np.arange(hi - lo), np.arange(lo, hi)] = -2
        cand = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
        cs = np.take_along_axis(sim, cand, axis=1)
        order = np.argsort(-cs, axis=1, kind="stable")
        cand, cs = np.take_along_axis(cand, order, axis=1), np.take_along_axis(cs, order, axis=1)
        far = np.sqrt(np.maximum(0, 2 - 2 * cs))
        alive = np.ones(cand.shape, bool)
        vectors = x[cand]
        rows = np.arange(hi - lo)
        for _ in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            for r in rows[some]:
                kept[lo + r].append(int(cand[r, pick[r]]))
            near = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("rpd,rd->rp", vectors, vectors[rows, pick])))
            alive &= ALPHA * near > far
            alive[rows, pick] = False
    both = [set(k) for k in kept]
    for i, k in enumerate(kept):
        for j in k:
            both[j].add(i)
    # an edge back may exceed the degree; the closest 2 * degree stay
    out = []
    for i, b in enumerate(both):
        ids = np.fromiter(b, np.int64, len(b))
        out.append(ids if len(ids) <= 2 * degree else ids[np.argsort(-(x[ids] @ x[i]), kind="stable")[:2 * degree]])
    return joined(x, out)


def joined(x: np.ndarray, near: list[np.ndarray]) -> list[np.ndarray]:
    """The graph with one component: every row in range gets an edge to its nearest row of another component, each component one at least."""
    m = len(x)
    while True:
        edges = np.stack([np.repeat(np.arange(m), [len(n) for n in near]), np.concatenate(near)], axis=1)
        part = np.arange(m)
        tree = spanning(edges)
        part[tree[:, 0]] = tree[:, 1]
        if not part.any():
            return near
        best, to = np.empty(m), np.empty(m, np.int64)
        for lo in range(0, m, 512):
            sim = x[lo:lo + 512] @ x.T
            sim[part[lo:lo + 512, None] == part[None, :]] = -2
            to[lo:lo + 512] = sim.argmax(axis=1)
            best[lo:lo + 512] = sim.max(axis=1)
        order = np.lexsort((-best, part))
        first = order[np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0]))]
        more: dict[int, list[int]] = {}
        for i in np.union1d(np.flatnonzero(best >= THRESHOLD - SLACK), first).tolist():
            more.setdefault(i, []).append(int(to[i]))
            more.setdefault(int(to[i]), []).append(i)
        near = list(near)
        for i, js in more.items():
            near[i] = np.union1d(near[i], js).astype(np.int64)


def medoids(x: np.ndarray) -> np.ndarray:
    """Entry points: the medoid, then members far from the entries so far."""
    first = int((x @ x.mean(axis=0)).argmax())
    out, best = [first], x @ x[first]
    for _ in range(min(ENTRIES, len(x)) - 1):
        nxt = int(best.argmin())
        if nxt in out:
            break
        out.append(nxt)
        best = np.maximum(best, x @ x[nxt])
    return np.array(out)


def range_search(x: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query position, node) of all nodes reached with a cosine of at least threshold - SLACK; searches run in lockstep."""
    q, m = len(queries), len(x)
    target = x[queries]
    seen = np.zeros((q, m), bool)
    seen[:, entries] = True
    rows = np.arange(q)
    own = ~seen[rows, queries]  # an entry is no second start
    seen[rows, queries] = True
    ids = np.concatenate([np.broadcast_to(entries, (q, len(entries))), queries[:, None]], axis=1)
    sims = np.concatenate([target @ x[entries].T, np.where(own, 1.0, -4.0)[:, None]], axis=1)
    done = np.zeros(ids.shape, bool)
    done[:, -1] = ~own
    near_q, near_n = [], []
    level = threshold - SLACK
    for _ in range(m):
        open_sims = np.where(done, -3.0, sims)
        best = open_sims.argmax(axis=1)
        go = np.flatnonzero(open_sims[rows, best] > -3.0)
        if not len(go):
            break
        done[go, best[go]] = True
        nb = adjacency[ids[go, best[go]]]
        fresh = (nb >= 0) & ~seen[go[:, None], np.maximum(nb, 0)]
        # the same node may stand twice in a row; marking it seen keeps the first
        qi, slot = np.nonzero(fresh)
        node = nb[qi, slot]
        seen[go[qi], node] = True
        new_sims = np.full(nb.shape, -4.0)
        new_sims[qi, slot] = np.einsum("ij,ij->i", target[go[qi]], x[node])
        all_ids = np.full((q, ids.shape[1] + nb.shape[1]), 0, np.int64)
        all_sims = np.full(all_ids.shape, -4.0)
        all_done = np.ones(all_ids.shape, bool)
        all_ids[:, :ids.shape[1]], all_sims[:, :ids.shape[1]], all_done[:, :ids.shape[1]] = ids, sims, done
        all_ids[go, ids.shape[1]:] = np.maximum(nb, 0)
        all_sims[go, ids.shape[1]:] = new_sims
        all_done[go, ids.shape[1]:] = new_sims <= -4.0
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :BEAM]
        ids, sims, done = (np.take_along_axis(a, top, axis=1) for a in (all_ids, all_sims, all_done))
    qi, slot = np.nonzero(sims >= level)
    wave_q, wave_n = qi, ids[qi, slot]
    seen[:] = False  # the expansion starts over from what lies in range
    seen[wave_q, wave_n] = True
    while len(wave_q):
        near_q.append(wave_q)
        near_n.append(wave_n)
        nb = adjacency[wave_n]
        wq = np.repeat(wave_q, nb.shape[1])
        wn = nb.reshape(-1)
        ok = wn >= 0
        wq, wn = wq[ok], wn[ok]
        ok = ~seen[wq, wn]
        cell = np.unique(wq[ok] * m + wn[ok])
        wq, wn = cell // m, cell % m
        seen[wq, wn] = True
        good = np.einsum("ij,ij->i", target[wq], x[wn]) >= level
        wave_q, wave_n = wq[good], wn[good]
    return (np.concatenate(near_q), np.concatenate(near_n)) if near_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    x = unit(np.stack(pdf["v"].to_numpy()))
    ids = pdf["vec_id"].to_numpy()
    return pd.DataFrame({"vec_id": ids, "near": [ids[n] for n in robust_prune(x)]})


def _search(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One shard, members with their united adjacency; those of the task's block search.

    Gives (vec_id, links, root): the link counts of the block's members, and a
    spanning forest of the links found (links 0).
    """
    pdf = pdf.sort_values("vec_id", kind="stable").reset_index(drop=True)
    ids, weight = pdf["vec_id"].to_numpy(), pdf["weight"].to_numpy()
    x = unit(np.stack(pdf["v"].to_numpy()))
    shard, block, blocks = (int(pdf[c].iloc[0]) for c in ("shard", "block", "blocks"))
    homes = np.stack(pdf["homes"].to_numpy())
    step = LOCKSTEP if shard < DENSE else max(1, CELLS // len(ids))
    if shard < DENSE:
        place = {v: i for i, v in enumerate(ids.tolist())}
        lists = [[place[j] for j in n if j in place] for n in pdf["near"]]
        adjacency = np.full((len(ids), max(1, max(map(len, lists)))), -1, np.int64)
        for i, n in enumerate(lists):
            adjacency[i, :len(n)] = n
        entries = medoids(x)
    mine = np.flatnonzero(np.arange(len(ids)) % blocks == block)
    links, forest = np.zeros(len(ids), np.int64), np.zeros((0, 2), np.int64)
    for lo in range(0, len(mine), step):
        some = mine[lo:lo + step]
        if shard < DENSE:
            q, n = range_search(x, adjacency, entries, some, threshold)
        else:
            q, n = np.nonzero(x[some] @ x.T >= threshold - 1e-9)
        a = some[q]
        ok = (a != n) & (np.einsum("ij,ij->i", x[a], x[n]) >= threshold)
        a, n = a[ok], n[ok]
        forest = spanning(np.concatenate([forest, np.stack([ids[a], ids[n]], axis=1)]))  # whichever shard finds it
        common = (homes[a][:, :, None] == homes[n][:, None, :]).any(axis=2)
        first = np.where(common, homes[a], np.iinfo(np.int64).max).min(axis=1)
        a, n = a[first == shard], n[first == shard]
        np.add.at(links, a, weight[n])
    return pd.DataFrame({"vec_id": np.concatenate([ids[mine], forest[:, 0]]), "links": np.concatenate([links[mine], np.zeros(len(forest), np.int64)]),
                         "root": np.concatenate([ids[mine], forest[:, 1]])})


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (smallest linked vec_id), kept (vec_id = component_id)."""
    spark = embeddings.sparkSession
    good = usable(embeddings, id_column, vector, label).dropDuplicates(["vec_id"])
    good = stored(good.select("vec_id", "label", F.size("v").alias("dim"), "v"), "vectors")
    classes = stored(good.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.min("dim").alias("dim")), "classes")
    sample = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("label", "dim", "v").toPandas()
    # sizes of the labels in the sample only, at most SAMPLE of them; a label it misses is one shard, named by a hash
    sampled = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("label", "dim").distinct()
    counted = classes.join(F.broadcast(sampled), ["label", "dim"], "left_semi").groupBy("label", "dim").agg(F.count("*").alias("n"))
    fitted = centroids(sample, {(r["label"], r["dim"]): r["n"] for r in counted.collect()})
    first = dict(zip(fitted, np.cumsum([0, *map(len, fitted.values())])[:-1].tolist()))
    shard = {key: shards(c, first[key], threshold) for key, c in fitted.items()}
    shipped = spark.sparkContext.broadcast((fitted, shard))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, shard = shipped.value
        for pdf in batches:
            homes = [None] * len(pdf)
            for key, at in pdf.groupby(["label", "dim"]).indices.items():
                if key not in fitted:
                    for i in at:
                        homes[i] = [pdf["other"].iloc[i]] * OVERLAP
                    continue
                c = fitted[key]
                sim = unit(np.stack(pdf["v"].to_numpy()[at])) @ c.T
                top = shard[key][np.argsort(-sim, axis=1, kind="stable")[:, :OVERLAP]]
                if top.shape[1] < OVERLAP:  # fewer clusters than homes: the last one repeats
                    top = np.concatenate([top, np.repeat(top[:, -1:], OVERLAP - top.shape[1], axis=1)], axis=1)
                for i, t in zip(at, top):
                    homes[i] = t
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "weight": pdf["weight"], "v": pdf["v"], "homes": homes})

    other = -1 - F.shiftrightunsigned(F.xxhash64("label", "dim"), 1)
    members = classes.select("vec_id", "weight", "v", "label", "dim", other.alias("other")).mapInPandas(assign, "vec_id long, weight long, v array<double>, homes array<long>")
    members = stored(members, "members")
    sharded = members.select("vec_id", "v", F.explode(F.array_distinct("homes")).alias("shard"))
    near = sharded.where(F.col("shard") < DENSE).groupBy("shard").applyInPandas(_build, "vec_id long, near array<long>")
    near = near.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    near = members.join(near, "vec_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
    graph = stored(near.withColumn("shard", F.explode(F.array_distinct("homes"))), "graph")
    blocks = graph.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tasks = graph.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = stored(tasks.groupBy("shard", "block").applyInPandas(lambda pdf: _search(pdf, threshold), "vec_id long, links long, root long"), "found")
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    edges = found.where("vec_id <> root").select(F.col("vec_id").alias("u"), F.col("root").alias("v"))

    to_class = good.select("vec_id", "label", "v").join(classes.select("label", "v", F.col("vec_id").alias("head"), "weight"), ["label", "v"])
    to_class = stored(to_class.select("vec_id", "head", "weight"), "heads")
    roots = components(edges.unionByName(to_class.where("vec_id <> head").select(F.col("vec_id").alias("u"), F.col("head").alias("v"))))
    mine = (to_class.join(counted.withColumnRenamed("vec_id", "head"), "head", "left")
            .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    out = embeddings.select(F.col(id_column).cast("long").alias("vec_id"))
    out = out.join(mine, "vec_id", "left").join(roots.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def audit(embeddings: DataFrame, result: DataFrame, threshold: float = THRESHOLD, every: int = 50) -> DataFrame:
    """Recall of the links of the vectors whose id is divisible by ``every``: vec_id, n_true (brute force), n_links.

    The queries are compared with all rows of their label, in blocks: one pass
    over the vectors per block of queries.
    """
    good = usable(embeddings).dropDuplicates(["vec_id"])
    queries = good.where(F.col("vec_id") % every == 0)
    part, held = None, []

    def scan(block: list) -> DataFrame:
        shipped = embeddings.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = np.array([r[0] for r in shipped.value])
            for pdf in batches:
                n = np.zeros(len(ids), np.int64)
                for (label, dim), at in pdf.assign(dim=pdf["v"].map(len)).groupby(["label", "dim"]).indices.items():
                    own = [i for i, r in enumerate(shipped.value) if r[2] == label and len(r[1]) == dim]
                    if own:
                        sim = unit(np.array([shipped.value[i][1] for i in own])) @ unit(np.stack(pdf["v"].to_numpy()[at])).T
                        hit = (sim >= threshold) & (ids[own][:, None] != pdf["vec_id"].to_numpy()[at][None, :])
                        n[own] += hit.sum(axis=1)
                yield pd.DataFrame({"vec_id": ids, "n_true": n})

        return good.mapInPandas(run, "vec_id long, n_true long")

    for row in queries.toLocalIterator():
        held.append((row["vec_id"], row["v"], row["label"]))
        if len(held) == 4_096:
            part = scan(held) if part is None else part.unionByName(scan(held))
            held = []
    if held or part is None:
        part = scan(held) if part is None else part.unionByName(scan(held))
    return part.groupBy("vec_id").agg(F.sum("n_true").alias("n_true")).join(result.select("vec_id", "n_links"), "vec_id")
