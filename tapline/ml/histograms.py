"""What the boosting of ``boosting`` computes inside tasks: bins, margins, histograms and a node's best split.

Imports numpy only.  A Python worker loads the module of every function that it runs, and
pandas, pyarrow and ``pyspark.ml`` would take more of its memory than a block of rows does.
"""

from __future__ import annotations

import numpy as np

FLOOR = 1e-12  # smallest Hessian of a row and smallest gain of a split


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin b of a value: the first edge not below it; beyond all edges, and NaN: the last bin."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def unpacked(r, outputs: int):
    """((block id, bins, label, weight), margins) of a row of ``_blocks``."""
    y = np.frombuffer(r["y"])
    bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, len(y)).T
    return ((r["part"], r["number"]), bins, y, np.frombuffer(r["w"])), np.frombuffer(r["margin"]).reshape(-1, outputs)


# A tree is three arrays over a heap of nodes (children of i: 2i+1, 2i+2): feature (-1: leaf), bin, value.

def walk(tree, bins: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of every row among the nodes of the level, node of the heap that each place stands for).

    A row in a leaf goes on to the left, and the places below a leaf stand for that leaf.
    """
    at = start(len(bins))
    for _ in range(levels):
        at = step(tree, bins, *at)
    return at


def start(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``walk`` of no level: all rows at the root."""
    return np.zeros(rows, np.intp), np.zeros(1, np.int64)


def step(tree, bins: np.ndarray, place: np.ndarray, stands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``walk`` one level on from what it gave."""
    feature, cut, _ = tree
    flat = bins.T.reshape(-1)  # blocks: no copy
    f, leaf = feature[stands].astype(np.intp), feature[stands] < 0
    if not leaf.all():
        first, limit = np.maximum(f, 0) * len(bins), np.where(leaf, 255, cut[stands]).astype(np.uint8)
        got = flat.take(first.take(place) + np.arange(len(bins))) if len(stands) > 1 else flat[first[0]:first[0] + len(bins)]
        place = 2 * place + (got > limit.take(place))
    else:
        place = 2 * place
    return place, np.stack([np.where(leaf, stands, 2 * stands + 1), np.where(leaf, stands, 2 * stands + 2)], 1).ravel()


def margins(start: np.ndarray, rounds, bins: np.ndarray, depth: int) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            place, stands = walk(tree, bins, depth)
            out[:, k] += tree[2][stands].take(place)
    return out


def derivatives(loss: str, margin: np.ndarray, y: np.ndarray, w: np.ndarray):
    """Gradient and Hessian (rows × outputs) of the squared error or of the softmax cross-entropy."""
    if loss == "squared":
        return (margin - y[:, None]) * w[:, None], np.repeat(w[:, None], margin.shape[1], 1)
    p = softmax(margin)
    hot = p.copy()
    hot[np.arange(len(y)), y.astype(int)] -= 1.0
    return hot * w[:, None], np.maximum(p * (1 - p), FLOOR) * w[:, None]


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def histogram(block, margin, trees, level: int, cfg: dict, number: int) -> np.ndarray:
    """2 (gradient, Hessian) × outputs × nodes of the level × features × bins of one block."""
    sums = drawn(block, margin, cfg, number)
    return summed(block, sums, [walk(tree, block[1], level) for tree in trees], level, cfg)


def drawn(block, margin, cfg: dict, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients and Hessians (a row for each output) and weights of a block's rows in a round."""
    name, _, y, w = block
    if cfg["rows"] < 1.0:  # a row's draw depends on its place in the stored block only
        draw = np.random.default_rng([cfg["seed"], number, *name]).random(len(y))
        w = w * (draw < cfg["rows"])
    g, h = derivatives(cfg["loss"], margin, y, w)
    return np.ascontiguousarray(g.T), np.ascontiguousarray(h.T), w


def summed(block, sums, walks, level: int, cfg: dict) -> np.ndarray:
    """``histogram`` from ``drawn`` and the walks of the trees to the level."""
    (g, h, w), bins = sums, block[1]
    width, size, first, nodes = bins.shape[1], cfg["bins"], 2 ** level - 1, 2 ** level
    out = np.zeros((2, len(g), nodes, width, size))
    for k, (place, stands) in enumerate(walks):
        here = (stands >= first).take(place) & (w > 0)
        rows = slice(None) if here.all() else np.flatnonzero(here)
        at, parts = place[rows] * size, (g[k][rows], h[k][rows])
        for f in range(width):
            cell = at + bins[rows, f]
            for part, v in enumerate(parts):
                out[part, k, :, f] = np.bincount(cell, v, nodes * size).reshape(nodes, size)
    return out


def nodes(total: np.ndarray):
    """((output, node of the level), gradient and Hessian sums) of the nodes that have rows; the others have no split."""
    for k in range(total.shape[1]):
        for i in np.flatnonzero(total[1, k, :, :1].any(axis=(1, 2))).tolist():
            yield (k, i), total[:, k, i]


def best(g: np.ndarray, h: np.ndarray, cfg: dict, allowed: np.ndarray) -> tuple | None:
    """(feature, bin, gain, left and right gradient and Hessian) of a node's best split by its histograms, and its sums; the split may be None."""
    l2, least = cfg["l2"], cfg["min_child"]
    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    gt, ht = g[0].sum(), h[0].sum()
    gr, hr = gt - gl, ht - hl
    ok = (hl >= least) & (hr >= least) & (hl > FLOOR) & (hr > FLOOR) & allowed[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - gt ** 2 / (ht + l2), -np.inf)
    if not gain.size or gain.max() <= max(cfg["min_gain"], FLOOR * max(ht, 1.0)):
        return None, gt, ht
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return (int(f), int(b), float(gain[f, b]), gl[f, b], hl[f, b], gr[f, b], hr[f, b]), gt, ht


def empty(depth: int, outputs: int) -> list:
    """Trees of a round before the first split."""
    size = 2 ** (depth + 1) - 1
    return [(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size)) for _ in range(outputs)]


def grow(trees, found: dict, level: int, cfg: dict, gains: np.ndarray) -> bool:
    """Split the level's nodes as ``found`` ((output, node of the level) -> ``best``); True if a node has children to go on with."""
    first, l2 = 2 ** level - 1, cfg["l2"]
    went = False
    for k, (feature, cut, value) in enumerate(trees):
        for i in range(2 ** level):
            node = first + i
            if level and feature[(node - 1) // 2] < 0 or (k, i) not in found:
                continue
            split, gt, ht = found[k, i]
            if level == 0:
                value[0] = -cfg["rate"] * gt / (ht + l2) if ht + l2 > 0 else 0.0
            if split is None:
                continue
            f, b, gain, gl, hl, gr, hr = split
            feature[node], cut[node] = f, b
            gains[f] += gain
            value[2 * node + 1] = -cfg["rate"] * gl / (hl + l2)
            value[2 * node + 2] = -cfg["rate"] * gr / (hr + l2)
            went = True
    return went


def rounds(blocks: list, cfg: dict, allowed: list):
    """What ``grow`` is to get at each level, round after round, if one task holds all blocks ((block, margins) each).

    The sums are those of passes over the blocks: equal splits, without a job a level.
    """
    blocks = [(block, margin.copy()) for block, margin in blocks]
    for number in range(cfg["trees"]):
        trees, gains = empty(cfg["depth"], cfg["outputs"]), np.zeros(blocks[0][0][1].shape[1])
        sums = [drawn(block, margin, cfg, number) for block, margin in blocks]
        walks = [[start(len(block[1])) for _ in trees] for block, _ in blocks]
        levels = []
        for level in range(cfg["depth"]):
            total = None
            for (block, _), own, ways in zip(blocks, sums, walks):
                one = summed(block, own, ways, level, cfg)
                total = one if total is None else total + one
            levels.append({(k, i): best(*hist, cfg, allowed[number][k]) for (k, i), hist in nodes(total)})
            went = grow(trees, levels[-1], level, cfg, gains)
            walks = [[step(tree, block[1], *way) for tree, way in zip(trees, ways)] for (block, _), ways in zip(blocks, walks)]
            if not went:
                break
        for (_, margin), ways in zip(blocks, walks):
            for k, (place, stands) in enumerate(ways):
                margin[:, k] += trees[k][2][stands].take(place)
        yield levels
