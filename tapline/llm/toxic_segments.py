"""Toxic passages by maximum-scoring segments of token log-odds.

1. Words (runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased)
   and their beginnings (PREFIXES bytes: inflected forms share them) are counted
   in BUCKETS hashed buckets, once a document (a long or repetitive text is one
   observation): over all documents (the Dirichlet prior), and over training
   documents of either label.  A distributed sum; the model has a fixed size.
2. A unit's weight is its log-odds ratio between toxic and clean text under the
   informative prior, less CAUTION standard errors.  A word scores the largest
   weight of its units if that is at least the floor; every other word scores
   -DRIFT, so the expected score of clean text is negative.  The floor is the
   one of FLOORS under which the calibration documents are likeliest: few labels
   need a lower one than many.
3. A linear scan (Ruzzo-Tompa) finds all maximal scoring segments of a text.
   lambda, the positive root of E[exp(lambda * score)] = 1 under clean word
   frequencies, turns a segment's score S in a text of N words into its expected
   number K * N * exp(-lambda * S) (extreme-value statistics of local scores);
   K is the moment estimate from the clean calibration documents.
4. A document's evidence is the sum over its significant segments of
   -log(expected number).  Evidence is turned into a probability by a logistic
   curve on binned evidence of the calibration documents (distributed counts).

Folds by crc32(doc_id as text) mod 5: 0 is held out and teaches nothing, 1 to 3
give the word weights, 4 calibrates.

Rows: a null or empty text has no segment and gets the probability of no
evidence; labels that are null or for unknown documents are ignored; a document
with several labels counts as toxic if any says so; without training labels
every score is 0; repeated rows are scored alike; extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as T
from .language_mixture import fold_of
from .scratch import stored

BUCKETS = 1 << 20
#: Prior strength in documents, standard errors taken off a weight, cost of an ordinary word, largest weight.
PRIOR, CAUTION, DRIFT, CEILING = 500.0, 2.0, 0.05, 8.0
#: Least weights that are tried; the calibration documents choose.
FLOORS = (1.5, 2.0, 2.5, 3.0, 4.0)
#: Lengths in bytes of the word beginnings that count as units beside the words.
PREFIXES = (4, 5)
#: A segment is significant if fewer than so many are expected by chance.
EXPECTED = 0.5
#: Evidence is binned for calibration: this many bins of this width.
BINS, WIDTH = 200, 0.5
#: Labels up to this many rows (about 60 MB) are broadcast, more are joined by a shuffle; the result is the same.
BROADCAST_LABELS = 1_000_000

_SEP = np.ones(256, bool)
_SEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a row of buckets for each kind of unit, word offsets of the rows)."""
    hashes, offs = T.words(*T.buffer_of(array), sep=_SEP, prefixes=PREFIXES)
    kind = T.stream(0x70, 1 + len(PREFIXES))[:, None]
    return (T.mix(hashes ^ kind) >> np.uint64(44)).astype(np.int64), offs


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by Ruzzo and Tompa.

    Runs of non-positive scores are folded into cumulative sums, so the loop
    only visits positive scores.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    scores = scores.astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, nearest segment with a smaller left sum
    for i in at.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, r - l) for s, e, l, r, _ in stack]


@dataclass
class Model:
    """Word scores, extreme-value parameters and the calibration curve."""

    score: np.ndarray
    lam: float
    log_k: float = 0.0
    offset: float = -30.0
    slope: float = 0.0

    def rows(self, array: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(words, maximal segments) of every text of a string array."""
        for lo, hi in T.steps(array):
            units, offs = tokens(array.slice(lo, hi - lo))
            score = self.score[units].max(axis=0)
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                yield b - a, segments(score[a:b])

    def evidence(self, n_words: int, found: list[tuple[int, int, float]]) -> float:
        """Sum of -log(expected number) over the significant segments."""
        chance = self.log_k + math.log(max(1, n_words))
        return sum(x for x in (self.lam * s - chance for _, _, s in found) if x > -math.log(EXPECTED))

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * evidence))))


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """Weights from counts (all, toxic, clean) per bucket; -inf where no toxic text has the unit."""
    every, toxic, clean = counts
    # half an observation more keeps the error of a unit that one side never shows finite
    prior = 0.5 + PRIOR * every / max(1.0, every.sum())
    t, c = toxic + prior, clean + prior
    total = PRIOR + 0.5 * np.count_nonzero(every)
    ratio = np.log(t / (toxic.sum() + total - t)) - np.log(c / (clean.sum() + total - c))
    weight = np.minimum(ratio - CAUTION * np.sqrt(1 / t + 1 / c), CEILING)
    return np.where(toxic > 0, weight, -np.inf)


def _root(score: np.ndarray, frequency: np.ndarray) -> float:
    """Positive root of E[exp(lambda * score)] = 1, by bisection; 1 if no score is positive."""
    p = frequency / max(1e-300, frequency.sum())
    expected = lambda x: float(np.dot(p, np.exp(x * score)))
    if not (score > 0).any() or float(np.dot(p, score)) >= 0:
        return 1.0
    lo, hi = 0.0, 1e-3
    while expected(hi) < 1 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) < 1 else (lo, mid)
    return hi


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(text, toxic, fold) of every document; toxic is null where no training label is known."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), "toxic").where("_id is not null and toxic is not null")
             .groupBy("_id").agg(F.max("toxic").cast("int").alias("_toxic")))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_column).cast("long").alias("_doc"), F.col(text_column).alias("_text"))
    rows = rows.join(known, rows["_doc"] == known["_id"], "left")
    fold = fold_of(F.col("_doc"), 5).cast("int")
    return rows.select(F.col("_text").alias("text"), F.when(fold != 0, F.col("_toxic")).alias("toxic"), fold.alias("fold"))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Weights from all documents and the training labels of folds 1 to 3, calibration on fold 4."""
    rows = labelled(docs, labels, id_column, text_column)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            kind = np.array([0 if f == 4 or t is None else 1 if t > 0 else 2 for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])
            for lo, hi in T.steps(batch.column(0)):
                units, offs = tokens(batch.column(0).slice(lo, hi - lo))
                once = [np.unique(units[:, a:b]) for a, b in zip(offs[:-1], offs[1:])]
                for k in range(3):
                    own = [u for u, x in zip(once, kind[lo:hi]) if k in (0, x)]
                    if own:
                        total[k] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(t[at]) for t in total]], names=["bucket", "n", "toxic", "clean"])

    sums = rows.mapInArrow(count, "bucket int, n long, toxic long, clean long").groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = sums.toArrow()  # at most BUCKETS rows
    counts = np.zeros((3, BUCKETS))
    at = found["bucket"].to_numpy()
    for i, name in enumerate(("n", "toxic", "clean")):
        counts[i, at] = found[name].to_numpy()
    if not counts[1].sum() or not counts[2].sum():
        return Model(np.full(BUCKETS, -DRIFT, np.float32), 1.0)
    weight = _log_odds(counts)
    held = stored(rows.where("fold = 4 and toxic is not null").select("text", "toxic"), "calibration")
    best = None
    for floor in FLOORS:
        score = np.where(weight >= floor, weight, -DRIFT).astype(np.float32)
        found = calibrated(Model(score, _root(score, counts[2])), held)
        if best is None or found[1] >= best[1]:
            best = found
    return best[0]


def calibrated(model: Model, rows: DataFrame) -> tuple[Model, float]:
    """Fit K on the clean rows and the logistic curve on all, from sums and binned counts only; with the log-likelihood of the rows."""
    sc = rows.sparkSession.sparkContext
    raw = sc.broadcast(model)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, [w for _, _, w in found]) for n, found in raw.value.rows(batch.column(0))]
            n, packed = [n for n, _ in rows], [w for _, w in rows]
            best = [max(w, default=0.0) for w in packed]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(packed, pa.list_(pa.float64())),
                                              batch.column(1)], names=["n", "best", "segments", "toxic"])

    seen = stored(rows.mapInArrow(top, "n long, best double, segments array<double>, toxic int"), "segments")
    # clean texts without any positive word sit at the lower end of the extreme-value law and are left out of its mean
    excess = seen.where("toxic = 0 and best > 0 and n > 0").agg(F.avg(F.lit(model.lam) * F.col("best") - F.log("n"))).first()[0]
    log_k = (excess - 0.5772156649) if excess is not None else 0.0
    model = Model(model.score, model.lam, log_k)
    chance = F.lit(log_k) + F.log(F.greatest(F.col("n"), F.lit(1)))
    evidence = F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.when(model.lam * s - chance > -math.log(EXPECTED), model.lam * s - chance).otherwise(0.0))
    binned = seen.groupBy(F.least(F.ceil(evidence / WIDTH), F.lit(BINS)).cast("int").alias("bin"), F.col("toxic")).count().collect()
    x = np.array([r["bin"] * WIDTH for r in binned], float)
    y = np.array([float(r["toxic"] > 0) for r in binned])
    w = np.array([r["count"] for r in binned], float)
    if not len(x) or y.min() == y.max():
        return Model(model.score, model.lam, log_k, 30.0 if len(y) and y[0] else -30.0, 0.0), 0.0
    x = np.minimum(x, BINS * WIDTH)
    a, b = 0.0, 0.1
    for _ in range(200):  # Newton steps of a two-parameter logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([np.dot(w, y - p) - 1e-3 * a, np.dot(w, (y - p) * x) - 1e-3 * b])
        h = w * p * (1 - p)
        hess = np.array([[h.sum() + 1e-3, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
    likelihood = float(np.dot(w, np.where(y > 0, np.log(p), np.log(1 - p))))
    return Model(model.score, model.lam, log_k, float(a), float(max(b, 0.0))), likelihood


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, and the significant passages as (first word, end word, score)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            scores, passages = [], []
            for n, found in model.rows(batch.column(1)):
                scores.append(model.probability(model.evidence(n, found)))
                passages.append([{"first": a, "end": b, "weight": w} for a, b, w in found if model.evidence(n, [(a, b, w)]) > 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                 pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())])))],
                names=["doc_id", "score", "predicted", "passages"])

    return docs.select(id_column, text_column).mapInArrow(
        run, f"doc_id {id_type}, score double, predicted int, passages array<struct<first: long, end: long, weight: double>>")


def accepted(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Documents that are not predicted toxic, with all their columns; a filter inside the scan."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            keep = [model.probability(model.evidence(n, found)) < 0.5 for n, found in model.rows(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
