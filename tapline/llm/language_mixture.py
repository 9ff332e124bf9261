"""Language identification by multilingual mixture inference.

Training counts byte trigrams (ASCII letters lower-cased, other ASCII bytes as
gaps, bytes above 0x7F as they are) of all labelled training texts, summed per
language in hashed buckets by a distributed aggregate.  The model is one table
of BUCKETS log-probabilities per language, so its size is fixed by the number of
languages (checked against MAX_LANGUAGES before it is collected and shipped).

Every document is a mixture of languages: expectation-maximisation estimates the
proportions from its trigrams' likelihoods.  The language set is chosen by
penalised likelihood: languages with a proportion of at least LEAST_SHARE are
added to the best one, in order of proportion, as long as the mixture's
log-likelihood grows by more than PENALTY * log(number of trigrams).  The
predicted language is the largest of the chosen set.

Rows: null texts and texts without a letter give ``und`` with score 0;
documents whose training label is null teach nothing; with no training rows at
all every text is ``und``; repeated rows are predicted alike; extra columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcols as T
from .scratch import stored

BUCKETS = 1 << 16
MAX_LANGUAGES = 1_000
STEPS, LEAST_SHARE, PENALTY = 10, 0.02, 2.0
#: Added to every bucket of a language, as a share of its trigrams; the model's floor.
SMOOTHING = 1e-6

#: Gap byte for ASCII that is no letter.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every trigram that holds a letter byte and does not cross texts, row of each)."""
    n = len(data)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    # a gap stands before and after every text
    at = np.arange(n) + 2 * rows + 1
    wide = np.full(n + 2 * (len(offs) - 1), 0x20, np.uint8)
    wide[at] = _FOLD[data]
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs) + 2)
    x = wide.astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    ok = (owner[:-2] == owner[2:]) & (wide[1:-1] != 0x20)
    bucket = (code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return bucket.astype(np.int64), owner[:-2][ok]


def fold_of(id_column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def counts(train: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """(lang, bucket, n) over all rows with a language; summed before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int64)
            for lo, hi in T.steps(batch.column(0)):
                bucket, row = trigrams(*T.buffer_of(batch.column(0).slice(lo, hi - lo)))
                n = np.bincount(code[lo:hi][row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for i, name in enumerate(names):
                    if name not in total:
                        total[name] = np.zeros(BUCKETS, np.int64)
                    total[name] += n[i]
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
                                             names=["lang", "bucket", "n"])

    rows = train.where(F.col(lang_column).isNotNull()).select(text_column, F.col(lang_column).cast("string"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram probabilities per language; ``infer`` gives the chosen language and its share for every row."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs = langs
        share = table / np.maximum(1, table.sum(axis=1, keepdims=True)) + SMOOTHING
        self.p = np.ascontiguousarray((share / share.sum(axis=1, keepdims=True)).T.astype(np.float32))  # (bucket, language)

    def infer(self, bucket: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the predicted language or -1, its share) per row."""
        k = len(self.langs)
        best, score = np.full(n_rows, -1, np.int64), np.zeros(n_rows)
        if not len(bucket) or not k:
            return best, score
        cell, weight = np.unique(row * BUCKETS + bucket, return_counts=True)
        row, p, weight = cell // BUCKETS, self.p[cell % BUCKETS], weight.astype(np.float32)
        rows, first = np.unique(row, return_index=True)
        at = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(row))))
        total = np.add.reduceat(weight, first)
        pi = np.full((len(rows), k), 1.0 / k, np.float32)
        for _ in range(STEPS):
            part = p * pi[at]
            part *= (weight / part.sum(axis=1))[:, None]
            pi = np.add.reduceat(part, first, axis=0) / total[:, None]
        order = np.argsort(-pi, axis=1, kind="stable")
        chosen = np.zeros_like(pi)
        chosen[np.arange(len(rows)), order[:, 0]] = 1.0
        likelihood = lambda w: np.add.reduceat(weight * np.log(np.maximum((p * w[at]).sum(axis=1), 1e-30)), first)
        have, growing = likelihood(chosen), np.ones(len(rows), bool)
        for j in range(1, k):
            nxt = order[:, j]
            share = pi[np.arange(len(rows)), nxt]
            growing &= share >= LEAST_SHARE
            if not growing.any():
                break
            trial = np.where(chosen > 0, pi, 0)
            trial[np.arange(len(rows)), nxt] = share
            trial /= trial.sum(axis=1, keepdims=True)
            value = likelihood(trial)
            growing &= value - have > PENALTY * np.log(total + 1)
            chosen[growing] = trial[growing]
            have = np.where(growing, value, have)
        best[rows] = chosen.argmax(axis=1)
        score[rows] = np.clip(chosen.max(axis=1), 0, 1)
        return best, score


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Mixture:
    """Count all given rows and collect the fixed-size model."""
    found = stored(counts(docs, text_column, lang_column), "trigrams")
    langs = [r[0] for r in found.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the model holds {BUCKETS} numbers for each")
    table = np.zeros((len(langs), BUCKETS))
    for lang, bucket, n in found.toLocalIterator():
        table[langs.index(lang), bucket] = n
    return Mixture(langs, table)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _languages(batch_text: pa.Array, model: Mixture) -> tuple[list[str], np.ndarray]:
    langs, scores = [], []
    for lo, hi in T.steps(batch_text):
        part = batch_text.slice(lo, hi - lo)
        data, offs = T.buffer_of(part)
        best, score = model.infer(*trigrams(data, offs), hi - lo)
        ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[data] != 0x20) & (data < 0x80))])[offs]
        for r in range(hi - lo):
            if best[r] < 0 or ascii_letter[r + 1] == ascii_letter[r] and not has_letter(part[r].as_py()):
                best[r], score[r] = -1, 0.0
        langs += [model.langs[b] if b >= 0 else "und" for b in best.tolist()]
        scores.append(score)
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: Mixture, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (share of the predicted language)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _languages(batch.column(1), shipped.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(id_column, text_column).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Mixture, least: float = 0.3, text_column: str = "text") -> DataFrame:
    """Documents in a language: not ``und``, and the predicted language has at least ``least`` of the text.  All columns stay."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _languages(batch.column(at), shipped.value)
            yield batch.filter(pa.array((np.array(langs, object) != "und") & (scores >= least)))

    return docs.mapInArrow(run, docs.schema)
