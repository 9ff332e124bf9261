"""Alignment of two tokenizers' tokens by windows between whitespace anchors.

Every text is tokenised whole: space + text by a byte-level BPE (A) and text by
a sentence-piece model that adds the space itself (B).  Rows whose token bytes do not
spell space + text on both sides have no tokens.  Places where a token of A and
a token of B both end are shared ends.  A shared end before a space (the next
token of either side is space-marked) is an anchor; anchors split a text into
windows of token ids.  A window's alignment (its groups between shared ends, the links of each
group, the digest text) depends on its two id tuples only, so it is computed
once and kept by them; a full memory is emptied, results do not change.

The links of a document leave the tasks as distinct id pairs with their
multiplicity.  A pair's count is the number of documents that hold it: one
aggregate, combined before the shuffle.  The table of counts (at most ids x ids
rows, whatever the number of documents) goes back to the documents' pairs by a
join, broadcast only up to ``BROADCAST_PAIRS`` rows.

Rows: null, empty and differing texts give zeros and '' as digest; a null id
stays null; repeated rows count as documents of their own; an empty table gives
no rows; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcols as T
from .fst_tokens import byte_symbols, vocabulary_bytes
from .packing import WordIds
from .scratch import stored

#: Windows and token ids kept per worker.
WINDOWS, WINDOW_IDS = 250_000, 4_000_000
#: Bytes of text in a step: equal windows of a step are looked up once.
STEP = 1 << 20
#: The pair counts are broadcast up to this many rows (about 60 MB), joined by a shuffle beyond.
BROADCAST_PAIRS = 1_500_000
#: Groups of at most so many links are multiplied out together, a larger one by its distinct ids.
FEW_LINKS = 1024
#: Above every pair code (the product of both vocabularies' sizes).
SPAN = 1 << 40


class Spelling:
    """The bytes of every token id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(joined bytes of the ids, end of each)."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - n), n)], ends


def byte_level(vocabulary: bytes) -> Spelling:
    """Bytes of a byte-level BPE's entries."""
    of = byte_symbols()
    entries = json.loads(vocabulary)["model"]["vocab"]
    tokens = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        tokens[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    return Spelling(tokens)


def pieces_of(model) -> Spelling:
    """Bytes of a sentence-piece model's pieces: U+2581 is a space, <0xHH> a byte."""
    return Spelling([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                     for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))])


def _expand(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] numbers), starts[1], ..."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def _before(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


class Aligned:
    """Alignments of some windows laid end to end, a, b: ids; cut_a, cut_b: offsets of the windows."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, width: int):
        a, b = a.astype(np.int64), b.astype(np.int64)
        end_a, end_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
        shared = end_a[np.isin(end_a, end_b, assume_unique=True)]
        of_a, of_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)  # group of every token
        n_a, n_b = np.bincount(of_a, minlength=len(shared)), np.bincount(of_b, minlength=len(shared))
        at_b = _before(n_b)
        window = np.searchsorted(end_a[cut_a[1:] - 1], shared)  # a window's last token ends it
        m = len(cut_a) - 1
        self.groups = np.bincount(window, minlength=m)
        self.links = np.zeros(m, np.int64)
        np.add.at(self.links, window, n_a * n_b)
        # pairs: small groups by one product of all, larger ones by their distinct ids
        small = n_a * n_b <= FEW_LINKS
        x = np.flatnonzero(small[of_a])
        reps = n_b[of_a[x]]
        key = [np.repeat(window[of_a[x]] * SPAN + a[x] * width, reps) + b[_expand(at_b[of_a[x]], reps)]]
        times = [np.ones(len(key[0]), np.int64)]
        at_a = _before(n_a)
        for g in np.flatnonzero(~small):
            (xs, nx), (ys, ny) = np.unique(a[at_a[g]:at_a[g + 1]], return_counts=True), np.unique(b[at_b[g]:at_b[g + 1]], return_counts=True)
            key.append((window[g] * SPAN + xs[:, None] * width + ys).ravel())
            times.append((nx[:, None] * ny).ravel())
        cell, where = np.unique(np.concatenate(key), return_inverse=True)
        self.times = np.zeros(len(cell), np.int64)
        np.add.at(self.times, where, np.concatenate(times))
        self.codes, self.pair_cut = cell % SPAN, np.searchsorted(cell, np.arange(m + 1) * SPAN)
        # digest text: every id in decimal, then its separator; a group's A ids stand before its B ids
        n = len(a) + len(b)
        ids, sep = np.empty(n, np.int64), np.empty(n, np.uint8)
        place_a, place_b = np.arange(len(a)) + at_b[of_a], np.arange(len(b)) + at_a[of_b + 1]
        ids[place_a], ids[place_b] = a, b
        sep[place_a] = np.where(np.diff(of_a, append=-1) != 0, ord("|"), ord(","))
        sep[place_b] = np.where(np.diff(of_b, append=-1) != 0, ord(";"), ord(","))
        size = 1 + sum((ids >= 10 ** k).astype(np.int64) for k in range(1, 7))
        ends = np.cumsum(size + 1)
        out = np.empty(ends[-1] if n else 0, np.uint8)
        out[ends - 1] = sep
        rest = ids
        for k in range(7):
            here = size > k
            out[ends[here] - 2 - k] = rest[here] % 10 + ord("0")
            rest = rest // 10
        self.text, self.text_cut = out.tobytes(), np.concatenate([[0], ends])[cut_a + cut_b]

    def digest_text(self, w: int) -> bytes:
        """Groups of window w, each with a closing semicolon."""
        return self.text[self.text_cut[w]:self.text_cut[w + 1]]


class Aligner:
    """Both tokenizers and the windows seen so far, kept per worker."""

    def __init__(self, vocabulary: bytes, model: bytes):
        import sentencepiece

        self.encode_a = WordIds(vocabulary, plain=True)
        self.encode_b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a, self.b = byte_level(vocabulary), pieces_of(self.encode_b)
        self.width = len(self.b.sizes)
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.n_ids, self.texts = 0, []
        self.groups, self.links, self.sizes = (np.zeros(0, np.int64) for _ in range(3))
        self.codes, self.times, self.offs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, new: np.ndarray, keys: list[tuple[bytes, bytes]]) -> None:
        """Align the windows numbered ``new``."""
        n_a, n_b = np.diff(cut_a)[new], np.diff(cut_b)[new]
        made = Aligned(a[_expand(cut_a[new], n_a)], b[_expand(cut_b[new], n_b)], _before(n_a), _before(n_b), self.a.sizes, self.b.sizes, self.width)
        for i, key in enumerate(keys):
            self.known[key] = len(self.texts)
            self.texts.append(made.digest_text(i))
        self.n_ids += int(n_a.sum() + n_b.sum())
        self.groups, self.links = np.concatenate([self.groups, made.groups]), np.concatenate([self.links, made.links])
        self.sizes = np.concatenate([self.sizes, np.diff(made.pair_cut)])
        self.codes, self.times = np.concatenate([self.codes, made.codes]), np.concatenate([self.times, made.times])
        self.offs = _before(self.sizes)

    def _windows(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """Number of every window's alignment; equal windows of the step are looked up once."""
        h = T.span_hashes(a, cut_a[:-1], cut_a[1:]) * np.uint64(3) + T.mix(T.span_hashes(b, cut_b[:-1], cut_b[1:]))
        codes, distinct = pd.factorize(h)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        for ids, cut in ((a, cut_a), (b, cut_b)):  # equal hashes must stand for equal ids
            n = np.diff(cut)
            if not (np.array_equal(n, n[first[codes]]) and np.array_equal(ids, ids[_expand(cut[first[codes]], n)])):
                first = codes = np.arange(len(h))
                break
        raw_a, raw_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        x, y = (4 * cut_a).tolist(), (4 * cut_b).tolist()
        keys = [(raw_a[x[w]:x[w + 1]], raw_b[y[w]:y[w + 1]]) for w in first.tolist()]
        if len(self.known) >= WINDOWS or self.n_ids >= WINDOW_IDS:
            self.clear()
        new = {k: w for k, w in zip(keys, first.tolist()) if k not in self.known}
        if new:
            self._learn(a, b, cut_a, cut_b, np.fromiter(new.values(), np.int64, len(new)), list(new))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[codes]

    def step(self, array: pa.Array) -> list[pa.Array]:
        """Columns n_a, n_b, n_groups, n_links, digest, codes, times of some rows."""
        n_rows = len(array)
        array = pc.fill_null(array, "")
        spaced = pc.binary_join_element_wise(" ", array, "")
        a, off_a = self.encode_a.flat_ids(spaced)
        lists = self.encode_b.encode(array.to_pylist(), num_threads=1)
        b = np.fromiter(chain.from_iterable(lists), np.uint32)
        off_b = _before(np.fromiter(map(len, lists), np.int64, n_rows))
        # rows that both sides spell
        data, offs = T.buffer_of(spaced)
        (bytes_a, end_a), (bytes_b, end_b) = self.a(a), self.b(b)
        at_a, at_b = np.concatenate([[0], end_a])[off_a], np.concatenate([[0], end_b])[off_b]
        good = np.array([r for r in range(n_rows) if offs[r + 1] - offs[r] > 1 and
                         np.array_equal(bytes_a[at_a[r]:at_a[r + 1]], data[offs[r]:offs[r + 1]]) and
                         np.array_equal(bytes_b[at_b[r]:at_b[r + 1]], data[offs[r]:offs[r + 1]])], np.int64)
        counts, digests = np.zeros((4, n_rows), np.int64), [""] * n_rows
        codes = times = np.zeros(0, np.int64)
        pair_cut = np.zeros(n_rows + 1, np.int64)
        if len(good):
            pick = lambda values, off: values[_expand(off[good], off[good + 1] - off[good])]
            a, b, data = pick(a, off_a), pick(b, off_b), pick(data, offs)
            row_end = np.cumsum(offs[good + 1] - offs[good])
            end_a, end_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
            # anchors: shared ends before a space, and the rows' own ends
            ends = np.zeros(len(data) + 1, np.int8)
            ends[end_a] += 1
            ends[end_b] += 1
            anchor = ends == 2
            anchor[:-1] &= data == 0x20
            anchor[row_end] = True
            anchors = np.flatnonzero(anchor)
            cut = lambda e: np.concatenate([[0], np.searchsorted(e, anchors, side="right")])
            window = self._windows(a, b, cut(end_a), cut(end_b))
            last = np.searchsorted(anchors, row_end, side="right")
            row = np.repeat(good, np.diff(last, prepend=0))
            # links of a row: the pairs of its windows, added up
            n = self.sizes[window]
            at = _expand(self.offs[window], n)
            cell, where = np.unique(np.repeat(row, n) * SPAN + self.codes[at], return_inverse=True)
            codes, times = cell % SPAN, np.zeros(len(cell), np.int64)
            np.add.at(times, where, self.times[at])
            pair_cut = np.searchsorted(cell, np.arange(n_rows + 1) * SPAN)
            counts[0, good], counts[1, good] = (off_a[good + 1] - off_a[good]), (off_b[good + 1] - off_b[good])
            np.add.at(counts[2], row, self.groups[window])
            np.add.at(counts[3], row, self.links[window])
            texts = list(map(self.texts.__getitem__, window.tolist()))
            for r, lo, hi in zip(good.tolist(), [0, *last.tolist()], last.tolist()):
                digests[r] = hashlib.sha256(b"".join(texts[lo:hi])[:-1]).hexdigest()
        listed = lambda values: pa.ListArray.from_arrays(pa.array(pair_cut, pa.int32()), pa.array(values, pa.int64()))
        return [*[pa.array(c) for c in counts], pa.array(digests, pa.string()), listed(codes), listed(times)]


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(vocabulary: bytes, model: bytes) -> Aligner:
    key = hash((vocabulary, model))
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(vocabulary, model)
    return _ALIGNERS[key]


def aligned(docs: DataFrame, vocabulary_path: str, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes and times of its linked id pairs (code = A id * B ids + B id)."""
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary_bytes(vocabulary_path), vocabulary_bytes(model_path)))
    names = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shipped.value)
        for batch in batches:
            for lo, hi in T.steps(batch.column(2), STEP):
                columns = aligner.step(batch.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *columns], names=names)

    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column), F.col(text_column))
    return rows.mapInArrow(run, f"rid long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                "codes array<long>, times array<long>")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(code, n, top): documents that hold a pair, and whether no pair of its A id has more."""
    n = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    per_a = Window.partitionBy(F.expr(f"code div {width}"))
    return n.withColumn("top", F.col("n") == F.max("n").over(per_a))


def links(docs: DataFrame, vocabulary_path: str, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=os.fspath(model_path)).get_piece_size()
    rows = stored(aligned(docs, vocabulary_path, model_path, id_column, text_column), "aligned")
    counts = stored(pair_counts(rows, width), "pairs")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    held = rows.select("rid", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("rid", F.col("x.codes").alias("code"), "x.times")
    sums = held.join(counts, "code").groupBy("rid").agg(F.sum(F.expr("if(top, times, 0)")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.drop("codes", "times").join(sums, "rid", "left").select(
        F.col("doc_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
