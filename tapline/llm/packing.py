"""Best-fit packing of token sequences with a bounded number of open bins.

Every document becomes token ids plus one end id.  A document longer than a
sequence is cut into whole sequences behind a first piece that takes the rest;
whole pieces are sequences of their own.  The shorter pieces are packed online
by best fit: each task keeps a fixed number of open bins, indexed by free space
in a bitset, puts a piece into the open bin whose free space fits it closest,
and closes the fullest bin when it needs another one.

Pieces are dealt to tasks by a hash of their document and position, so a hot
source or a long document never meets in one task; each task packs about
``PIECES_PER_TASK`` pieces, whatever the size of the input.

Rows: null or empty text is one piece that holds the end id only; repeated
doc_ids are packed as often as they occur; only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as T
from .fst_tokens import WORD_CACHE, Pretokens, vocabulary_bytes
from .scratch import stored

#: Open bins of a task, and pieces a task packs.
OPEN_BINS = 1024
PIECES_PER_TASK = 65_536

_ENCODERS: dict[int, "WordIds"] = {}


class WordIds:
    """Token ids of pre-tokens by the library, kept per worker; a full cache is emptied, results do not change.

    With ``plain``, the strings of special tokens are ordinary text.
    """

    def __init__(self, vocabulary: bytes, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.encode_special_tokens = plain
        self.plain = plain
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: bytes an id stands for: one a character of a byte-level entry, UTF-8 of an added one
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.offs = np.zeros(1, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each): one call of the library, cut where the ids' bytes end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        ends, byte_ends = np.cumsum([len(w.encode()) for w in words]), np.cumsum(self.width[ids])
        cuts = np.searchsorted(byte_ends, ends) + 1
        if len(ids) and cuts[-1] == len(ids) and np.array_equal(byte_ends[cuts - 1], ends):
            return ids, np.diff(cuts, prepend=0)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]  # ids do not spell the bytes
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def flat_ids(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows); one step of work."""
        pre = Pretokens(array, b"") if self.plain else Pretokens(array)
        hashes, at, codes = pre.distinct()
        if len(self.slot) >= WORD_CACHE:
            self.clear()
        slot, known = self.slot, hashes.tolist()
        new = [i for i, h in enumerate(known) if h not in slot]
        if new:
            ids, sizes = self._encoded(pre.texts(at[new]))
            for i in new:
                slot[known[i]] = len(slot)
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, ids])
            self.offs = np.concatenate([[0], np.cumsum(self.sizes)])
        slots = np.fromiter(map(slot.__getitem__, known), np.int64, len(known))[codes]
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offs[slots] - (ends - sizes), sizes)]
        return flat, np.concatenate([[0], ends])[pre.row_offs]

    def rows(self, array: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Ids of every row, the end id last."""
        for lo, hi in T.steps(array):
            flat, cuts = self.flat_ids(array.slice(lo, hi - lo))
            for a, b in zip(cuts[:-1], cuts[1:]):
                row = np.empty(b - a + 1, dtype="<u4")
                row[:-1] = flat[a:b]
                row[-1] = end_id
                yield row


def _encoder(vocabulary: bytes) -> WordIds:
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordIds(vocabulary)
    return _ENCODERS[key]


def cut_points(n: int, size: int) -> list[int]:
    """Starts of the pieces of n ids: whole pieces of ``size``, what is left over goes first."""
    if n <= size:
        return [0]
    rest = n % size
    return ([0] if rest else []) + list(range(rest, n, size))


def pieces(docs: DataFrame, vocabulary_path: str, size: int = 1024, end_id: int = 2, id_column: str = "doc_id",
           text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents' pieces: doc_id, piece, start, length, ids_crc32 and, if asked, the ids.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary_path))
    id_type = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, whole in enumerate(encoder.rows(batch.column(1), end_id)):
                cuts = cut_points(len(whole), size)
                for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(whole)])):
                    owner.append(row)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(whole[a:b].tobytes()))
                    if with_ids:
                        ids.append(whole[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_column, text_column).mapInArrow(run, schema)


class OpenBins:
    """Online best fit over at most ``limit`` open bins; a bitset marks the free spaces that some open bin has."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            bin_id, free = self.made, self.size
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return bin_id, self.size - free


def pack(cut: DataFrame, size: int = 1024, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to pieces (columns of ``pieces``; read twice, so pass a stored table).

    Whole pieces get sequence ids without a shuffle; the others are dealt out by
    hash and packed in the order of another hash, ties by all columns, so a task
    that runs again packs the same way.
    """
    whole = cut.where(F.col("length") >= size).withColumn(
        "sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    short = cut.where(F.col("length") < size)
    tasks = max(1, -(-short.count() // pieces_per_task))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = short.withColumn("_o", order).repartition(tasks, "_o")
    dealt = dealt.sortWithinPartitions("_o", "doc_id", "piece", "ids_crc32").drop("_o")
    names, at = dealt.columns, dealt.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, mark = OpenBins(size, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [bins.put(n) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([(mark | b) * 2 for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long"
    return whole.unionByName(dealt.mapInArrow(run, schema))


def pack_documents(docs: DataFrame, vocabulary_path: str, size: int = 1024, end_id: int = 2, id_column: str = "doc_id",
                   text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut and pack documents; one row per piece.  The cut table goes to the shared folder, tokenisation runs once."""
    return pack(stored(pieces(docs, vocabulary_path, size, end_id, id_column, text_column, with_ids), "pieces"), size)
