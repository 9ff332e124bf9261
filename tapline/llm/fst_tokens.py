"""Token counts by compiled finite-state transducers.

Two deterministic transducers replace the byte-level BPE encoder:

* The *splitter* reads character classes and emits the starts of pre-tokens.
  It has 12 states, so a chunk of text is a map state -> state.  All chunks are
  run from all 12 states at once, the chunk maps are composed by a parallel
  prefix scan, and a second run from the true entry states emits the starts.
* The *counter* reads the bytes of one pre-token.  Every transition carries the
  change in the number of tokens, so the sum along a path is the token count.
  Its states (suffix-automaton node plus the last tokens and counts that can
  still matter) are compiled on first use and kept per worker.

The counter relies on two properties of BPE encodings: the encoding of a prefix
ends in exactly one token, and a sequence is an encoding if and only if all its
neighbouring pairs are.  The counts equal the library's; tests compare them.

Rows: null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated results; other columns are never read.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textcols as T

#: Distinct pre-tokens and compiled states kept per worker; a full cache is emptied, results do not change.
WORD_CACHE, STATE_CACHE, PAIR_CACHE = 250_000, 120_000, 300_000
#: Characters of a chunk whose state map is computed alone; after so many its entry states have mostly met.
CHUNK, MEET = 128, 8
#: Largest vocabulary file that is sent to the executors whole.
MAX_VOCABULARY_BYTES = 64 << 20

# -- the splitter ---------------------------------------------------------

# character classes
SP, WS, NUM, OTHER, APOS, LETTER, SHORT, R, V, E, LL, END, SPECIAL, REST = range(14)
# states: what the pending pre-token is
(BOUNDARY, LETTERS, NUMBERS, OTHERS, SPACE1, SPACES, WHITE1, WHITES, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L) = range(12)
STATES, CLASSES = 12, 16
HERE, BEFORE = 1, 2  # a pre-token starts at this character, at the one before it

_LETTERS = {LETTER, SHORT, R, V, E, LL}

# Letters and digits of Unicode 16 that Python's character data may lack.
UNICODE_16_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
UNICODE_16_DIGITS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def _start(c: int) -> tuple[int, int]:
    """A pre-token begins with class c."""
    if c in _LETTERS:
        return LETTERS, HERE
    return {SP: SPACE1, WS: WHITE1, NUM: NUMBERS, OTHER: OTHERS, APOS: QUOTE}[c], HERE


def _run(c: int) -> int:
    """State after class c joined a pending space or run."""
    return LETTERS if c in _LETTERS else {NUM: NUMBERS, OTHER: OTHERS, APOS: OTHERS}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """(next state, starts emitted) of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|space+(?!\\S)|space+."""
    half = state in (QUOTE_R, QUOTE_V, QUOTE_L)
    if c in (END, SPECIAL):
        return BOUNDARY, HERE | (BEFORE if half else 0)
    if c == REST:
        return BOUNDARY, 0
    if half:
        if c == {QUOTE_R: E, QUOTE_V: E, QUOTE_L: LL}[state]:
            return BOUNDARY, 0
        nxt, emitted = (LETTERS, 0) if c in _LETTERS else _start(c)
        return nxt, emitted | BEFORE
    if state == LETTERS and c in _LETTERS or state == NUMBERS and c == NUM:
        return state, 0
    if state == OTHERS and c in (OTHER, APOS):
        return OTHERS, 0
    if state in (SPACE1, SPACES, WHITE1, WHITES):
        if c in (SP, WS):
            return (SPACES if c == SP else WHITES), 0
        if state == SPACE1:
            return _run(c), 0
        if state == SPACES:
            return _run(c), BEFORE
        nxt, emitted = _start(c)
        return nxt, emitted | (BEFORE if state == WHITES else 0)
    if state == QUOTE:
        if c == SHORT:
            return BOUNDARY, 0
        if c in (R, V, LL):
            return {R: QUOTE_R, V: QUOTE_V, LL: QUOTE_L}[c], 0
        if c in (OTHER, APOS):
            return OTHERS, 0
    return _start(c)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    nxt = np.zeros(STATES * CLASSES, np.uint8)
    out = np.zeros(STATES * CLASSES, np.uint8)
    for s in range(STATES):
        for c in range(14):
            nxt[s * CLASSES + c], out[s * CLASSES + c] = _step(s, c)
    return nxt * CLASSES, out  # states are kept times CLASSES


NEXT, EMIT = _tables()
SENTINEL = 0x110000
_CLASS_OF: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Class of every code point; the sentinel closes a text."""
    if not _CLASS_OF:
        table = np.full(SENTINEL + 1, OTHER, np.uint8)
        category = unicodedata.category
        for cp in range(SENTINEL):
            k = category(chr(cp))[0]
            if k == "L":
                table[cp] = LETTER
            elif k == "N":
                table[cp] = NUM
            elif k == "Z":
                table[cp] = WS
        for ranges, k in ((UNICODE_16_LETTERS, LETTER), (UNICODE_16_DIGITS, NUM)):
            for lo, hi in ranges:
                table[lo:hi + 1] = k
        table[[*range(0x09, 0x0E), 0x85]] = WS
        table[0x20] = SP
        table[ord("'")] = APOS
        for c in "stmd":
            table[ord(c)] = SHORT
        for c, k in (("r", R), ("v", V), ("e", E), ("l", LL)):
            table[ord(c)] = k
        table[SENTINEL] = END
        _CLASS_OF.append(table)
    return _CLASS_OF[0]


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Exclusive prefix composition of chunk maps: row i maps an entry state through chunks 0..i-1 (Hillis-Steele)."""
    n, states = maps.shape
    acc = np.empty_like(maps)
    acc[0] = np.arange(states)
    acc[1:] = maps[:-1]
    gap = 1
    while gap < n:
        acc[gap:] = np.take_along_axis(acc[gap:], acc[:-gap].astype(np.intp), axis=1)
        gap *= 2
    return acc


def split(classes: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start (sentinels included)."""
    n = len(classes)
    rows = -(-n // CHUNK)
    cols = np.full(rows * CHUNK, END, np.uint8)
    cols[:n] = classes
    cols = np.ascontiguousarray(cols.reshape(rows, CHUNK).T)
    # all entry states until they meet, which most do within a few characters; the rest go on alone
    state = np.repeat((np.arange(STATES, dtype=np.uint8) * CLASSES)[:, None], rows, axis=1)
    for j in range(MEET):
        state = NEXT[state + cols[j]]
    apart = np.flatnonzero((state != state[0]).any(axis=0))
    one, many = state[0], state[:, apart]
    for j in range(MEET, CHUNK):
        one = NEXT[one + cols[j]]
        if len(apart):
            many = NEXT[many + cols[j][apart]]
    state = np.repeat(one[None, :], STATES, axis=0)
    state[:, apart] = many
    entry = compose_scan(np.ascontiguousarray((state // CLASSES).T))[:, BOUNDARY]
    state = entry * np.uint8(CLASSES)
    emitted = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        at = state + cols[j]
        emitted[j] = EMIT[at]
        state = NEXT[at]
    flat = np.ascontiguousarray(emitted.T).reshape(-1)[:n]
    starts = (flat & HERE).astype(bool)
    starts[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts)


class Pretokens:
    """The pre-tokens of some rows: code points with a sentinel behind each row, spans, hashes, row offsets."""

    def __init__(self, array: pa.Array, special: bytes = b"<|endoftext|>"):
        data, offs = T.buffer_of(array)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        char_offs = heads[offs]
        self.points = np.insert(points, char_offs[1:], SENTINEL) if len(offs) > 1 else points
        classes = class_table()[self.points]
        row_at = char_offs[:-1] + np.arange(len(offs) - 1)
        at = raw.find(special) if special else -1
        while at >= 0:
            r = int(np.searchsorted(offs, at, side="right")) - 1
            if at + len(special) <= offs[r + 1]:
                c = int(heads[at]) + r
                classes[c] = SPECIAL
                classes[c + 1:c + len(special)] = REST
                at += len(special) - 1
            at = raw.find(special, at + 1)
        starts = split(classes)
        ends = np.append(starts[1:], len(self.points))
        real = classes[starts] != END
        self.starts, self.ends = starts[real], ends[real]
        self.hashes = T.span_hashes(self.points, self.starts, self.ends)
        self.row_offs = np.searchsorted(self.starts, np.append(row_at, len(self.points)))
        self.n_bytes = np.diff(offs)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, an occurrence of each, index of every pre-token's hash among them)."""
        codes, hashes = pd.factorize(self.hashes)
        at = np.empty(len(hashes), np.int64)
        at[codes] = np.arange(len(codes))
        return hashes, at, codes

    def text(self, i: int) -> str:
        return self.points[self.starts[i]:self.ends[i]].tobytes().decode("utf-32-le")

    def texts(self, at: np.ndarray) -> list[str]:
        """``text`` of many pre-tokens: the points are decoded once, the pre-tokens are slices."""
        whole = np.where(self.points == SENTINEL, 0, self.points).astype("<u4").tobytes().decode("utf-32-le")
        return [whole[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist())]


# -- the counter ----------------------------------------------------------

def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeCounter:
    """Weighted transducer of one byte-level BPE vocabulary, compiled state by state.

    A state is a node of the tokens' suffix automaton together with, for every
    suffix of the input that begins some token, the token and the count that
    stood before that suffix.  Nothing else can influence what follows.
    """

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        back = byte_symbols()
        as_bytes = lambda s: bytes(back[c] for c in s)
        ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        size = max(ids.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merge: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            x, y = (as_bytes(p) for p in (m if isinstance(m, list) else m.split(" ")))
            t = ids[x + y]
            self.merge[ids[x], ids[y]] = r
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, ids[x], ids[y]
        self._pair_ok: dict[int, bool] = {}
        reachable = lambda t: self.rank[t] < 0 or self._stable(self.left[t], self.right[t], self.rank[t])
        self._build({t: i for t, i in ids.items() if len(t) == 1 or self.rank[i] >= 0 and reachable(i)})
        self.reset()

    def _stable(self, a: int, b: int, until: int = 1 << 60) -> bool:
        """Whether tokens a and b stay apart until merge ``until``.

        Walks back in time: the part that was made last is taken apart, and the
        two parts that touch must not have had a merge of their own before one
        of them was used up.  Equal merges happen from left to right.
        """
        end_a = end_b = until
        rank, merge = self.rank, self.merge
        while True:
            m = merge.get((a, b))
            if m is not None and m < end_a and (m <= end_b if end_b != until else m < until):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                end_a, a = ra, self.right[a]
            else:
                end_b, b = rb, self.left[b]

    def _build(self, tokens: dict[bytes, int]) -> None:
        """Suffix automaton of the tokens: goto, failure links, and per node the tokens that end there and the depths of its suffixes."""
        self.goto: list[dict[int, int]] = [{}]
        depth, own = [0], [-1]
        for t, i in tokens.items():
            node = 0
            for b in t:
                nxt = self.goto[node].get(b)
                if nxt is None:
                    nxt = self.goto[node][b] = len(self.goto)
                    self.goto.append({})
                    depth.append(depth[node] + 1)
                    own.append(-1)
                node = nxt
            own[node] = i
        self.fail = [0] * len(self.goto)
        #: depths of the suffixes that begin a token, deepest first, 0 last; (length, token) that end here, longest first
        self.depths: list[tuple[int, ...]] = [(0,)] * len(self.goto)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.goto)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, nxt in self.goto[node].items():
                queue.append(nxt)
                f = self.fail[node]
                while f and b not in self.goto[f]:
                    f = self.fail[f]
                f = self.fail[nxt] = self.goto[f].get(b, 0) if node else 0
                self.depths[nxt] = (depth[nxt], *self.depths[f])
                self.ending[nxt] = (((depth[nxt], own[nxt]),) if own[nxt] >= 0 else ()) + self.ending[f]

    def reset(self) -> None:
        self.states: list[tuple] = [(0, (-1, 0))]
        self.index = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _pair(self, a: int, b: int) -> bool:
        ok = self._pair_ok.get(a << 20 | b)
        if ok is None:
            if len(self._pair_ok) > PAIR_CACHE:
                self._pair_ok.clear()
            ok = self._pair_ok[a << 20 | b] = self._stable(a, b)
        return ok

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """Transition of a state on a byte: (next state, change in the token count)."""
        key = self.states[state]
        node = key[0]
        before = dict(zip(self.depths[node], key[1:]))
        while node and byte not in self.goto[node]:
            node = self.fail[node]
        node = self.goto[node].get(byte, 0)
        for length, token in self.ending[node]:
            last, count = before[length - 1]
            if last == -1 or self._pair(last, token):
                delta = count + 1
                break
        else:
            raise ValueError(f"byte {byte} has no token")
        kept = [(token, 0) if d == 0 else (before[d - 1][0], before[d - 1][1] - delta) for d in self.depths[node]]
        made = (node, *kept)
        nxt = self.index.get(made)
        if nxt is None:
            nxt = self.index[made] = len(self.states)
            self.states.append(made)
        self.moves[state << 8 | byte] = nxt, delta
        return nxt, delta

    def count(self, word: bytes) -> int:
        if len(self.states) > STATE_CACHE:
            self.reset()
        state = total = 0
        moves = self.moves
        for b in word:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self._compile(state, b)
            state = move[0]
            total += move[1]
        return total


# -- Spark ----------------------------------------------------------------

def vocabulary_bytes(path: str) -> bytes:
    """The vocabulary file, read by the driver; its size is checked because it is broadcast."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: vocabulary of more than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


_COUNTERS: dict[int, tuple[BpeCounter, dict[int, int]]] = {}


def _counter(vocabulary: bytes) -> tuple[BpeCounter, dict[int, int]]:
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = BpeCounter(vocabulary), {}
    return _COUNTERS[key]


def count_rows(array: pa.Array, vocabulary: bytes) -> np.ndarray:
    """Token count of every row of a string array."""
    counter, known = _counter(vocabulary)
    out = []
    for lo, hi in T.steps(array):
        pre = Pretokens(array.slice(lo, hi - lo))
        distinct, first, inverse = pre.distinct()
        counts = np.empty(len(distinct), np.int64)
        for i, h in enumerate(distinct.tolist()):
            n = known.get(h)
            if n is None:
                if len(known) >= WORD_CACHE:
                    known.clear()
                word = pre.text(int(first[i]))
                n = known[h] = 1 if word == "<|endoftext|>" else counter.count(word.encode())
            counts[i] = n
        acc = np.concatenate([[0], np.cumsum(counts[inverse])])
        out.append(acc[pre.row_offs[1:]] - acc[pre.row_offs[:-1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text",
                 limit: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A map over the scan: no shuffle.  Null text: 0 bytes, 0 tokens.  A null id
    stays null.  Ties and repeated rows are kept as they are.  Only the two
    named columns are read, so further columns cannot clash.
    """
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary_path))
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_rows(batch.column(1), shipped.value)
            _, offs = T.buffer_of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offs)), pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_column, text_column).mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
