"""Secrets: fixed base patterns, and formats inferred from the credentials they label.

Base patterns (leftmost, non-overlapping, per kind) give spans and, as labels,
the credentials of each kind.  Per kind a probabilistic automaton is inferred:
a prefix tree of the credentials is folded state by state, breadth first, and
two states merge if the Hoeffding bound finds their end and symbol frequencies,
and those of all their successors, compatible.  The tree holds the
``SAMPLE`` distinct credentials of at most ``LONGEST`` characters with the
smallest hashes; the automaton's probabilities are then counted over all
distinct credentials of all documents.

Every maximal run of credential characters of at least ``SHORTEST`` in any text
is a candidate.  Its likelihood under each automaton is weighed against a
first-order character model of all candidates; the prior of a kind is its share
of credentials among the candidates.  A candidate apart from all base spans
becomes a span ``<kind>_like`` of its likeliest kind if the odds exceed ``ODDS``.

Rows: null and empty texts have no spans (the digest is that of the empty
string); a null id stays null; repeated rows are scanned alike; kinds with fewer
than ``LEAST`` distinct credentials have no automaton; an empty table gives no
rows; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as T
from .scratch import stored

KINDS = ("assign", "access", "hex")
SAMPLE, LONGEST, LEAST, SHORTEST = 4_000, 256, 20, 6
#: Confidence of the merge test, pseudo-count of a state, odds a span needs.
ALPHA, PSEUDO, ODDS = 0.05, 1.0, 99.0
#: Longer candidates are scored one by one.
LANE = 1024

_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_SIZE = {"assign": 6, "access": 20, "hex": 24}

SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
END = len(SYMBOLS)  # also the background's start
N = END + 1
_SYMBOL = np.full(256, -1, np.int16)
_SYMBOL[np.frombuffer(SYMBOLS, np.uint8)] = np.arange(END)
_NOT_CANDIDATE = _SYMBOL < 0
_NOT_HEX = np.ones(256, bool)
_NOT_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = False


def _places(raw: bytes, word: bytes) -> Iterator[int]:
    at = raw.find(word)
    while at >= 0:
        yield at
        at = raw.find(word, at + 1)


def base_spans(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) in byte places, of all rows."""
    raw, low, found = data.tobytes(), T.LOWER[data].tobytes(), []

    def walk(kind: int, places: list[int], pattern: re.Pattern, group: int) -> None:
        done = 0
        for at, row_end in zip(places, offs[np.searchsorted(offs, places, side="right")].tolist() if places else []):
            if at >= done and (m := pattern.match(raw, at, row_end)):
                done = m.end()
                if m.end(group) - m.start(group) >= LEAST_SIZE[KINDS[kind]]:
                    found.append((kind, at, m.end(), m.start(group), m.end(group)))

    walk(0, sorted({p for k in _KEYS for p in _places(low, k)}), _ASSIGN, 2)
    walk(1, list(_places(raw, b"AKIA")), _ACCESS, 0)
    s, e = T.word_spans(data, offs, _NOT_HEX)
    long = e - s >= LEAST_SIZE["hex"]
    found += [(2, a, b, a, b) for a, b in zip(s[long].tolist(), e[long].tolist())]
    return found


def candidates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = T.word_spans(data, offs, _NOT_CANDIDATE)
    long = e - s >= SHORTEST
    return s[long], e[long]


# -- grammar inference ------------------------------------------------------

class Automaton:
    """Deterministic automaton: ``next[state]`` maps a symbol to a state; state 0 starts."""

    def __init__(self, next_states: list[dict[int, int]]):
        self.next = next_states


class _Tree:
    def __init__(self, words: list[bytes]):
        self.next, self.passed, self.ended = [{}], [0], [0]
        for word in words:
            at = 0
            self.passed[0] += 1
            for c in word:
                symbol = int(_SYMBOL[c])
                if symbol not in self.next[at]:
                    self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    self.passed.append(0)
                    self.ended.append(0)
                at = self.next[at][symbol]
                self.passed[at] += 1
            self.ended[at] += 1

    def compatible(self, a: int, b: int) -> bool:
        """Hoeffding test of both states and of all successors they share."""
        width, todo = math.sqrt(0.5 * math.log(2 / ALPHA)), [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if not n or not m:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:  # counts this small, and the smaller ones below, cannot differ
                continue
            if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                return False
            for symbol in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(symbol), self.next[b].get(symbol)
                if abs((self.passed[x] if x is not None else 0) / n - (self.passed[y] if y is not None else 0) / m) > bound:
                    return False
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for symbol, y in self.next[b].items():
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], y))
                else:
                    self.next[a][symbol] = y


def infer(words: list[bytes]) -> Automaton:
    """Merge the states of the words' prefix tree, nearest the root first."""
    tree, red, queue = _Tree(words), [0], [(0, s) for s in range(N)]
    seen = {0}
    while queue:
        parent, symbol = queue.pop(0)
        blue = tree.next[parent].get(symbol)
        if blue is None or blue in seen:
            continue
        for state in red:
            if tree.compatible(state, blue):
                tree.next[parent][symbol] = state
                tree.fold(state, blue)
                queue += [(r, s) for r in red for s, y in tree.next[r].items() if y not in seen]
                break
        else:
            red.append(blue)
            seen.add(blue)
            queue += [(blue, s) for s in sorted(tree.next[blue])]
    number = {state: i for i, state in enumerate(red)}
    return Automaton([{s: number[y] for s, y in sorted(tree.next[state].items())} for state in red])


# -- scoring ----------------------------------------------------------------

class Model:
    """Automata laid end to end behind a sink state that holds every symbol alike, the background, the priors."""

    def __init__(self, automata: dict[int, Automaton], priors: dict[int, float], background: np.ndarray):
        self.kinds, self.start, at = sorted(automata), [], 1
        for k in self.kinds:
            self.start.append(at)
            at += len(automata[k].next)
        self.next = np.zeros((at, N), np.int32)
        for k, first in zip(self.kinds, self.start):
            for i, row in enumerate(automata[k].next):
                for symbol, y in row.items():
                    self.next[first + i, symbol] = first + y
        self.prior = np.log(np.array([max(priors[k], 1e-300) for k in self.kinds])) if self.kinds else np.zeros(0)
        self.log_p = np.zeros((at, N))
        self.set_counts(np.zeros((at, N), np.int64))
        share = background.reshape(N, N) + 1.0
        self.log_background = np.log(share / share.sum(axis=1, keepdims=True))

    def set_counts(self, counts: np.ndarray) -> None:
        p = counts + PSEUDO / N
        self.log_p = np.log(p / p.sum(axis=1, keepdims=True))

    def paths(self, symbols: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Steps of all candidates at once: (candidates, their states of each kind, symbol); the last symbol is END."""
        size = e - s
        order = np.argsort(-size, kind="stable")
        state = np.repeat(np.array(self.start, np.int32)[:, None], len(s), axis=1)
        left = size[order]
        for j in range(int(left[0]) + 1 if len(left) else 0):
            going = order[:int(np.searchsorted(-left, -j, side="right"))]
            symbol = np.where(size[going] > j, symbols[np.minimum(s[going] + j, len(symbols) - 1)], END)
            yield going, state[:, going], symbol
            state[:, going] = self.next[state[:, going], symbol]

    def count(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Uses of every (state, symbol) by credentials of the given kinds."""
        out = np.zeros(self.next.size, np.int64)
        symbols = _SYMBOL[data].astype(np.int64)
        at = np.searchsorted(self.kinds, kind)
        for going, state, symbol in self.paths(symbols, s, e):
            own = state[at[going], np.arange(len(going))].astype(np.int64)
            out += np.bincount(own * N + symbol, minlength=out.size)
        return out.reshape(self.next.shape)

    def odds(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(likeliest kind, log odds against the background) of every candidate."""
        if not len(s) or not self.kinds:
            return np.zeros(len(s), np.int64), np.full(len(s), -np.inf)
        symbols = _SYMBOL[data].astype(np.int64)
        score = np.zeros((len(self.kinds), len(s)))
        short = e - s <= LANE
        i = np.flatnonzero(short)
        for going, state, symbol in self.paths(symbols, s[i], e[i]):
            score[:, i[going]] += self.log_p[state, symbol]
        for c in np.flatnonzero(~short):
            word = np.append(symbols[s[c]:e[c]], END).tolist()
            for k, at in enumerate(self.start):
                total = 0.0
                for symbol in word:
                    total += self.log_p[at, symbol]
                    at = self.next[at, symbol]
                score[k, c] = total
        # background: every symbol after the one before it
        size = e - s + 1
        at = np.arange(size.sum()) + np.repeat(s - (np.cumsum(size) - size), size)
        first = np.cumsum(size) - size
        now = symbols[np.minimum(at, len(symbols) - 1)]
        now[first + size - 1] = END
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[first] = END
        score -= np.add.reduceat(self.log_background[before, now], first)
        score += self.prior[:, None]
        best = score.argmax(0)
        return np.array(self.kinds)[best], score[best, np.arange(len(s))]


def background_counts(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Pairs (symbol before, symbol) over all candidates; END stands on either side."""
    symbols = _SYMBOL[data].astype(np.int64)
    inner = np.zeros(len(symbols) + 1, np.int64)
    inner[s] += 1
    inner[e] -= 1
    inside = np.cumsum(inner[:-1]) > 0
    start = np.zeros(len(symbols), bool)
    start[s] = True
    pair = inside[1:] & ~start[1:]
    out = np.bincount(symbols[:-1][pair] * N + symbols[1:][pair], minlength=N * N)
    return out + np.bincount(END * N + symbols[s], minlength=N * N) + np.bincount(symbols[e - 1] * N + END, minlength=N * N)


# -- Spark ------------------------------------------------------------------

def labelled(docs: DataFrame, text_column: str) -> DataFrame:
    """(kind, value, counts): the credentials the base patterns find, and a task's background counts with a null kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N * N, np.int64)
        make = lambda k, v, c: pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(v, pa.string()), pa.array(c, pa.list_(pa.int64()))],
                                                          names=["kind", "value", "counts"])
        for batch in batches:
            for lo, hi in T.steps(batch.column(0)):
                data, offs = T.buffer_of(batch.column(0).slice(lo, hi - lo))
                if not len(data):
                    continue
                s, e = candidates(data, offs)
                if len(s):
                    total += background_counts(data, s, e)
                kind, value = [], []
                for k, _, _, a, b in base_spans(data, offs):
                    for x in range(int(np.searchsorted(e, a, side="right")), int(np.searchsorted(s, b))):
                        start, end = max(a, int(s[x])), min(b, int(e[x]))
                        if end - start >= SHORTEST:
                            kind.append(k)
                            value.append(data[start:end].tobytes().decode())
                if kind:
                    yield make(kind, value, [None] * len(kind))
        yield make([None], [None], [total.tolist()])

    return docs.select(text_column).mapInArrow(run, "kind int, value string, counts array<long>")


def _vector(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of arrays of ``size`` counts, position by position."""
    out = np.zeros(size, np.int64)
    for r in rows.select(F.posexplode(column).alias("at", "n")).where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out


def train(docs: DataFrame, text_column: str = "text") -> Model:
    """Automata and background of all documents."""
    found = stored(labelled(docs, text_column), "labelled")
    background = _vector(found.where("kind is null"), "counts", N * N)
    n_candidates = int(background[END * N:END * N + END].sum())
    known = stored(found.where("kind is not null").select("kind", "value").distinct(), "credentials")
    many = {r.kind: r.n for r in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    uses = {r.kind: r.n for r in found.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    automata = {}
    for k in sorted(k for k, n in many.items() if n >= LEAST):
        words = known.where((F.col("kind") == k) & (F.length("value") <= LONGEST)).orderBy(F.sha2("value", 256), "value").limit(SAMPLE).collect()
        automata[k] = infer([r.value.encode() for r in words])
    model = Model(automata, {k: uses[k] / max(1, n_candidates) for k in automata}, background)
    if not automata:
        return model
    shipped, shape = docs.sparkSession.sparkContext.broadcast(model), model.next.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for lo, hi in T.steps(batch.column(1)):
                data, offs = T.buffer_of(batch.column(1).slice(lo, hi - lo))
                total += shipped.value.count(data, offs[:-1], offs[1:], batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["counts"])

    used = known.where(F.col("kind").isin([int(k) for k in automata])).mapInArrow(run, "counts array<long>")
    model.set_counts(_vector(used, "counts", shape[0] * shape[1]).reshape(shape))
    return model


def spans_of(array: pa.Array, model: Model) -> Iterator[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of every row in code points, sorted; kinds of the method follow the base kinds."""
    for lo, hi in T.steps(array):
        data, offs = T.buffer_of(array.slice(lo, hi - lo))
        rows: list[list[tuple[int, int, int]]] = [[] for _ in range(hi - lo)]
        if len(data):
            spans = [(a, k, b) for k, a, b, _, _ in base_spans(data, offs)]
            s, e = candidates(data, offs)
            kind, odds = model.odds(data, s, e)
            covered = np.zeros(len(data) + 1, np.int64)
            np.add.at(covered, [a for a, _, _ in spans], 1)
            np.add.at(covered, [b for _, _, b in spans], -1)
            held = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
            new = np.flatnonzero((odds > math.log(ODDS)) & (held[e] == held[s]))
            spans += [(int(s[i]), len(KINDS) + int(kind[i]), int(e[i])) for i in new]
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            for a, k, b in sorted(spans):
                row = int(np.searchsorted(offs, a, side="right")) - 1
                rows[row].append((int(point[a] - point[offs[row]]), k, int(point[b] - point[offs[row]])))
        yield from rows


_NAMES = KINDS + tuple(f"{k}_like" for k in KINDS)


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_like, base_sha256, spans (kind:start:end by start, then kind)."""
    shipped, id_type = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, texts = [], [], []
            for found in spans_of(batch.column(1), shipped.value):
                show = lambda rows: ",".join(f"{_NAMES[k]}:{a}:{b}" for a, k, b in rows)
                base = [x for x in found if x[1] < len(KINDS)]
                counts.append([sum(x[1] == k for x in base) for k in range(len(KINDS))] + [len(found) - len(base)])
                shas.append(hashlib.sha256(show(base).encode()).hexdigest())
                texts.append(show(found))
            columns = np.array(counts, np.int64).reshape(-1, len(KINDS) + 1).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in columns], pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "n_like", "base_sha256", "spans"])

    out = docs.select(id_column, text_column).mapInArrow(
        run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_like long, base_sha256 string, spans string")
    return out.withColumnRenamed("doc_id", id_column)
