"""Vectorised helpers over a batch of texts held as one byte buffer.

A text is a row of an Arrow string array.  All helpers work on the array's
buffer and row offsets, in pieces of bounded size, so no Python object is made
per word.  Null and empty texts are rows without words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of one step of work hold at most so many bytes together (a longer text goes alone).
STEP_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)
_BASE_INV = _U(pow(0x9E3779B97F4A7C55, -1, 1 << 64))

#: The white space of the word rules: space, tab, line feed, vertical tab, form feed, return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    _, offs, data = array.buffers()
    if len(array) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(array: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together."""
    _, offs = buffer_of(array)
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n at least."""
    if len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _BASE_INV)):
            full = np.full(m, b, dtype=_U)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0], _POWERS[1]


_P = _U((1 << 31) - 1)
_PRIME_BASE = 1_221_740_719
_PRIME_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, up to one multiple of it."""
    x = (x & _P) + (x >> _U(31))
    return (x & _P) + (x >> _U(31))


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**31 - 1 for i < n at least."""
    if len(_PRIME_POWERS[0]) < n:
        p = int(_P)
        for k, b in enumerate((_PRIME_BASE, pow(_PRIME_BASE, -1, p))):
            full = np.ones(1, _U)
            while len(full) < max(n, 1 << 16):  # each round doubles the table
                full = np.concatenate([full, _mod(full * _U(pow(b, len(full), p)))])
            _PRIME_POWERS[k] = full
    return _PRIME_POWERS[0], _PRIME_POWERS[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, *many_ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for every span; equal spans hash alike wherever they stand.

    Two polynomials go into it: one modulo 2**64, which spreads well but repeats on
    self-similar patterns, and one modulo the prime 2**31 - 1, which does not.
    With several arrays of ends, one row of hashes for each.
    """
    if len(starts) == 0:
        return np.zeros((len(many_ends), 0) if len(many_ends) > 1 else 0, _U)
    up, down = powers(len(values) + 1)
    acc = np.zeros(len(values) + 1, dtype=_U)
    wide = values.astype(_U) + _U(1)
    np.cumsum(wide * up[:len(values)], out=acc[1:])
    p_up, p_down = prime_powers(len(values) + 1)
    p_acc = np.zeros(len(values) + 1, dtype=_U)
    t = wide * p_up[:len(values)]
    np.cumsum((t & _P) + (t >> _U(31)), out=p_acc[1:])

    def one(ends: np.ndarray) -> np.ndarray:
        rest = _mod(_mod(p_acc[ends] - p_acc[starts]) * p_down[starts])
        rest = np.where(rest >= _P, rest - _P, rest)
        return mix((acc[ends] - acc[starts]) * down[starts] + mix(rest + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))

    out = [one(ends) for ends in many_ends]
    return np.stack(out) if len(out) > 1 else out[0]


def _cut(sep: np.ndarray, is_row: np.ndarray, lo: int, limit: int) -> int:
    """End of the piece that begins at lo: a row's start or the byte after a separator, near lo + limit."""
    n = len(sep)
    if lo + limit >= n:
        return n
    ok = np.flatnonzero(sep[lo:lo + limit] | is_row[lo + 1:lo + 1 + limit])
    if len(ok):
        return lo + 1 + int(ok[-1])
    far = np.flatnonzero(sep[lo + limit:] | is_row[lo + limit + 1:n + 1])
    return lo + limit + 1 + int(far[0]) if len(far) else n


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes, none across two rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    inside = ~sep[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACES, fold: np.ndarray | None = LOWER,
          limit: int = STEP_BYTES, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word offsets of the rows); whole texts, in pieces of about ``limit`` bytes.

    With ``prefixes``, rows of hashes: of the words, then of their first bytes for each length given.
    """
    n = len(data)
    is_row = np.zeros(n + 2, dtype=bool)
    is_row[offs] = True
    is_sep = sep[data]
    hashes, firsts, lo = [], [], 0
    while lo < n:
        hi = _cut(is_sep, is_row, lo, limit)
        part = data[lo:hi]
        here = np.flatnonzero(is_row[lo:hi + 1])
        s, e = word_spans(part, here[here <= hi - lo], sep)
        hashes.append(span_hashes(fold[part] if fold is not None else part, s, e, *[np.minimum(e, s + p) for p in prefixes]))
        firsts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros((1 + len(prefixes), 0) if prefixes else 0, _U), np.zeros(len(offs), np.int64)
    return np.concatenate(hashes, axis=-1), np.searchsorted(np.concatenate(firsts), offs).astype(np.int64)


def row_sets(hashes: np.ndarray, offs: np.ndarray, k: int, keep: Callable[[int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct k-word shingles of each row, their offsets).

    A row of 1 to k-1 words has its whole sequence as the only shingle; a row
    without words has none.
    """
    n_words = np.diff(offs)
    coef = stream(0x51, k) | _U(1)
    m = len(hashes)
    full = np.zeros(m, dtype=_U)
    if m >= k:
        for j in range(k):
            full[:m - k + 1] += hashes[j:m - k + 1 + j] * coef[j]
        full = mix(full + _U(k))
    out, sizes = [], np.zeros(len(n_words), np.int64)
    for r in range(len(n_words)):
        n, lo = int(n_words[r]), int(offs[r])
        if n == 0:
            continue
        if n < k:
            part = mix(np.array([np.sum(hashes[lo:lo + n] * coef[:n], dtype=_U) + _U(n)], dtype=_U))
        else:
            part = np.unique(full[lo:lo + n - k + 1])
        out.append(part)
        sizes[r] = len(part)
    flat = np.concatenate(out) if out else np.zeros(0, _U)
    return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def shingle_sets(array: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``row_sets`` of a string array: A-Z lower-cased, words parted by white space."""
    data, offs = buffer_of(array)
    hashes, word_offs = words(data, offs)
    return row_sets(hashes, word_offs, k)
