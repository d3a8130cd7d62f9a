"""Array kernels over Arrow batches of texts: words, hashes, shingles and signatures without a Python object per word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: The C library's way to give freed memory back, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that no classifier word holds: all ASCII but letters.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[128:] = False
_NO_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of a text that are worked on at once; longer texts go through in pieces, cut between words.
PIECE = 1 << 20
#: The longest span, in bytes, whose hash is a polynomial modulo 2**64. Longer ones are hashed each by itself: two long words can differ by a multiple of 2**64.
SHORT = 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, in place."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


#: Powers that are kept; longer texts compute their own.
_KEPT = 1 << 20
_kept_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``n`` and one at least."""
    made = lambda k: tuple(np.concatenate((np.ones(1, U64), np.cumprod(np.full(k, b, U64)))) for b in (_BASE, pow(_BASE, -1, 2**64)))
    if n > _KEPT:
        return made(n)
    if not _kept_powers or len(_kept_powers[0][0]) <= n:
        _kept_powers[:] = [made(min(_KEPT, max(1 << 16, 2 * n)))]
    return _kept_powers[0]


def tidied(batches: Iterator) -> Iterator:
    """``batches``, and at their end the memory that the worker has freed goes back to the system: workers live on between tasks."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text begins (one entry more than texts). Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def pieces(data: np.ndarray, letters_only: bool = False) -> Iterator[np.ndarray]:
    """``data``, the bytes of one text, in pieces of about ``PIECE`` bytes that cut no word. A longer word is a piece of its own."""
    table, at, n = _NO_LETTER if letters_only else _SPACE, 0, len(data)
    while n - at > PIECE:
        gaps = np.flatnonzero(table[data[at + 1 : at + PIECE]])
        stop = at + 1 + int(gaps[-1]) if len(gaps) else n
        for a in range(at + PIECE, n if stop == n else 0, PIECE):  # a word goes on: up to its end
            ends = np.flatnonzero(table[data[a : a + PIECE]])
            if len(ends):
                stop = a + int(ends[0])
                break
        yield data[at:stop]
        at = stop
    if at < n or not n:
        yield data[at:]


class Words:
    """The words of a batch of texts: where they start and end, which are whose, and hashes of any spans."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, letters_only: bool = False):
        n = len(data)
        gap = (_NO_LETTER if letters_only else _SPACE)[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        before[bounds[:-1][bounds[:-1] < n]] = True
        last = bounds[1:] - 1
        after[last[last >= 0]] = True
        self.data = data
        self.starts, self.ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        #: The first word of each text, and one entry more.
        self.first = np.searchsorted(self.starts, bounds)
        self._sums = None

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64 bits for each span: a polynomial of its bytes if it is short, else XXH3."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        long = np.flatnonzero(ends - starts > SHORT)
        if len(long) == len(starts):
            out = np.empty(len(starts), U64)
        elif len(self.data) > 4 * PIECE and len(starts) < 64:  # a few short spans of a very long word need no sums of all bytes
            power = _powers(SHORT)[0]
            out = mix(np.array([(_CODES[self.data[a : min(b, a + SHORT)]] * power[: min(b - a, SHORT)]).sum(dtype=U64) for a, b in zip(starts, ends, strict=True)], U64))
        else:
            if self._sums is None:
                self._power, self._inverse = _powers(len(self.data))
                self._sums = np.zeros(len(self.data) + 1, U64)
                np.cumsum(_CODES[self.data] * self._power[: len(self.data)], out=self._sums[1:])
            out = mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])
        for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
            out[i] = xxhash.xxh3_64_intdigest(self.data[a:b], 42)
        return out

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def equal_spans(x: np.ndarray, xs: np.ndarray, xe: np.ndarray, y: np.ndarray, ys: np.ndarray, ye: np.ndarray) -> bool:
    """Whether all spans of bytes ``x`` equal those of ``y``, one by one."""
    size = xe - xs
    if (size != ye - ys).any():
        return False
    step = np.arange(size.sum(), dtype=np.int64)
    step -= np.repeat(np.cumsum(size) - size, size)
    return bool((x[np.repeat(xs, size) + step] == y[np.repeat(ys, size) + step]).all())


def word_hashes(data: np.ndarray, letters_only: bool = False) -> np.ndarray:
    """Hashes of the words of one text of any length, in order."""
    return np.concatenate([Words(p, np.array([0, len(p)]), letters_only).hashes() for p in pieces(data, letters_only)])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text (of the whole sequence where it is shorter), and where each text's begin."""
    if len(first) == 2 and len(hashes) >= k:  # one text, of any length: no owners
        runs = np.zeros(len(hashes) - k + 1, U64)
        for j in range(k):
            runs *= U64(0xD6E8FEB86659FD93)
            runs += hashes[j : len(runs) + j]
        return mix(runs), np.array([0, len(runs)])
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    out = np.empty(at[-1], U64)
    total = len(hashes)
    short = np.flatnonzero((n > 0) & (n < k))
    if total >= k:
        runs = np.zeros(total - k + 1, U64)
        for j in range(k):
            runs *= U64(0xD6E8FEB86659FD93)
            runs += hashes[j : total - k + 1 + j]
        owner = np.repeat(np.arange(len(n)), n)
        inside = owner[: total - k + 1] == owner[k - 1 :]
        place = np.ones(len(out), bool)
        place[at[short]] = False
        out[place] = mix(runs[inside])
    for d in short:
        value = np.zeros(1, U64)
        for h in hashes[first[d] : first[d + 1]]:
            value = value * U64(0xD6E8FEB86659FD93) + h
        out[at[d]] = mix(value ^ U64(0xA5A5A5A5A5A5A5A5 + int(n[d])))[0]
    return out, at


def distinct(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each text."""
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        x = np.sort(values[a:b])
        out.append(x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))] if len(x) else x)
    return out
