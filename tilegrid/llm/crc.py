"""CRC-32 of words and of runs of words, in arrays: a word's own remainder is computed once, and those of runs follow from it by algebra.

The remainder of a text ``ab`` is that of ``a``, shifted by the length of ``b``, xor that of ``b``. Shifting by n bytes is linear over
GF(2), a matrix of 32 by 32 bits; it is kept as four tables of 256 entries, one for each byte of the remainder. The matrices of lengths
up to ``DIRECT`` are kept, those of longer ones are products of powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tilegrid.llm.kernels import PIECE, lower, texts_of

#: The polynomial of CRC-32, reflected.
POLYNOMIAL = 0xEDB88320
#: Lengths whose matrices are kept; and word lengths from which a word is worked on by itself.
DIRECT, LONG = 64, 64
#: Bytes that are no part of a word: ASCII but digits and small letters.
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = False


def _remainders() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


_BYTE = _remainders()
_EIGHT = np.uint32(8)


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A matrix, as its four tables, times each value."""
    parts = [(values >> np.uint32(8 * k)) & np.uint32(255) for k in range(4)]
    return tables[0][parts[0]] ^ tables[1][parts[1]] ^ tables[2][parts[2]] ^ tables[3][parts[3]]


def _tables(columns: np.ndarray) -> np.ndarray:
    """The four tables of the matrix with these 32 columns."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, np.arange(256) >> bit & 1 == 1] ^= columns[8 * k + bit]
    return out


_UNITS = np.uint32(1) << np.arange(32, dtype=np.uint32)
#: Shifting by one byte of zeros, and by 2, 4, 8, ... bytes.
_POWERS = [_tables(_BYTE[_UNITS & np.uint32(255)] ^ _UNITS >> _EIGHT)]
for _ in range(40):
    _POWERS.append(_tables(_apply(_POWERS[-1], _apply(_POWERS[-1], _UNITS))))


def _shift_tables() -> np.ndarray:
    """Tables of the shifts by 0 to DIRECT bytes, for look-up by (byte of the remainder, length, value)."""
    out, columns = np.zeros((4, DIRECT + 1, 256), np.uint32), _UNITS
    for n in range(DIRECT + 1):
        out[:, n] = _tables(columns)
        columns = _apply(_POWERS[0], columns)
    return out


_SHIFTS = _shift_tables()


def shifted(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each remainder after so many more bytes of zeros."""
    short = np.minimum(lengths, DIRECT)
    out = np.zeros(len(values), np.uint32)
    for k in range(4):
        out ^= _SHIFTS[k, short, (values >> np.uint32(8 * k)) & np.uint32(255)]
    rest = lengths - short
    for k in range(int(rest.max(initial=0)).bit_length()):
        some = np.flatnonzero(rest >> k & 1)
        out[some] = _apply(_POWERS[k], out[some])
    return out


def joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of two texts laid together. ``lengths``: bytes of the right one."""
    return shifted(left, lengths) ^ right


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, all spans a byte at a time."""
    size = ends - starts
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    at, sizes = starts[order], size[order]
    long = int(np.searchsorted(-sizes, -LONG, "left"))
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    ascending = np.minimum(sizes, LONG)[::-1]
    for j in range(int(min(sizes.max(initial=0), LONG)) if long < len(at) else 0):
        upto = len(at) - int(np.searchsorted(ascending, j, "right"))
        now = state[long:upto]
        state[long:upto] = _BYTE[(now ^ data[at[long:upto] + j]) & np.uint32(255)] ^ now >> _EIGHT
    out = np.empty(len(at), np.uint32)
    out[order] = ~state
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased texts start and end."""
    word = ~GAP[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before[inner], after[inner - 1] = False, False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """One text in pieces of about ``PIECE`` bytes that cut no word."""
    at = 0
    while len(data) - at > PIECE:
        stop = at + PIECE
        gaps = np.flatnonzero(GAP[data[at:stop]])
        while not len(gaps) and stop < len(data):  # a word goes on: up to its end
            begin, stop = stop, min(stop + PIECE, len(data))
            gaps = np.flatnonzero(GAP[data[begin:stop]]) + (begin - at)
        cut = at + int(gaps[-1]) + 1 if len(gaps) else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


_BLANK = np.uint32(zlib.crc32(b" "))


def _runs(crcs: np.ndarray, sizes: np.ndarray, owners: np.ndarray, longest: int, seen: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs and owners of all runs of 1 to ``longest`` words of one owner, joined by blanks, that end behind the first ``seen`` words."""
    made, whose = [crcs[seen:]], [owners[seen:]]
    if longest > 1:
        spaced = joined(np.full(len(crcs), _BLANK), crcs, sizes)
    runs = crcs
    for k in range(2, min(longest, len(crcs)) + 1):
        runs = joined(runs[:-1], spaced[k - 1 :], sizes[k - 1 :] + 1)
        one = owners[k - 1 :] == owners[: 1 - k]
        one[: max(0, seen - k + 1)] = False
        made.append(runs[one])
        whose.append(owners[k - 1 :][one])
    return np.concatenate(made), np.concatenate(whose)


def run_crcs(column: pa.Array, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """CRCs of all runs of 1 to ``longest`` words of a batch of texts, with the text of each and the text of each word; a very long text comes piece by piece."""
    data, bounds = texts_of(column)
    if len(data) <= 2 * PIECE:
        data = lower(data)
        starts, ends = word_spans(data, bounds)
        owners = np.searchsorted(bounds, starts, "right") - 1
        yield *_runs(span_crcs(data, starts, ends), ends - starts, owners, longest, 0), owners
        return
    for text, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        crcs, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for piece in _pieces(data[a:b]):
            piece = lower(piece)
            starts, ends = word_spans(piece, np.array([0, len(piece)]))
            seen = min(len(crcs), longest - 1)
            crcs = np.concatenate([crcs[len(crcs) - seen :], span_crcs(piece, starts, ends)])
            sizes = np.concatenate([sizes[len(sizes) - seen :], ends - starts])
            owners = np.full(len(crcs), text)
            yield *_runs(crcs, sizes, owners, longest, seen), owners[seen:]
