"""Sparse text features for the classifiers, as ids of 20 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tilegrid.llm.kernels import PIECE, U64, Words, distinct, lower, mix, pieces, texts_of

#: Bits of a feature's id.
BITS = 20
SIZE = 1 << BITS
_DROP = U64(64 - BITS)
#: Lengths, in bytes, of the word beginnings that count as features of their own.
PREFIXES = (4, 6, 8)


def _ids(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (mix(hashes + U64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> _DROP).astype(np.uint32)


def _word_ids(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(lower(data), bounds, letters_only=True)
    size, owner = words.ends - words.starts, words.owners()
    ids, whose = [_ids(words.hashes(), 1)], [owner]
    for n in PREFIXES:
        long = size > n
        ids.append(_ids(words.hashes(words.starts[long], words.starts[long] + n), n))
        whose.append(owner[long])
    return np.concatenate(ids), np.concatenate(whose)


def word_counts(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct ids, and how often each occurs, of the words of letters, lower-cased, and of their beginnings, text by text. ``wanted``: a mask of ids to keep."""
    data, bounds = texts_of(column)
    if len(data) <= 2 * PIECE:
        ids, at = _grouped(*_word_ids(data, bounds), len(bounds) - 1)
        if wanted is not None:
            used = wanted[ids]
            ids, at = ids[used], np.concatenate((np.zeros(1, np.int64), np.cumsum(used)))[at]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(ids[a:b], return_counts=True)
        return
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # among them a very long text
        seen = np.zeros(SIZE, np.int64)
        for p in pieces(data[a:b], letters_only=True):
            seen += np.bincount(_word_ids(p, np.array([0, len(p)]))[0], minlength=SIZE)
        ids = np.flatnonzero(seen if wanted is None else seen * wanted)
        yield ids.astype(np.uint32), seen[ids]


def _level_ids(level: int, n: int) -> np.ndarray:
    """Ids that say that at least ``2**level`` words equal the word before."""
    return _ids(np.full(n, level, np.uint64), 4)


def _pair_ids(h: np.ndarray) -> np.ndarray:
    """Ids of neighbouring words; all pairs of equal words share one."""
    both = h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:]
    both[h[:-1] == h[1:]] = 0
    return _ids(both, 2)


def _trigram_ids(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint64)
    return _ids(wide[:-2] << U64(16) | wide[1:-1] << U64(8) | wide[2:], 3)


def gram_features(column: pa.Array) -> list[np.ndarray]:
    """Byte trigrams, words and pairs of words, and how often a word equals the one before (ids for 1, 2, 4, ... times): the sorted distinct ids of each text."""
    data, bounds = texts_of(column)
    if len(data) > 2 * PIECE:  # among them a very long text
        return [_long_grams(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    words = Words(data, bounds)
    h, owner = words.hashes(), words.owners()
    ids, whose = [_ids(h.copy(), 1)], [owner]
    if len(h) > 1:
        pair = owner[1:] == owner[:-1]
        same = np.bincount(owner[1:][pair & (h[1:] == h[:-1])], minlength=len(bounds) - 1)
        for level in range(int(same.max(initial=0)).bit_length()):
            whose.append(np.flatnonzero(same >= 1 << level))
            ids.append(_level_ids(level, len(whose[-1])))
        ids.append(_pair_ids(h)[pair])
        whose.append(owner[1:][pair])
    if len(data) > 2:
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        inside = text[:-2] == text[2:]
        ids.append(_trigram_ids(data)[inside])
        whose.append(text[:-2][inside])
    return distinct(*_grouped(np.concatenate(ids), np.concatenate(whose), len(bounds) - 1))


def _long_grams(data: np.ndarray) -> np.ndarray:
    """As ``gram_features``, of one text, piece by piece."""
    seen, before, same = np.zeros(SIZE, bool), np.zeros(0, U64), 0
    for p in pieces(data):
        h = Words(p, np.array([0, len(p)])).hashes()
        seen[_ids(h.copy(), 1)] = True
        h = np.concatenate((before, h))
        if len(h) > 1:
            same += int((h[1:] == h[:-1]).sum())
            seen[_pair_ids(h)] = True
        before = h[-1:]
    for level in range(same.bit_length()):
        seen[_level_ids(level, 1)] = True
    for a in range(0, len(data) - 2, PIECE):
        seen[_trigram_ids(data[a : a + PIECE + 2])] = True
    return np.flatnonzero(seen).astype(np.uint32)


def _grouped(ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(owner, kind="stable")
    return ids[order], np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(owner, minlength=n))))
