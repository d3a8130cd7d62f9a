"""Legal moves by walking the word graph along all lines of many boards at once.

Every row and column of every board is a line. A walk starts where a word could: behind an empty square or the edge, with so many empty
squares up to the first anchor as the rack can fill. All walks go on square by square together, as arrays: a tile of the board must be
the next letter; an empty square takes each letter that the graph, the rack and the square's cross-check allow. The cross-check of a
square is a mask of 26 bits, found from the same graph: the tiles before it lead to a node, and of that node's letters those stay behind
which the tiles after it lead to the end of a word. Scores go along with the walks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from tilegrid.functions.tiles import ALPHABET, BONUS, CENTER, LETTER_DIGITS, POINTS, RACK, SIZE, WORD_DIGITS
from tilegrid.operators.automaton import Graph

#: All letters as a mask; and the code of a tile that is none of them, which no node has an edge for.
ALL, OTHER = np.uint32((1 << 26) - 1), 31
_POINTS = np.array([POINTS[x] for x in ALPHABET], np.int32)
_LETTER = np.array([int(x) for x in LETTER_DIGITS], np.int32).reshape(SIZE, SIZE)
_WORD = np.array([int(x) for x in WORD_DIGITS], np.int32).reshape(SIZE, SIZE)
#: About how many walks of a chunk of boards are under way at once.
WALKS = 400_000


class Lines(NamedTuple):
    """The lines of some boards: rows first, then columns, board by board; arrays are (lines, 15) unless said otherwise."""

    letters: np.ndarray  #: 0 to 25, -1 for an empty square
    points: np.ndarray  #: of the tile
    anchor: np.ndarray
    crossed: np.ndarray  #: whether a tile touches the square from across the line
    cross_points: np.ndarray  #: points of the tiles that do
    cross_mask: np.ndarray  #: letters that make a word with them
    before: np.ndarray  #: how many tiles touch it on the side of smaller numbers
    after: np.ndarray
    empty_board: np.ndarray  #: (lines,)


class Moves(NamedTuple):
    """Legal moves of some boards, each once."""

    line: np.ndarray
    start: np.ndarray
    end: np.ndarray
    placed: np.ndarray  #: how many tiles
    tiles: np.ndarray  #: six bits for each tile: its letter, and whether it is a blank
    score: np.ndarray


def grids_of(boards: list[str]) -> np.ndarray:
    """Boards of 225 characters as an array of bytes; what is no letter or dot becomes a tile that no word has."""
    return np.frombuffer("".join(b[: SIZE * SIZE].ljust(SIZE * SIZE, ".") for b in boards).encode("ascii", "replace"), np.uint8).reshape(-1, SIZE, SIZE)


def _runs(values: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along the last axis: how many filled squares end right before each square, and the sum of their values."""
    count, total = np.zeros(values.shape, np.int32), np.zeros(values.shape, np.int32)
    for k in range(1, SIZE):
        count[..., k] = np.where(filled[..., k - 1], count[..., k - 1] + 1, 0)
        total[..., k] = np.where(filled[..., k - 1], total[..., k - 1] + values[..., k - 1], 0)
    return count, total


def cross_masks(graph: Graph, letters: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each empty square of lines (lines, 15) that touches a tile of its line: the letters that make a word there; for others all."""
    out = np.full(letters.shape, ALL, np.uint32)
    line, place = np.nonzero((letters < 0) & (before + after > 0))
    left, right = before[line, place], after[line, place]
    nodes, alive = np.full(len(line), graph.root, np.uint32), np.arange(len(line))
    for k in range(int(left.max(initial=0)), 0, -1):  # the tiles before it, the farthest first
        some = alive[left[alive] >= k]
        has, to = graph.step(nodes[some], letters[line[some], place[some] - k])
        nodes[some[has]] = to
        alive = np.setdiff1d(alive, np.delete(some, has), assume_unique=True)
    out[line, place] = 0
    for letter in range(26):
        has, to = graph.step(nodes[alive], np.full(len(alive), letter))
        some = alive[has]
        for k in range(1, int(right[some].max(initial=0)) + 1):  # the tiles after it
            more = right[some] >= k
            has, on = graph.step(to[more], letters[line[some[more]], place[some[more]] + k])
            keep = np.concatenate([np.flatnonzero(~more), np.flatnonzero(more)[has]])
            to = np.concatenate([to[~more], on])
            some = some[keep]
        some = some[graph.ends(to)]
        out[line[some], place[some]] |= np.uint32(1 << letter)
    return out


def lines_of(graph: Graph, grids: np.ndarray) -> Lines:
    """The lines of boards (n, 15, 15), 30 for each."""
    upper = np.where(grids >= 97, grids - 32, grids).astype(np.int16) - 65
    letters = np.where(grids == ord("."), -1, np.where((upper >= 0) & (upper < 26), upper, OTHER)).astype(np.int8)
    both = np.stack([letters, letters.transpose(0, 2, 1)], 1)
    blank = np.stack([grids >= 97, (grids >= 97).transpose(0, 2, 1)], 1)
    filled = both >= 0
    points = np.where(filled & ~blank & (both < 26), _POINTS[np.minimum(both, 25)], 0)
    before, left = _runs(points, filled)
    after, right = (x[..., ::-1] for x in _runs(points[..., ::-1], filled[..., ::-1]))
    touched = (before + after) > 0
    own_mask = cross_masks(graph, both.reshape(-1, SIZE), before.reshape(-1, SIZE), after.reshape(-1, SIZE)).reshape(both.shape)
    across = lambda x: x[:, ::-1].transpose(0, 1, 3, 2).reshape(-1, SIZE)  # noqa: E731  of each square, as seen along the other line through it
    flat = lambda x: x.reshape(-1, SIZE)
    empty = ~filled[:, 0].any((1, 2))
    anchor = ~flat(filled) & (flat(touched) | across(touched))
    empty_lines = np.repeat(empty, 2 * SIZE)
    anchor[empty_lines & (np.tile(np.arange(2 * SIZE), len(grids)) % SIZE == CENTER), CENTER] = True
    return Lines(flat(both), flat(points), anchor, across(touched), across(left + right), across(own_mask), flat(before), flat(after), empty_lines)


def _starts(lines: Lines, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and square of all walks. ``tiles``: of the rack, a line each."""
    empty = lines.letters < 0
    seen = np.cumsum(empty, 1)
    to_anchor = np.full(empty.shape, 99)  # empty squares up to the next anchor, itself included
    nearest = np.full(len(empty), 99)
    for k in range(SIZE - 1, -1, -1):
        nearest = np.where(lines.anchor[:, k], seen[:, k], nearest)
        to_anchor[:, k] = np.where(nearest == 99, 99, nearest - seen[:, k] + empty[:, k])
    free = np.concatenate([np.ones((len(empty), 1), bool), empty[:, :-1]], 1)
    return np.nonzero(free & (to_anchor <= np.minimum(tiles, RACK)[:, None]))


def usable(rack: str) -> str:
    """The tiles of a rack that a move could use: letters and blanks, no more of one than a move has tiles."""
    tiles = "".join(x * min(RACK, rack.count(x)) for x in (*ALPHABET, "?"))
    if len(tiles) > 32:
        raise ValueError(f"a rack of {len(tiles)} tiles; 32 are the most")
    return tiles


def legal_moves(graph: Graph, lines: Lines, racks: list[str]) -> Moves:
    """All legal moves of the boards whose lines these are; ``racks``: a rack of capitals and ``?`` for each."""
    racks = [usable(r) for r in racks]
    codes = np.full((len(racks), max([1, *map(len, racks)])), 27, np.int64)  # 26 is a blank, 27 nothing
    for i, rack in enumerate(racks):
        codes[i, : len(rack)] = [26 if x == "?" else ord(x) - 65 for x in rack]
    slots = np.zeros((len(racks), 28), np.uint32)  # where in the rack each letter is, as bits
    for j in range(codes.shape[1]):
        slots[np.arange(len(racks)), codes[:, j]] |= np.uint32(1 << j)
    offers = np.where(codes < 26, np.uint32(1) << np.minimum(codes, 25).astype(np.uint32), np.where(codes == 26, ALL, 0)).astype(np.uint32)
    board_of = np.repeat(np.arange(len(racks)), 2 * SIZE)
    line, at = _starts(lines, np.array([len(r) for r in racks], np.int64)[board_of])
    n = len(line)
    line, start, at = line.astype(np.int32), at.astype(np.int8), at.astype(np.int8)
    node, used, tiles = np.full(n, graph.root, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.int64)
    placed, main, times, cross, anchored = np.zeros(n, np.int8), np.zeros(n, np.int32), np.ones(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
    column = np.arange(len(lines.letters)) // SIZE % 2 == 1  # whether a line is a column
    number = np.arange(len(lines.letters)) % SIZE
    out: list[tuple] = []
    while len(line):
        letter = lines.letters[line, at]
        tile = np.flatnonzero(letter >= 0)
        has, to = graph.step(node[tile], letter[tile])
        tile = tile[has]
        kept = [(tile, to, used[tile], tiles[tile], placed[tile], main[tile] + lines.points[line[tile], at[tile]], times[tile], cross[tile], anchored[tile])]
        free = np.flatnonzero((letter < 0) & (placed < RACK))
        where, board = (line[free], at[free]), board_of[line[free]]
        offer = np.zeros(len(free), np.uint32)
        for j in range(codes.shape[1]):
            offer |= np.where(used[free] >> np.uint32(j) & np.uint32(1), np.uint32(0), offers[board, j])
        open_ = graph.masks[node[free]] & lines.cross_mask[where] & offer
        while len(free):
            some = np.flatnonzero(open_)
            free, open_, board = free[some], open_[some], board[some]
            low = open_ & (~open_ + np.uint32(1))
            open_ = open_ ^ low
            lay = np.bitwise_count(low - np.uint32(1)).astype(np.int64)
            _, to = graph.step(node[free], lay)
            own, blank = slots[board, lay] & ~used[free], slots[board, 26] & ~used[free]
            real = own != 0
            taken = np.where(real, own & (~own + np.uint32(1)), blank & (~blank + np.uint32(1)))
            here = (line[free], at[free])
            row, col = np.where(column[here[0]], here[1], number[here[0]]), np.where(column[here[0]], number[here[0]], here[1])
            worth, word = np.where(real, _POINTS[lay], 0) * _LETTER[row, col], _WORD[row, col]
            crossing = np.where(lines.crossed[here], (lines.cross_points[here] + worth) * word, 0)
            laid = tiles[free] | (lay | ~real * np.int64(32)) << 6 * placed[free].astype(np.int64)
            kept.append((free, to, used[free] | taken, laid, placed[free] + np.int8(1), main[free] + worth, times[free] * word, cross[free] + crossing, anchored[free] | lines.anchor[here]))
        source, node, used, tiles, placed, main, times, cross, anchored = (np.concatenate(x) for x in zip(*kept, strict=True))
        line, start, at = line[source], start[source], at[source] + np.int8(1)
        edge = at == SIZE
        closed = edge | (lines.letters[line, np.minimum(at, SIZE - 1)] < 0)
        size, first = at - start, lines.empty_board[line]
        long = (size > 1) | (first & ~column[line])  # a single letter is a word on an empty board only, and then once
        done = np.flatnonzero(closed & anchored & (placed > 0) & long & graph.ends(node))
        # One tile that makes words both ways is found along its row.
        twice = column[line[done]] & (placed[done] == 1)
        squares = _squares(lines, line[done[twice]], start[done[twice]], np.ones(int(twice.sum()), np.int64))[1]
        again = np.flatnonzero(twice)[lines.crossed[line[done[twice]], squares]]
        done = np.delete(done, again)
        out.append((line[done], start[done], at[done], placed[done], tiles[done], main[done] * times[done] + cross[done] + BONUS * (placed[done] == RACK)))
        on = np.flatnonzero(~edge)
        line, start, at, node, used, tiles, placed, main, times, cross, anchored = (x[on] for x in (line, start, at, node, used, tiles, placed, main, times, cross, anchored))
    if not out:
        return Moves(*(np.zeros(0, t) for t in (np.int32, np.int8, np.int8, np.int8, np.int64, np.int32)))
    return Moves(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _squares(lines: Lines, line: np.ndarray, start: np.ndarray, placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each tile of some moves, move by move: which move it is of, and its square on the line."""
    empty = lines.letters[line] < 0
    nth = np.cumsum(empty & (np.arange(SIZE) >= start[:, None]), 1) * (empty & (np.arange(SIZE) >= start[:, None]))
    return np.nonzero((nth > 0) & (nth <= placed[:, None]))


def spelled(graph: Graph, rack: str) -> list[str]:
    """All words that some tiles of a rack spell, blanks standing for any letter. The rack may have any number of tiles."""
    left = np.array([[min(rack.count(x), SIZE) for x in (*ALPHABET, "?")]], np.int8)
    node, text, out = np.full(1, graph.root, np.uint32), np.zeros((1, 0), np.uint8), []
    bits = np.uint32(1) << np.arange(26, dtype=np.uint32)
    while len(node):
        offer = np.where(left[:, 26] > 0, ALL, ((left[:, :26] > 0) * bits).sum(1, dtype=np.uint32))
        state, letter = np.nonzero((graph.masks[node] & offer)[:, None] & bits)
        _, node = graph.step(node[state], letter)
        left, text = left[state], np.concatenate([text[state], (letter[:, None] + 65).astype(np.uint8)], 1)
        left[np.arange(len(state)), np.where(left[np.arange(len(state)), letter] > 0, letter, 26)] -= 1
        done = text[graph.ends(node)]
        flat = done.tobytes().decode("ascii")
        out += [flat[a : a + done.shape[1]] for a in range(0, len(flat), max(1, done.shape[1]))]
    return out


class Told(NamedTuple):
    """Moves in full: arrays with an entry a tile or a word, and where each move's begin (one entry more than moves)."""

    at: np.ndarray
    row: np.ndarray
    col: np.ndarray
    letter: np.ndarray
    blank: np.ndarray
    words: list[str]
    words_at: np.ndarray


def told(lines: Lines, moves: Moves) -> Told:
    """Squares, tiles and words (the main word, then the crossing ones) of moves."""
    which, square = _squares(lines, moves.line, moves.start, moves.placed.astype(np.int64))
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(moves.placed, dtype=np.int64)))
    tile = moves.tiles[which] >> 6 * (np.arange(len(which)) - at[which])
    letter, blank = (tile & 31).astype(np.int8), (tile & 32) != 0
    line = moves.line[which]
    column, number = line // SIZE % 2 == 1, line % SIZE
    row, col = np.where(column, square, number), np.where(column, number, square)
    spelled = lines.letters[moves.line].copy()
    spelled[which, square] = letter
    place = np.arange(SIZE)
    inside = (place >= moves.start[:, None]) & (place < moves.end[:, None])
    crossed = np.flatnonzero(lines.crossed[line, square])
    # The other line through a crossed square, with the new tile on it.
    board, c = line[crossed] // (2 * SIZE), column[crossed]
    other = board * 2 * SIZE + np.where(c, 0, SIZE) + square[crossed]
    spot = number[crossed]
    through = lines.letters[other].copy()
    through[np.arange(len(other)), spot] = letter[crossed]
    low, high = spot - lines.before[other, spot], spot + lines.after[other, spot]
    across = (place >= low[:, None]) & (place <= high[:, None])
    texts = _texts(spelled, inside) + _texts(through, across)
    owner = np.concatenate([np.arange(len(moves.line)), which[crossed]])
    order = np.argsort(owner, kind="stable")
    words_at = np.searchsorted(owner[order], np.arange(len(moves.line) + 1))
    return Told(at, row, col, letter, blank, [texts[i] for i in order.tolist()], words_at)


def mask_texts(masks: np.ndarray) -> list[str]:
    """The letters of each mask, in order."""
    different, which = np.unique(masks, return_inverse=True)
    texts = ["".join(x for k, x in enumerate(ALPHABET) if m >> k & 1) for m in different.tolist()]
    return [texts[i] for i in which.tolist()]


def _texts(letters: np.ndarray, inside: np.ndarray) -> list[str]:
    """The marked letters of each row as a text."""
    flat = (letters[inside] + 65).astype(np.uint8).tobytes().decode("ascii")
    ends = np.cumsum(inside.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def chunks(racks: list[str]) -> list[slice]:
    """Boards in a row whose walks together stay within ``WALKS``, about: more tiles and blanks make more."""
    out, begin, load = [], 0, 0
    for i, rack in enumerate(racks):
        load += 40 * 2 ** min(len(rack), RACK) * 8 ** min(2, rack.count("?"))
        if load > WALKS and i > begin:
            out.append(slice(begin, i))
            begin, load = i, 0
    return [*out, slice(begin, len(racks))] if len(racks) > begin else out
