"""The word graph, moves and cross-checks found by walking it, self-play and datasets."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tilegrid.functions.tiles import TILES
from tilegrid.operators import automaton, movegen, selfplay, walk
from tilegrid.operators.automaton import Graph, broadcast_graph, minimal
from tilegrid.operators.board import EMPTY
from tilegrid.operators.score import judge
from tilegrid.plans import catalogue
from tilegrid.plans.words import _positions

BOARD = "array<struct<row:int,col:int,letter:string,is_blank:boolean>>"
SMALL = "/root/testdata/sf0.001"


def some_words(rng, n, letters="AEIRST", lengths=(1, 2, 2, 3, 3, 4, 5)):
    return {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(n)}


def lexicon(spark, words):
    return spark.createDataFrame([(w,) for w in sorted(words)], "word string")


def test_graph_is_minimal_and_complete(spark, monkeypatch):
    rng = random.Random(1)
    words = some_words(rng, 300) | {"A" * 15, "Z"}
    graph = Graph(Graph.packed(sorted(words)))
    assert [*graph.words()] == sorted(words)
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(graph.masks) == len(endings)  # a node for each different set of endings
    sent = broadcast_graph(lexicon(spark, words).union(lexicon(spark, {"it's", "low", "", "A"})))
    assert [*Graph(sent.value).words()] == sorted(words)
    monkeypatch.setattr(automaton, "MOST_WORDS", 5)
    assert broadcast_graph(lexicon(spark, words)) is None
    assert [*Graph(Graph.packed([])).words()] == [] and minimal([]) == ([0], [0], [])


def all_moves(words, grid, rack):
    """Every way to fill the empty squares of a span with letters, by the rules for players' moves."""
    out = {}
    letters = {*rack.replace("?", "")} | ({*"".join(words)} if "?" in rack else set())
    for across, line, start in itertools.product((True, False), range(15), range(15)):
        empty = [s for s in ((line, k) if across else (k, line) for k in range(start, 15)) if grid[s[0] * 15 + s[1]] == "."]
        for n in range(1, min(len(rack), len(empty)) + 1):
            for laid in itertools.product(letters, repeat=n):
                error, tiles, formed = judge([{"row": r, "col": c, "letter": x} for (r, c), x in zip(empty, laid, strict=False)], grid, rack)
                if not error and all(w.text in words for w in formed) and (grid == EMPTY or any(w.touches for w in formed)):
                    key = tuple(tuple(t.values()) for t in tiles)
                    out[key] = (sum(w.points for w in formed) + (50 if n == 7 else 0), sorted({w.text for w in formed}))
    return out


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.id, {})[tuple(map(tuple, r.placements))] = (r.score, r.words)
    return out


def grown(rng, graph, n):
    """A board after ``n`` random legal moves."""
    grid = [*EMPTY]
    for _ in range(n):
        lines = walk.lines_of(graph, walk.grids_of(["".join(grid)]))
        moves = walk.legal_moves(graph, lines, ["".join(rng.choice("AEIRST?") for _ in range(4))])
        if len(moves.line):
            full, i = walk.told(lines, moves), rng.randrange(len(moves.line))
            for k in range(full.at[i], full.at[i + 1]):
                x = chr(65 + full.letter[k])
                grid[full.row[k] * 15 + full.col[k]] = x.lower() if full.blank[k] else x
    return "".join(grid)


def cells(grid):
    return [(i // 15, i % 15, x.upper(), x.islower()) for i, x in enumerate(grid) if x != "."]


def test_moves_are_those_of_brute_force_and_of_the_join(spark, monkeypatch):
    rng = random.Random(2)
    words = some_words(rng, 250)
    graph = Graph(Graph.packed(sorted(words)))
    boards = {f"b{n}": (grown(rng, graph, n), rack) for n, rack in ((0, "AE?"), (1, "ST?"), (3, "EIR"), (6, "RA?"), (10, "TES"), (14, "I"), (5, ""), (2, "??"))}
    positions = spark.createDataFrame([(k, rack, cells(g)) for k, (g, rack) in boards.items()], f"id string, rack string, board {BOARD}")
    got = found(movegen.generate_moves(positions, lexicon(spark, words)).collect())
    assert got == {k: want for k, (g, rack) in boards.items() if (want := all_moves(words, g, rack))} and len(got) >= 6
    assert found(movegen.joined_moves(positions, lexicon(spark, words)).collect()) == got
    monkeypatch.setattr(automaton, "MOST_WORDS", 5)
    assert found(movegen.generate_moves(positions, lexicon(spark, words)).collect()) == got  # a large lexicon stays where it is


def test_moves_of_whole_racks_are_those_of_the_join(spark):
    """Seven tiles, two blanks among them, on well filled boards."""
    rng = random.Random(3)
    words = some_words(rng, 120, "AEIRSTLN", (2, 3, 4, 5, 6, 7, 8))
    graph = Graph(Graph.packed(sorted(words)))
    racks = ["AEIRSTL", "AEIRST?", "NLSTAE?", "ER??TSA"]
    positions = spark.createDataFrame([(i, rack, cells(grown(rng, graph, 9))) for i, rack in enumerate(racks)], f"id int, rack string, board {BOARD}")
    got = found(movegen.generate_moves(positions, lexicon(spark, words)).collect())
    assert found(movegen.joined_moves(positions, lexicon(spark, words)).collect()) == got and max(len(k) for v in got.values() for k in v) == 7


def test_odd_boards_and_racks(spark):
    rows = [(1, None, None), (2, "a1 t", None), (3, "AT" * 30, []), (4, "AT", [(7, 7, "é", False)]), (5, "AT", [(7, 7, "5", None)]), (None, "A", [])]
    got = found(movegen.generate_moves(spark.createDataFrame(rows, f"id int, rack string, board {BOARD}"), lexicon(spark, {"A", "AT", "ATAT"})).collect())
    assert {k: len(v) for k, v in got.items()} == {2: 5, 3: 13, None: 1}
    with pytest.raises(ValueError, match="32 are the most"):
        walk.usable("ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFG")


def test_cross_checks_of_boards(spark):
    rng = random.Random(5)
    words = some_words(rng, 400)
    graph = Graph(Graph.packed(sorted(words)))
    boards = [grown(rng, graph, n) for n in (0, 2, 7, 12)]
    want = set()
    for i, grid in enumerate(boards):
        for row, col, across in itertools.product(range(15), range(15), (True, False)):
            line = [grid[k * 15 + col] for k in range(15)] if across else [*grid[row * 15 : row * 15 + 15]]
            at = row if across else col
            before, after = "".join(line[:at]).rpartition(".")[2].upper(), "".join(line[at + 1 :]).partition(".")[0].upper()
            if line[at] == "." and (before or after):
                want.add((i, row, col, across, "".join(x for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if before + x + after in words)))
    positions = spark.createDataFrame([(i, cells(g)) for i, g in enumerate(boards)], f"id int, board {BOARD}")
    assert {tuple(r) for r in movegen.cross_checks(positions, lexicon(spark, words)).collect()} == want and len(want) > 60


def test_the_old_boards_keep_their_moves(spark):
    positions, words = _positions(spark), lexicon(spark, {"A", "AT", "HAT", "AX", "AXE", "AXONE", "AXONES", "ARTS", "STAR", "STARES", "RESTATE", "TEA", "SEAT", "AXES", "TA"})
    assert found(movegen.generate_moves(positions, words).collect()) == found(movegen.joined_moves(positions, words).collect())


def test_best_moves_without_a_window_over_all(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.randrange(30), [(rng.randrange(3), rng.randrange(3), "A", False) for _ in range(rng.randrange(1, 3))]) for _ in range(4000)]
    moves = spark.createDataFrame(rows, f"id int, score int, placements {BOARD}").distinct()
    order = lambda r: (-r.score, len(r.placements), r.placements)
    every = {k: sorted(g, key=order) for k, g in itertools.groupby(sorted(moves.collect(), key=lambda r: r.id), key=lambda r: r.id)}
    pool = movegen.pool(moves)
    assert {(r.id, r.place): r.placements for r in pool.collect()} == {(k, i): r.placements for k, v in every.items() for i, r in enumerate(v[:12], 1)}
    assert Counter(r.id for r in movegen.best_moves(moves).collect()) == {k: sum(r.score == v[0].score for r in v) for k, v in every.items()}
    assert {r.id: r.placements for r in movegen.canonical_moves(moves).collect()} == {k: v[0].placements for k, v in every.items()}
    for made in (pool, movegen.best_moves(moves)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("WindowGroupLimit") == 2  # before and after the rows are dealt


def test_games_conserve_tiles_and_moves_are_legal(spark):
    rng = random.Random(9)
    words = some_words(rng, 3000, "AAEEIIOORSTLNDGUBCMPFHVWYKJXQZ", (2, 2, 3, 3, 4, 5, 6))
    rows = selfplay.play(spark, lexicon(spark, words), games=6).collect()
    assert {r.band_ply for r in rows} == {6, 10, 14}
    for r in rows:
        grid = [*EMPTY]
        for c in r.board:
            grid[c.row * 15 + c.col] = c.letter.lower() if c.is_blank else c.letter
        laid = Counter("?" if c.is_blank else c.letter for c in r.board)
        assert len(r.board) + r.bag_count + 14 == 100 and len(r.rack) == 7 and not (laid + Counter(r.rack)) - Counter(TILES)
        assert r.optimal_moves[0] == r.canonical_optimal_move and r.optimal_score == r.canonical_optimal_move.score
        for move in r.optimal_moves:
            error, _, formed = judge([{"row": p.row, "col": p.col, "letter": p.letter} for p in move.placements], "".join(grid), r.rack)
            assert error is None and all(w.text in words for w in formed) and sum(w.points for w in formed) + 50 * (len(move.placements) == 7) == move.score
        for row in range(15):
            for line in ("".join(grid[row * 15 : row * 15 + 15]), "".join(grid[row::15])):
                assert all(w.upper() in words for w in line.split(".") if len(w) > 1)


def test_datasets_fill_their_quotas_or_fail(spark):
    words = lexicon(spark, some_words(random.Random(10), 800, "AEIORSTLND", (2, 3, 4, 5)))
    out = selfplay.dataset(spark, words, {2: 5, 3: 4}, games=3, plies=3).collect()
    assert Counter(r.band_ply for r in out) == {2: 5, 3: 4} and len({(str(r.board), r.rack) for r in out}) == 9
    with pytest.raises(RuntimeError, match="5 games gave"):
        selfplay.dataset(spark, words, {2: 50}, games=3, plies=3, most_games=5)


def test_self_play_queries(spark):
    rows = catalogue.queries()["self_play"](spark, SMALL).collect()
    assert {r.band_ply for r in rows} == {6, 10, 14} and len(rows) > 60 and all(r.bag_count + r.tiles_on_board + 14 == 100 and r.optimal_score > 0 for r in rows)
    rows = catalogue.queries()["position_dataset"](spark, SMALL).collect()
    assert Counter(r.band_ply for r in rows) == selfplay.QUOTAS and np.all([r.tied_moves > 0 for r in rows])
