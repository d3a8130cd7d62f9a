"""Generating legal moves.

A lexicon of up to 200 million words goes to all workers as a word graph, and boards are worked on where they are: one Arrow kernel walks
the graph along the lines of all boards of a batch (``walk``), cross-checks and scores included. There is no shuffle, and nothing is
looked up again.

A larger lexicon stays where it is, and moves are found relationally. Each line of a board has slots: spans bounded by empty squares or the edge that hold an anchor among their empty squares and no
more empty squares than the rack has tiles. A slot with a tile on it meets words through an index by length, place and letter; a slot
without one meets the words that the rack can spell alone. Both are equi-joins. What is left is checked letter by letter
and then scored by the same operator that scores players' moves, which also judges the crossing words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tilegrid.functions.tiles import RACK, SIZE
from tilegrid.operators import walk
from tilegrid.operators.automaton import Graph, broadcast_graph
from tilegrid.operators.board import EMPTY, anchors, grid_of, line_of
from tilegrid.operators.lexicon import joined_feasible
from tilegrid.operators.score import score_moves
from tilegrid.schemas import PLACEMENT


def slots(positions: DataFrame) -> DataFrame:
    """id, rack, across, line, start, size, pattern: spans that a move may fill; dots in the pattern are empty."""
    marks = anchors(positions).groupBy("id").agg(F.collect_list(F.col("row") * SIZE + F.col("col")).alias("marks"))
    marked = F.aggregate("marks", F.lit(EMPTY), lambda g, m: F.overlay(g, F.lit("#"), m + 1, F.lit(1)))
    lines = positions.join(marks, "id").select("id", "rack", F.upper(grid_of(F.col("board"))).alias("grid"), marked.alias("marked"))
    lines = lines.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("across")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("line"))
    along = lambda c: line_of(F.col(c), F.col("across"), F.col("line"))
    lines = lines.select("id", "rack", "across", "line", (F.col("grid") == EMPTY).alias("first"), along("grid").alias("tiles"), along("marked").alias("marks")).where(F.contains("marks", F.lit("#")))
    # A span of one square forms no word along its line but on an empty board, where a single letter may be the first word.
    spans = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))).alias("start"))
    least = F.when(F.col("first"), 1).otherwise(2)
    spans = spans.where(F.col("start") + least <= SIZE).select("*", F.explode(F.sequence(least, F.lit(SIZE) - F.col("start"))).alias("size"))
    cut = lambda c: F.substr(c, F.col("start") + 1, F.col("size"))
    spans = spans.withColumns({"pattern": cut(F.col("tiles")), "anchored": F.contains(cut(F.col("marks")), F.lit("#"))})
    free = lambda place: F.coalesce(F.nullif(F.substr("tiles", place, F.lit(1)), F.lit("")), F.lit(".")) == "."
    empties = F.length("pattern") - F.length(F.replace("pattern", F.lit("."), F.lit("")))
    bounded = ((F.col("start") == 0) | free(F.col("start"))) & free(F.col("start") + F.col("size") + 1)
    return spans.where(F.col("anchored") & bounded & empties.between(1, F.length("rack"))).select("id", "rack", "across", "line", "start", "size", "pattern")


def _needed(word: Column, pattern: Column) -> Column:
    """The letters of a word that fall on empty squares."""
    return F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(pattern, i, F.lit(1)) == "."), lambda i: F.substr(word, i, F.lit(1))), "")


def _fits(word: Column, pattern: Column) -> Column:
    """Whether a word has the tiles of a pattern; letters and dots are a regular expression, which Spark compiles once for all words that meet a slot."""
    return F.regexp_like(word, F.concat(F.lit("^"), pattern, F.lit("$")))


def _spare(needed: Column, rack: Column) -> Column:
    """The rack after taking the letters it has, and how many letters it lacks; too few blanks left means that the word can't be laid."""
    start = F.struct(rack.alias("rest"), F.lit(0).alias("lacking"))

    def take(state: Column, letter: Column) -> Column:
        place = F.instr(state.rest, letter)
        left = F.struct(F.overlay(state.rest, F.lit("#"), place, F.lit(1)).alias("rest"), state.lacking.alias("lacking"))
        return F.when(place > 0, left).otherwise(F.struct(state.rest.alias("rest"), (state.lacking + 1).alias("lacking")))

    return F.aggregate(F.filter(F.split(needed, ""), lambda x: x != ""), start, take)


def candidates(positions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id, raw: placements whose word is in the lexicon and whose tiles the rack has; crossing words aren't judged yet."""
    spans = slots(positions)
    first = F.length(F.regexp_extract("pattern", "^[.]*", 0)) + 1
    held = spans.where(F.col("pattern").rlike("[A-Z]")).withColumns({"place": first, "letter": F.substr("pattern", first, F.lit(1))})
    index = lexicon.select("word", F.length("word").alias("size"), F.posexplode(F.split("word", "")).alias("n", "letter")).where("letter <> ''").select("word", "size", (F.col("n") + 1).alias("place"), "letter")
    by_tile = held.join(index, ["size", "place", "letter"]).where(_fits(F.col("word"), F.col("pattern"))).select("id", "rack", "across", "line", "start", "pattern", "word")
    alone = joined_feasible(positions.select(F.col("id").alias("rack_id"), "rack"), lexicon).select(F.col("rack_id").alias("id"), "word", F.length("word").alias("size"))
    by_rack = spans.where(~F.col("pattern").rlike("[A-Z]")).join(alone, ["id", "size"]).select("id", "rack", "across", "line", "start", "pattern", "word")
    laid = by_tile.union(by_rack).withColumn("s", _spare(_needed(F.col("word"), F.col("pattern")), F.upper("rack")))
    laid = laid.where(F.col("s.lacking") <= F.length("s.rest") - F.length(F.replace("s.rest", F.lit("?"), F.lit(""))))
    place = lambda i: F.col("start") + i - 1
    row = lambda i: F.when(F.col("across"), F.col("line")).otherwise(place(i)).cast("string")
    col = lambda i: F.when(F.col("across"), place(i)).otherwise(F.col("line")).cast("string")
    tile = lambda i: F.struct(row(i).alias("row"), col(i).alias("col"), F.substr("word", i, F.lit(1)).alias("letter"))
    raw = F.transform(F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr("pattern", i, F.lit(1)) == "."), tile)
    return laid.select("id", raw.alias("raw")).distinct()


def joined_moves(positions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """As ``generate_moves``, for lexicons of any size."""
    moves = candidates(positions, lexicon).withColumn("move_id", F.struct("id", "raw"))
    scored = score_moves(moves.join(positions.select("id", "rack", "board"), "id"), lexicon).where(F.col("error").isNull())
    return scored.select("move_id.id", "placements", "score", "words").dropDuplicates(["id", "placements"])


def _kernel(positions: DataFrame, sent: Broadcast, make: Callable, schema: str) -> DataFrame:
    """What ``make(graph, grids, racks)``, columns with the place of their board first, gives for the boards of each batch, with the boards' ids."""
    rows = positions.select("id", grid_of(F.col("board")).alias("grid"), F.upper(F.coalesce("rack", F.lit(""))).alias("rack"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(sent.value)
        for batch in batches:
            grids, racks = batch.column("grid").to_pylist(), batch.column("rack").to_pylist()
            for some in walk.chunks(racks):
                board, columns = make(graph, grids[some], racks[some])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(board + some.start)), *columns.values()], ["id", *columns])

    return rows.mapInArrow(run, StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL(schema)]))


def _chars(letters: np.ndarray) -> pa.Array:
    """Letters from 0 to 25 as texts."""
    data = (letters + 65).astype(np.uint8)
    return pa.StringArray.from_buffers(len(data), pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32)), pa.py_buffer(data))


def _moves_of(graph: Graph, grids: list[str], racks: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    lines = walk.lines_of(graph, walk.grids_of(grids))
    return _in_full(lines, walk.legal_moves(graph, lines, racks))


def _in_full(lines: walk.Lines, moves: walk.Moves) -> tuple[np.ndarray, dict[str, pa.Array]]:
    told = walk.told(lines, moves)
    tiles = pa.StructArray.from_arrays([pa.array(told.row.astype(np.int32)), pa.array(told.col.astype(np.int32)), _chars(told.letter), pa.array(told.blank)], ["row", "col", "letter", "is_blank"])
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    return moves.line // (2 * SIZE), {"placements": lists(told.at, tiles), "score": pa.array(moves.score.astype(np.int32)), "words": lists(told.words_at, pa.array(told.words, pa.string()))}


def generate_moves(positions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id, placements, score, words of every legal move. ``positions``: id (one row each), rack, board."""
    sent = broadcast_graph(lexicon)
    if sent is None:
        return joined_moves(positions, lexicon)
    moves = _kernel(positions, sent, _moves_of, f"placements array<{PLACEMENT}>, score int, words array<string>")
    return moves.withColumn("words", F.array_sort(F.array_distinct("words")))


def _best_of(graph: Graph, grids: list[str], racks: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Only the canonical best move of each board is told in full; all others are counted."""
    lines = walk.lines_of(graph, walk.grids_of(grids))
    moves = walk.legal_moves(graph, lines, racks)
    board = moves.line // (2 * SIZE)
    best, least = np.full(len(grids), -1, np.int32), np.full(len(grids), RACK + 1, np.int8)
    np.maximum.at(best, board, moves.score)
    top = np.flatnonzero(moves.score == best[board])
    np.minimum.at(least, board[top], moves.placed[top])
    some = top[moves.placed[top] == least[board[top]]]
    own = walk.Moves(*(x[some] for x in moves))
    told, which = walk.told(lines, own), np.repeat(np.arange(len(some)), own.placed)
    tiles = np.zeros((len(some), RACK), np.int64)  # in the order of placements: row, column, letter, blank
    tiles[which, np.arange(len(which)) - told.at[which]] = ((told.row.astype(np.int64) * SIZE + told.col) * 32 + told.letter) * 2 + told.blank
    order = np.lexsort((*tiles.T[::-1], board[some]))
    boards, first = np.unique(board[some][order], return_index=True)
    _, full = _in_full(lines, walk.Moves(*(x[order[first]] for x in own)))
    counts = {k: pa.array(np.bincount(x, minlength=len(grids))[boards].astype(np.int64)) for k, x in (("n", board), ("tied", board[top]))}
    return boards, counts | full


def best_totals(positions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id, n, tied, placements, score, words: how many legal moves each position with any has, its canonical best, and how many have that one's score."""
    sent = broadcast_graph(lexicon)
    if sent is None:
        best = F.struct(F.size("placements").alias("size"), "placements", "words")
        scores = joined_moves(positions, lexicon).groupBy("id", "score").agg(F.count("*").alias("n"), F.min(best).alias("best"))  # each task hands on one row a board and score
        told = scores.groupBy("id").agg(F.sum("n").alias("n"), F.max(F.struct("score", F.col("n").alias("tied"), "best")).alias("top"))
        return told.select("id", "n", "top.tied", "top.best.placements", "top.score", "top.best.words")
    best = _kernel(positions, sent, _best_of, f"n bigint, tied bigint, placements array<{PLACEMENT}>, score int, words array<string>")
    return best.withColumn("words", F.array_sort(F.array_distinct("words")))


def cross_checks(positions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """id, row, col, across, letters: for each empty square that a tile touches from across a line (``across``: the line is a row), the letters that make a word there.

    A lexicon that is too large for a word graph is an error.
    """
    sent = broadcast_graph(lexicon)
    if sent is None:
        raise ValueError("cross-checks need a lexicon that fits into a word graph")

    def masks(graph: Graph, grids: list[str], racks: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        lines = walk.lines_of(graph, walk.grids_of(grids))
        line, place = np.nonzero(lines.crossed & (lines.letters < 0))
        column, number = line // SIZE % 2 == 1, line % SIZE
        own = {"row": np.where(column, place, number), "col": np.where(column, number, place)}
        texts = walk.mask_texts(lines.cross_mask[line, place])
        return line // (2 * SIZE), {**{k: pa.array(v.astype(np.int32)) for k, v in own.items()}, "across": pa.array(~column), "letters": pa.array(texts, pa.string())}

    return _kernel(positions.withColumn("rack", F.lit("")), sent, masks, "row int, col int, across boolean, letters string")


def _order() -> tuple:
    return F.desc("score"), F.size("placements"), F.col("placements")


def ranked(moves: DataFrame) -> DataFrame:
    """``moves`` with ``place`` (1 for the canonical best) and ``top`` (whether the score is the position's best)."""
    best = F.max("score").over(Window.partitionBy("id"))
    return moves.withColumns({"place": F.row_number().over(Window.partitionBy("id").orderBy(*_order())), "top": F.col("score") == best})


def pool(moves: DataFrame, most: int = 12) -> DataFrame:
    """The best ``most`` moves of each position with their ``place``. Each task drops what can't be among them before moves are dealt."""
    return moves.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*_order()))).where(F.col("place") <= most)


def best_moves(moves: DataFrame) -> DataFrame:
    """All moves of each position's best score; of other moves none is dealt but from tasks that have no better one."""
    tied = moves.withColumn("_rank", F.rank().over(Window.partitionBy("id").orderBy(F.desc("score")))).where("_rank = 1").drop("_rank")
    return tied.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(*_order())))


def canonical_moves(moves: DataFrame) -> DataFrame:
    return pool(moves, 1).drop("place")
