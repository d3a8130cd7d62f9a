"""Validating and scoring moves.

Everything but the word list is a function of the move's own row, so it is computed in place, without a shuffle: casts and the board's text
of 225 characters by Spark's own expressions, the rules, which walk from square to square, by one Arrow kernel a batch. Only then do the
words of all moves meet the lexicon, in one join. The first error in the order of the checks is reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tilegrid.functions.tiles import BONUS, CENTER, LETTER_DIGITS, POINTS, RACK, SIZE, WORD_DIGITS
from tilegrid.operators.board import EMPTY, grid_of
from tilegrid.sources.package import ship

#: A word list of at most so many rows is broadcast; beyond, the join shuffles.
MOST_WORDS = 1_000_000
_LETTER, _WORD = [int(x) for x in LETTER_DIGITS], [int(x) for x in WORD_DIGITS]
_PLACED = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("letter", pa.string()), ("is_blank", pa.bool_())]))
_FORMED = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("points", pa.int32()), ("touches", pa.bool_())]))
_JUDGED = "error string, placements array<struct<row:int,col:int,letter:string,is_blank:boolean>>, words array<struct<kind:string,text:string,points:int,touches:boolean>>, empty boolean"


def whole(text: Column) -> Column:
    """A whole number from text, cut towards zero, null if there is none: "7", "7.9" and "7.0" are 7."""
    return F.coalesce(text.try_cast("int"), text.try_cast("double").try_cast("int"))


class Refused(Exception):
    """A move breaks a rule; the text says which."""


class Word(NamedTuple):
    kind: str
    text: str
    points: int
    touches: bool


def fresh_tiles(raw: list[dict], grid: str) -> dict[int, str]:
    """Square and letter of the tiles that a move adds; a placement that repeats the board's own letter adds none."""
    fresh = {}
    for p in raw:
        row, col, letter = p["row"], p["col"], p["letter"]
        if row is None or col is None or letter is None:
            raise Refused("Placement lacks a whole row, a column or a letter.")
        if not (0 <= row < SIZE and 0 <= col < SIZE):
            raise Refused(f"Placement out of bounds: ({row}, {col})")
        if len(letter) != 1 or not "A" <= letter <= "Z":
            raise Refused(f"Invalid placement letter: '{letter}'")
        here = grid[row * SIZE + col].upper()
        if here == ".":
            fresh[row * SIZE + col] = letter
        elif here != letter:
            raise Refused(f"Placement collides with existing tile at ({row}, {col})")
    if not fresh:
        raise Refused("No new tiles were provided.")
    if len(fresh) > RACK:
        raise Refused("A Scrabble move may not place more than 7 tiles.")
    return dict(sorted(fresh.items()))


def supplied(fresh: dict[int, str], rack: str) -> dict[int, str]:
    """Each new tile takes its letter from the rack, or else a blank (then it is in lower case), in reading order."""
    rest, out = list(rack), {}
    for square, letter in fresh.items():
        token = letter if letter in rest else "?"
        if token not in rest:
            raise Refused(f"Rack cannot supply letter '{letter}'.")
        rest.remove(token)
        out[square] = letter.lower() if token == "?" else letter
    return out


def word_at(grid: list[str], fresh: dict[int, str], square: int, step: int, kind: str) -> Word:
    """The word through a square along a line (``step`` 1 or SIZE); premiums count under new tiles only."""
    place = square % SIZE if step == 1 else square // SIZE
    first, last = square, square
    for _ in range(place):
        if grid[first - step] == ".":
            break
        first -= step
    for _ in range(SIZE - 1 - place):
        if grid[last + step] == ".":
            break
        last += step
    total, times, touches, text = 0, 1, False, []
    for s in range(first, last + 1, step):
        letter = grid[s]
        text.append(letter)
        value = POINTS.get(letter, 0)
        if s in fresh:
            total, times = total + value * _LETTER[s], times * _WORD[s]
        else:
            total, touches = total + value, True
    return Word(kind, "".join(text).upper(), total * times, touches)


def formed(grid: str, fresh: dict[int, str]) -> list[Word]:
    """The words that a move forms, main word first."""
    empty, squares = grid == EMPTY, [*fresh]
    rows, cols = {s // SIZE for s in squares}, {s % SIZE for s in squares}
    if len(rows) > 1 and len(cols) > 1:
        raise Refused("Placements must all be on the same row or column.")
    if empty and CENTER * SIZE + CENTER not in fresh:
        raise Refused("The opening move must cover the center square.")
    after = list(grid)
    for s, letter in fresh.items():
        after[s] = letter
    if len(squares) == 1:
        both = [word_at(after, fresh, squares[0], step, "word") for step in (1, SIZE)]
        long = [w for w in both if len(w.text) > 1]
        if not long and not empty:
            raise Refused("Single-tile move does not connect to any word.")
        return long or both[:1]  # a first move of one tile forms its letter once, though it is a word of both lines
    step, across = (1, SIZE) if len(rows) == 1 else (SIZE, 1)
    if any(after[s] == "." for s in range(squares[0], squares[-1] + 1, step)):
        raise Refused("Move has a gap in its main word.")
    crossing = [word_at(after, fresh, s, across, "cross") for s in squares]
    return [word_at(after, fresh, squares[0], step, "main"), *(w for w in crossing if len(w.text) > 1)]


def judge(raw: list[dict] | None, grid: str, rack: str) -> tuple[str | None, list[tuple], list[Word]]:
    """Error, placements and words of a move, before its words are looked up. ``raw``: row, col and letter (upper case) of each placement."""
    try:
        fresh = supplied(fresh_tiles(raw or [], grid), rack)
    except Refused as e:
        return str(e), [], []
    placements = [{"row": s // SIZE, "col": s % SIZE, "letter": x.upper(), "is_blank": x.islower()} for s, x in fresh.items()]
    try:
        return None, placements, formed(grid, fresh)
    except Refused as e:
        return str(e), placements, []


def judged(moves: DataFrame) -> DataFrame:
    """move_id, error, placements, words, empty of each move. ``moves``: move_id, rack, board, raw."""
    ship(moves.sparkSession)
    cell = lambda p: F.struct(whole(p.row).alias("row"), whole(p.col).alias("col"), F.upper(F.trim(p.letter)).alias("letter"))
    rows = moves.select("move_id", F.transform("raw", cell).alias("raw"), grid_of(F.col("board")).alias("grid"), F.upper(F.coalesce("rack", F.lit(""))).alias("rack"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, grid, rack = (batch.column(c).to_pylist() for c in ("raw", "grid", "rack"))
            told = [judge(*move) for move in zip(raw, grid, rack, strict=True)]
            error, placed = pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], _PLACED)
            words = pa.array([[w._asdict() for w in t[2]] for t in told], _FORMED)
            yield pa.RecordBatch.from_arrays([batch.column("move_id"), error, placed, words, pa.array([g == EMPTY for g in grid])], ["move_id", "error", "placements", "words", "empty"])

    schema = StructType([StructField("move_id", rows.schema["move_id"].dataType), *StructType.fromDDL(_JUDGED)])
    return rows.mapInArrow(run, schema)


def score_moves(moves: DataFrame, lexicon: DataFrame) -> DataFrame:
    """move_id, placements, score, words, error of each move. ``moves``: move_id (unique), rack, board, raw; ``lexicon``: word.

    A move is judged once: its outcome goes along with its words to the lexicon and comes back in one grouping.
    """
    shaped = judged(moves).select("move_id", F.struct("error", "placements", "words", "empty").alias("j"))
    known = lexicon.select(F.col("word").alias("text"), F.lit(True).alias("known")).distinct()
    if known.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
        known = F.broadcast(known)
    words = shaped.select("move_id", "j", F.posexplode_outer("j.words").alias("n", "w")).select("move_id", "j", "n", "w.kind", "w.text")
    own = F.coalesce("text", F.concat(F.lit("-"), F.hash("move_id").cast("string")))  # no word: moves without any, often most, would else all meet in one task
    looked = words.withColumn("key", own).join(known.withColumnRenamed("text", "key"), "key", "left")
    wrong = F.col("known").isNull() & F.col("text").isNotNull()
    rows = looked.groupBy("move_id").agg(F.first("j").alias("j"), F.min_by(F.struct("kind", "text"), F.when(wrong, F.col("n"))).alias("bad")).select("move_id", "j.*", "bad")
    told = F.when(F.col("bad.kind") == "main", "Main word is invalid: ").when(F.col("bad.kind") == "cross", "Cross word is invalid: ").when(F.col("bad").isNotNull(), "Word is invalid: ")
    loose = ~F.col("empty") & ~F.exists("words", lambda w: w.touches)
    error = F.coalesce("error", F.concat(told, F.col("bad.text")), F.when(loose, "Move does not connect to the existing board."))
    score = F.aggregate("words", F.lit(0), lambda n, w: n + w.points) + F.when(F.size("placements") == RACK, BONUS).otherwise(0)
    rows = rows.withColumn("error", error)
    right = F.col("error").isNull()
    return rows.select("move_id", F.when(right, F.col("placements")).alias("placements"), F.when(right, score).alias("score"), F.when(right, F.array_sort(F.array_distinct(F.transform("words", lambda w: w.text)))).alias("words"), "error")
