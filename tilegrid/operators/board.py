"""Boards as text: 225 characters, row by row; a dot is an empty square, a lower-case letter a blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilegrid.functions.tiles import LABELS, SIZE

EMPTY = "." * (SIZE * SIZE)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(grid: Column, row: Column, col: Column) -> Column:
    return F.substr(grid, row * SIZE + col + 1, F.lit(1))


def put(grid: Column, row: Column, col: Column, letter: Column) -> Column:
    return F.overlay(grid, letter, row * SIZE + col + 1, F.lit(1))


def grid_of(board: Column) -> Column:
    """The grid of an array of cells; of several cells on a square the last counts."""
    mark = lambda cell: F.when(F.coalesce(cell.is_blank, F.lit(False)), F.lower(cell.letter)).otherwise(F.upper(cell.letter))
    return F.coalesce(F.aggregate(board, F.lit(EMPTY), lambda grid, cell: put(grid, cell.row, cell.col, mark(cell))), F.lit(EMPTY))


def line_of(grid: Column, across: Column, number: Column) -> Column:
    """A row (``across``) or a column of the grid, as 15 characters."""
    down = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda r: F.substr(grid, r * SIZE + number + 1, F.lit(1))), "")
    return F.when(across, F.substr(grid, number * SIZE + 1, F.lit(SIZE))).otherwise(down)


def run_at(line: Column, place: Column) -> Column:
    """(start, word): the unbroken run of tiles of a line through ``place``."""
    left = F.element_at(F.split(F.substr(line, F.lit(1), place), "[.]"), -1)
    right = F.element_at(F.split(F.substr(line, place + 1), "[.]"), 1)
    return F.struct((place - F.length(left)).alias("start"), F.concat(left, right).alias("word"))


def cells_of(grid: Column) -> Column:
    """The cells of a grid, row by row."""

    def cell(x: Column, i: Column) -> Column:
        row, col = F.floor(i / SIZE).cast("int"), (i % SIZE).cast("int")
        return F.struct(row.alias("row"), col.alias("col"), F.upper(x).alias("letter"), (x != F.upper(x)).alias("is_blank"), F.lit(True).alias("is_existing"))

    return F.filter(F.transform(F.split(grid, ""), cell), lambda c: ~c.letter.isin(".", ""))


def rendered(grid: Column) -> Column:
    """15 lines of a grid: the row's number and its squares."""
    line = lambda g, r: F.format_string("%02d %s", r, F.array_join(F.split(F.substr(g, r * SIZE + 1, F.lit(SIZE)), ""), " "))
    return let(grid, lambda g: F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda r: line(g, r)))


def _tiles_of(grid: Column, board: Column) -> Column:
    """(n, letter) of the tiles of a grid that was made of ``board``, by number; only squares that the board names are looked at."""
    named = F.array_sort(F.array_distinct(F.transform(board, lambda c: (c.row * SIZE + c.col).cast("int"))))
    on = F.filter(named, lambda n: n.between(0, SIZE * SIZE - 1))
    return F.filter(F.transform(on, lambda n: F.struct(n.alias("n"), F.substr(grid, n + 1, F.lit(1)).alias("letter"))), lambda t: ~t.letter.isin(".", ""))


def cell_rows(positions: DataFrame) -> DataFrame:
    """id, row, col, letter, is_blank of all tiles, in long form; of several on a square the last counts."""
    tiles = positions.select("id", F.explode(let(grid_of(F.col("board")), lambda g: _tiles_of(g, F.col("board")))).alias("c"))
    return tiles.select("id", (F.col("c.n") / SIZE).cast("int").alias("row"), (F.col("c.n") % SIZE).alias("col"), F.upper("c.letter").alias("letter"), (F.col("c.letter") != F.upper("c.letter")).alias("is_blank"))


def anchors(positions: DataFrame) -> DataFrame:
    """id, row, col of the squares that a move must cover one of: empty squares next to tiles, or the centre of an empty board. Each is found in its position's own row."""

    def beside(n: Column) -> Column:
        steps = ((n >= SIZE, -SIZE), (n < SIZE * (SIZE - 1), SIZE), (n % SIZE > 0, -1), (n % SIZE < SIZE - 1, 1))
        return F.filter(F.array(*(F.when(fits, n + step) for fits, step in steps)), lambda x: x.isNotNull())

    found = lambda tiles: F.when(F.size(tiles) > 0, F.array_except(F.flatten(F.transform(tiles, beside)), tiles)).otherwise(F.array(F.lit(7 * SIZE + 7)))
    tiles = lambda g: F.coalesce(F.transform(_tiles_of(g, F.col("board")), lambda t: t.n), F.array().cast("array<int>"))
    near = positions.select("id", F.explode(let(let(grid_of(F.col("board")), tiles), found)).alias("n"))
    return near.select("id", (F.col("n") / SIZE).cast("int").alias("row"), (F.col("n") % SIZE).alias("col"))


def overlay_view(positions: DataFrame, marks: DataFrame) -> DataFrame:
    """id, row, col, text of all 225 squares: a mark (of several on a square the first in the alphabet), else a tile, else the premium's label, else nothing. ``marks``: id, row, col, letter.

    A position's marks come to its row, and its squares are made there: they are never dealt to other tasks.
    """
    inside = marks.where(F.col("row").between(0, SIZE - 1) & F.col("col").between(0, SIZE - 1) & F.col("letter").isNotNull())
    own = inside.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((F.col("row") * SIZE + F.col("col")).alias("n"), "letter"))).alias("marks"))
    rows = positions.select("id", F.upper(grid_of(F.col("board"))).alias("grid")).join(own, "id", "left")
    squares = rows.select("id", "marks", F.posexplode(F.split(F.left("grid", F.lit(SIZE * SIZE)), "")).alias("n", "tile")).where("n < 225")
    mark = F.get("marks.letter", F.array_position("marks.n", F.col("n")).cast("int") - 1)
    label = F.get(F.array(*(F.lit(LABELS.get(divmod(n, SIZE))) for n in range(SIZE * SIZE))), F.col("n"))
    tile = F.when(~F.col("tile").isin(".", ""), F.col("tile"))
    return squares.select("id", (F.col("n") / SIZE).cast("int").alias("row"), (F.col("n") % SIZE).alias("col"), F.coalesce(mark, tile, label, F.lit("")).alias("text"))


def position_key(board: Column, rack: Column) -> Column:
    """Text that is equal for positions of the same tiles and rack, in whatever order the cells are listed."""
    cells = F.array_sort(F.transform(board, lambda c: F.struct(c.row.alias("row"), c.col.alias("col"), c.letter.alias("letter"), F.coalesce(c.is_blank, F.lit(False)).alias("is_blank"))))
    return F.to_json(F.struct(cells.alias("cells"), rack.alias("rack")))
