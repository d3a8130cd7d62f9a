"""The tile set and the board's premium squares, as literals, expressions and small tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, RACK, BONUS, CENTER = 15, 7, 50, 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Points of a tile, and how many there are of each.
POINTS = {
    "A": 1, "B": 3, "C": 3, "D": 2, "E": 1, "F": 4, "G": 2, "H": 4, "I": 1, "J": 8, "K": 5, "L": 1, "M": 3, "N": 1,
    "O": 1, "P": 3, "Q": 10, "R": 1, "S": 1, "T": 1, "U": 1, "V": 4, "W": 4, "X": 8, "Y": 4, "Z": 10, "?": 0,
}
TILES = {
    "A": 9, "B": 2, "C": 2, "D": 4, "E": 12, "F": 2, "G": 3, "H": 2, "I": 9, "J": 1, "K": 1, "L": 4, "M": 2, "N": 6,
    "O": 8, "P": 2, "Q": 1, "R": 6, "S": 4, "T": 6, "U": 4, "V": 2, "W": 2, "X": 1, "Y": 2, "Z": 1, "?": 2,
}
# Premium squares of one eighth of the board; the others mirror them.
PREMIUMS = {"TW": ((0, 0), (0, 7)), "DW": ((1, 1), (2, 2), (3, 3), (4, 4), (7, 7)), "TL": ((1, 5), (5, 5)), "DL": ((0, 3), (2, 6), (3, 7), (6, 6))}


def _squares() -> dict[tuple[int, int], str]:
    out = {}
    for label, seeds in PREMIUMS.items():
        for a, b in seeds:
            for r, c in ((a, b), (b, a)):
                for row in {r, SIZE - 1 - r}:
                    for col in {c, SIZE - 1 - c}:
                        out[row, col] = label
    return out


LABELS = _squares()
#: Multipliers of all squares, row by row, one digit each.
LETTER_DIGITS = "".join({"TL": "3", "DL": "2"}.get(LABELS.get((r, c), ""), "1") for r in range(SIZE) for c in range(SIZE))
WORD_DIGITS = "".join({"TW": "3", "DW": "2"}.get(LABELS.get((r, c), ""), "1") for r in range(SIZE) for c in range(SIZE))


def points(letter: Column) -> Column:
    """Points of an upper-case letter; 0 for a blank (``?`` or lower case)."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in chain(*POINTS.items()))), letter), F.lit(0))


def tile_table(spark: SparkSession) -> DataFrame:
    """letter, value, tiles: 27 rows."""
    return spark.createDataFrame([(x, POINTS[x], TILES[x]) for x in POINTS], "letter string, value int, tiles int")


def square_table(spark: SparkSession) -> DataFrame:
    """row, col, label (null if plain), letter_mult, word_mult: 225 rows."""
    rows = [(r, c, LABELS.get((r, c)), int(LETTER_DIGITS[r * SIZE + c]), int(WORD_DIGITS[r * SIZE + c])) for r in range(SIZE) for c in range(SIZE)]
    return spark.createDataFrame(rows, "row int, col int, label string, letter_mult int, word_mult int")
