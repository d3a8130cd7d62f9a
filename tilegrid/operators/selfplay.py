"""Games of the engine against itself, each a row: a task plays some games side by side, ply by ply, on the word graph.

A game's bag is shuffled by a hash of seed, game and tile, and a move is drawn from the best by a hash of seed, game and ply, so a game
depends on its own seed only and can be repeated by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tilegrid.functions.tiles import ALPHABET, RACK, SIZE, TILES
from tilegrid.operators import walk
from tilegrid.operators.automaton import Graph, broadcast_graph
from tilegrid.operators.board import EMPTY, cells_of, position_key
from tilegrid.operators.results import first_by, quota
from tilegrid.plans.scratch import ensure_folder
from tilegrid.schemas import MOVE

POOL, PLIES, SNAPSHOTS = 12, 14, (6, 10, 14)
#: Positions of a dataset by ply, and games after which a dataset that isn't full is an error; games that a task plays side by side.
QUOTAS, MOST_GAMES, TOGETHER = {6: 34, 10: 33, 14: 33}, 10_000, 64


def _sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, "")), "")


def remaining(rack: Column, placements: Column) -> Column:
    """A rack without the tiles of a move; blanks are laid as ``?``."""

    def take(rest: Column, tile: Column) -> Column:
        token = F.when(tile.is_blank, "?").otherwise(tile.letter)
        at = F.when(F.instr(rest, token) > 0, F.instr(rest, token)).otherwise(F.instr(rest, F.lit("?")))
        return F.when(at > 0, F.concat(F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + 1))).otherwise(rest)

    return F.aggregate(placements, rack, take)


def opening(spark: SparkSession, games: int, seed: int, first: int = 1) -> DataFrame:
    """game, grid, bag, racks of fresh games, numbered from ``first``."""
    tiles = F.array(*(F.lit(x) for x, n in TILES.items() for _ in range(n)))
    rows = spark.range(first, first + games).select(F.col("id").cast("int").alias("game"))
    keyed = F.transform(tiles, lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col("game"), i).alias("k"), x.alias("x")))
    bag = rows.select("game", F.array_join(F.transform(F.array_sort(keyed), lambda s: s.x), "").alias("bag"))
    draw = lambda n: _sorted(F.substring("bag", n * RACK + 1, RACK))
    return bag.select("game", F.lit(EMPTY).alias("grid"), F.substring("bag", 2 * RACK + 1, 200).alias("bag"), F.array(draw(0), draw(1)).alias("racks"))


def _tiles(told: walk.Told, i: int) -> tuple[tuple[int, int, str, bool], ...]:
    a, b = told.at[i], told.at[i + 1]
    return tuple((int(r), int(c), ALPHABET[x], bool(k)) for r, c, x, k in zip(told.row[a:b], told.col[a:b], told.letter[a:b], told.blank[a:b], strict=True))


def _best(graph: Graph, grids: list[str], racks: list[str], most: int | None) -> list[list[dict]]:
    """The best moves of each board, best first: ``most`` of them, or all of the best score."""
    lines = walk.lines_of(graph, walk.grids_of(grids))
    moves = walk.legal_moves(graph, lines, racks)
    board = moves.line // (2 * SIZE)
    order = np.lexsort((moves.placed, -moves.score, board))
    firsts = np.searchsorted(board[order], np.arange(len(grids) + 1))
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        own = order[a:b]
        if most is None:
            own = own[moves.score[own] == moves.score[own[:1]]]
        elif len(own) > most:  # and what ties with the last of them
            last = own[most - 1]
            own = own[(moves.score[own] > moves.score[last]) | ((moves.score[own] == moves.score[last]) & (moves.placed[own] <= moves.placed[last]))]
        full = walk.told(lines, walk.Moves(*(x[own] for x in moves)))
        found = [{"placements": _tiles(full, i), "score": int(moves.score[m]), "words": sorted(set(full.words[full.words_at[i] : full.words_at[i + 1]]))} for i, m in enumerate(own.tolist())]
        out.append(sorted(found, key=lambda m: (-m["score"], len(m["placements"]), m["placements"]))[:most])
    return out


class Game:
    """One game: its board, bag and racks."""

    def __init__(self, number: int, bag: str, racks: list[str], draws: list[int]):
        self.number, self.grid, self.bag, self.racks, self.draws, self.shots = number, EMPTY, bag, [*racks], draws, []

    def lay(self, player: int, ply: int, best: list[dict]) -> None:
        """Play the move that the game's draw of this ply picks among the best, and fill the rack up."""
        squares, rest = [*self.grid], [*self.racks[player]]
        for row, col, letter, blank in best[self.draws[ply - 1] % len(best)]["placements"]:
            squares[row * SIZE + col] = letter.lower() if blank else letter
            rest.remove("?" if blank else letter)
        lack = RACK - len(rest)
        self.racks[player] = "".join(sorted([*rest, *self.bag[:lack]]))
        self.grid, self.bag = "".join(squares), self.bag[lack:]


def _shots(graph: Graph, games: list[Game], plies: int, snapshots: tuple[int, ...]) -> list[dict]:
    """Positions of all games that no player is stuck in, each with its best moves."""
    for ply in range(1, plies + 1):
        player, able = (ply - 1) % 2, []
        for some in walk.chunks([g.racks[player] for g in games]):
            for game, best in zip(games[some], _best(graph, [g.grid for g in games[some]], [g.racks[player] for g in games[some]], POOL), strict=True):
                if best:
                    game.lay(player, ply, best)
                    able.append(game)
        games = able
        for game in games if ply in snapshots else []:
            game.shots.append({"game": game.number, "ply": ply, "grid": game.grid, "rack": game.racks[1 - player], "player": 1 - player, "bag_count": len(game.bag)})
    shots = [shot for game in games for shot in game.shots]
    for some in walk.chunks([s["rack"] for s in shots]):
        for shot, best in zip(shots[some], _best(graph, [s["grid"] for s in shots[some]], [s["rack"] for s in shots[some]], None), strict=True):
            shot["optimal_moves"] = [m | {"placements": [dict(zip(_PLACED, t, strict=True)) for t in m["placements"]]} for m in best]
    return [s for s in shots if s["optimal_moves"]]


_PLACED = ("row", "col", "letter", "is_blank")
_SHOT = f"game int, ply int, grid string, rack string, player int, bag_count int, optimal_moves array<{MOVE}>"


def play(spark: SparkSession, lexicon: DataFrame, games: int, seed: int = 20260412, plies: int = PLIES, snapshots: tuple[int, ...] = SNAPSHOTS, first: int = 1) -> DataFrame:
    """Positions after the plies of ``snapshots``: id, band_ply, source_game_id, source_seed, board, rack, player_to_move, bag_count, tiles_played,
    optimal_score, optimal_moves, canonical_optimal_move. A game in which a player can't move has no positions."""
    sent = broadcast_graph(lexicon)
    if sent is None:
        raise ValueError("self-play needs a lexicon that fits into a word graph")
    draws = F.array(*(F.xxhash64(F.lit(seed), "game", F.lit(ply)) for ply in range(1, plies + 1)))
    rows = opening(spark, games, seed, first).select("game", "bag", "racks", draws.alias("draws"))
    schema = to_arrow_schema(StructType.fromDDL(_SHOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(sent.value)
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.slice(at, TOGETHER)
                shots = _shots(graph, [Game(*row) for row in zip(*(some.column(c).to_pylist() for c in ("game", "bag", "racks", "draws")), strict=True)], plies, snapshots)
                yield pa.RecordBatch.from_pylist(shots, schema)

    shots = rows.mapInArrow(run, _SHOT)
    canonical = F.get("optimal_moves", F.lit(0))
    return shots.select(
        F.format_string("pos-%d-%d", "game", "ply").alias("id"), F.col("ply").alias("band_ply"), F.format_string("selfplay-%d", "game").alias("source_game_id"), F.col("game").alias("source_seed"),
        cells_of(F.col("grid")).alias("board"), "rack", F.col("player").alias("player_to_move"), "bag_count", F.col("ply").alias("tiles_played"), canonical.score.alias("optimal_score"),
        "optimal_moves", canonical.alias("canonical_optimal_move"))


def accepted(positions: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """The positions of a dataset: of equal boards and racks the first, and of each ply as many as its quota, by game."""
    spark = positions.sparkSession
    own = positions.withColumn("_key", position_key(F.col("board"), F.col("rack")))
    once = first_by(own, ["_key"], F.col("source_seed"), F.col("band_ply")).drop("_key")
    wanted = spark.createDataFrame([*quotas.items()], "band_ply int, quota int")
    return quota(once, F.broadcast(wanted), "band_ply", F.col("source_seed"))  # a row for each ply


def dataset(spark: SparkSession, lexicon: DataFrame, quotas: dict[int, int] | None = None, games: int = 40, seed: int = 20260412, plies: int = PLIES, most_games: int = MOST_GAMES) -> DataFrame:
    """Positions of self-play, without repetitions, until each ply has its quota, in the order of ply and id.

    ``games`` are played at once, and more by need; that ``most_games`` don't fill the quotas is an error.
    """
    quotas, folder = quotas or QUOTAS, f"{ensure_folder(spark).rstrip('/')}/selfplay-{uuid.uuid4().hex}"
    for first in range(1, most_games + 1, games):
        new = play(spark, lexicon, min(games, most_games + 1 - first), seed, plies, tuple(quotas), first)
        new.write.mode("append").parquet(folder)
        out = accepted(spark.read.schema(new.schema).parquet(folder), quotas)
        held = {r.band_ply: r["count"] for r in out.groupBy("band_ply").count().collect()}  # a row for each ply
        if all(held.get(ply, 0) >= n for ply, n in quotas.items()):
            return out.orderBy("band_ply", "id")
    raise RuntimeError(f"{most_games} games gave {held} positions of {quotas}")
