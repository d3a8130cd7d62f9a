"""Attempts at a position: prompts, retry feedback, and which attempt counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilegrid.functions.payload import placements_text
from tilegrid.functions.texts import hint

# The texts of the prompt.
SYSTEM = (
    "You are a Scrabble benchmarking agent.",
    "The game is played in English and the loaded dictionary expects valid English words.",
    "Return your move as one final JSON object.",
    'Format: {"tool":"play_move","arguments":{"placements":[{"row":number,"col":number,"letter":"A"}]}}',
    "All row/col coordinates are 0-indexed.",
    "The center square is row 7, col 7.",
    "Goal: return the legal move with the highest immediate raw Scrabble score.",
    "With play_move, you must return only the new tiles placed this turn.",
    "If your word crosses a letter already present on the board, do not return that square in placements.",
    "Never invent letters outside the rack. A ? in the rack may stand for one missing letter.",
    "Keep the visible answer to the JSON object only.",
    "Do not include prose before or after the JSON object.",
)
INSTRUCTION = "Return the legal move with the highest immediate raw Scrabble score. Return only newly placed tiles in placements."
REMINDERS = (
    "Return only newly placed tiles.", "Do not re-emit crossing letters already on the board.", "Do not invent letters outside the rack.",
    "Reply with one raw JSON object and nothing else.",
)


def _tiles(rack: Column) -> Column:
    return F.filter(F.split(rack, ""), lambda x: x != "")


def feedback(rack: Column, reply: Column, error: Column) -> Column:
    """The JSON that tells a model why its move was rejected."""
    told = F.struct(
        F.lit("play_move").alias("tool"), F.lit("rejected").alias("status"), error.alias("reason"), placements_text(reply).alias("attempted_placements"),
        _tiles(rack).alias("rack"), hint(error).alias("hint"), F.array(*map(F.lit, REMINDERS)).alias("reminder"))
    return F.to_json(F.struct(told.alias("tool_result")))


def prompt(rack: Column, board: Column) -> Column:
    """Messages (role, content) that ask for a move."""
    example = F.struct(F.lit("AERIE").alias("board_has_existing_word"), F.lit("AERIED").alias("desired_full_word"), F.struct(F.lit("play_move").alias("tool"), F.struct(F.array(F.struct(F.lit(6).alias("row"), F.lit(13).alias("col"), F.lit("D").alias("letter"))).alias("placements")).alias("arguments")).alias("correct_response"))
    body = F.to_json(F.struct(F.lit("highest-immediate-score-only").alias("benchmark"), F.lit(15).alias("board_size"), _tiles(rack).alias("rack"), board.alias("board"), F.lit(INSTRUCTION).alias("instruction"), example.alias("example")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit("\n".join(SYSTEM))), message("user", body))


def retry_prompt(rack: Column, board: Column, reply: Column, error: Column) -> Column:
    """The prompt, the rejected reply, and the feedback on it."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.concat(prompt(rack, board), F.array(message("assistant", reply), message("user", feedback(rack, reply, error))))


def flat_prompt(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The messages of each key as one text, in order. ``messages``: keys, turn, role, content."""
    part = F.concat(F.upper("role"), F.lit(":\n"), F.col("content"))
    return messages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("_l")).select(*keys, F.array_join(F.transform("_l", lambda x: x.part), "\n").alias("prompt"))


def board_results(attempts: DataFrame) -> DataFrame:
    """A row for each position from its attempts (position_id, attempt_index, answered, error, score, optimal_score, total_tokens, latency_ms).

    The first attempt without an error counts. If none is, the row is a second attempt that scores nothing. Tokens and latency are
    those of the counting attempt, or else of the last that was answered.
    """
    right = F.col("error").isNull()
    chosen = F.min_by(F.struct("attempt_index", "score", "total_tokens", "latency_ms"), F.when(right, F.col("attempt_index")))
    last = F.max_by(F.struct("total_tokens", "latency_ms"), F.when(F.col("answered"), F.col("attempt_index")))
    rows = attempts.groupBy("position_id").agg(chosen.alias("c"), last.alias("l"), F.max("optimal_score").alias("optimal_score"), F.max_by("error", "attempt_index").alias("last_error"))
    ok = F.col("c.attempt_index").isNotNull()
    pick = lambda field: F.coalesce(F.when(ok, F.col(f"c.{field}")).otherwise(F.col(f"l.{field}")), F.lit(0))
    score = F.when(ok, F.col("c.score")).otherwise(0)
    return rows.select(
        "position_id", F.when(ok, F.col("c.attempt_index")).otherwise(2).alias("attempt_index"), F.when(~ok, F.col("last_error")).alias("validation_error"),
        (F.when(ok, F.col("c.attempt_index") == 2).otherwise(True)).cast("int").alias("retry_used"), score.alias("move_score"), "optimal_score",
        (ok & (F.col("c.score") == F.col("optimal_score"))).cast("int").alias("is_optimal"), pick("total_tokens").alias("total_tokens"), pick("latency_ms").alias("latency_ms"))
