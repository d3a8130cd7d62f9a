"""Evaluating a model in one plan: recorded replies are parsed, scored and reduced to a result for each position, and rolled up for the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.functions.payload import tool_call
from tilegrid.operators.attempts import board_results
from tilegrid.operators.results import roll_up
from tilegrid.operators.score import score_moves

#: Attempts at a position.
ATTEMPTS = 2


def mock_replies(positions: DataFrame) -> DataFrame:
    """The replies of a provider that always plays the same move, for trying things out."""
    move = '{"tool":"play_move","arguments":{"placements":[{"row":7,"col":7,"letter":"A"}]}}'
    return positions.select(F.col("id").alias("position_id"), F.lit(1).alias("attempt_index"), F.lit(move).alias("reply"), F.lit(None).cast("string").alias("failure"), F.lit(12).alias("prompt_tokens"), F.lit(17).alias("completion_tokens"), F.lit(29).alias("total_tokens"), F.lit(0).alias("latency_ms"))


def judged_attempts(positions: DataFrame, replies: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Each attempt with its error or score. ``replies``: position_id, attempt_index, reply, failure (of the call itself), total_tokens, latency_ms."""
    own = replies.where(F.col("attempt_index") <= ATTEMPTS).join(positions.select(F.col("id").alias("position_id"), "rack", "board", "optimal_score"), "position_id")
    own = own.withColumn("call", F.when(F.col("failure").isNull(), tool_call(F.col("reply")))).withColumn("move_id", F.struct("position_id", "attempt_index"))
    scored = score_moves(own.where(F.col("call.error").isNull() & F.col("failure").isNull()).select("move_id", "rack", "board", F.col("call.placements").alias("raw")), lexicon)
    rows = own.join(scored.select("move_id", "placements", "score", "words", F.col("error").alias("rejected")), "move_id", "left")
    return rows.select("position_id", "attempt_index", F.col("failure").isNull().alias("answered"), F.coalesce("failure", "call.error", "rejected").alias("error"), "placements", "score", "words", "optimal_score", "total_tokens", "latency_ms", "reply")


def evaluate(positions: DataFrame, replies: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A result for each position that has replies."""
    return board_results(judged_attempts(positions, replies, lexicon))


def run_score(positions: DataFrame, replies: DataFrame, lexicon: DataFrame, run_id: str) -> DataFrame:
    """One row: the run's roll-up."""
    return roll_up(evaluate(positions, replies, lexicon).withColumn("run_id", F.lit(run_id)))


def evaluate_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mock provider on the fixture positions."""
    from tilegrid.plans.words import FIXTURE_WORDS, _positions

    positions = _positions(spark).withColumn("optimal_score", F.when(F.col("id") == "none", 2).otherwise(9))
    lexicon = spark.createDataFrame([(w,) for w in FIXTURE_WORDS], "word string")
    return evaluate(positions, mock_replies(positions), lexicon)


MOCK = """SELECT id AS position_id, CAST(CASE WHEN id = 'none' THEN 1 ELSE 2 END AS INTEGER) AS attempt_index, CASE id WHEN 'hat' THEN 'No new tiles were provided.' WHEN 'axe' THEN 'No new tiles were provided.'
  WHEN 'axones' THEN 'Placement collides with existing tile at (7, 7)' END AS validation_error, CAST(id <> 'none' AS INTEGER) AS retry_used, CAST(CASE WHEN id = 'none' THEN 2 ELSE 0 END AS INTEGER) AS move_score,
  CAST(CASE WHEN id = 'none' THEN 2 ELSE 9 END AS INTEGER) AS optimal_score, CAST(id = 'none' AS INTEGER) AS is_optimal, 29 AS total_tokens, 0 AS latency_ms
FROM (VALUES ('hat'), ('axe'), ('axones'), ('none')) AS t(id)"""

QUERIES = {evaluate_mock: MOCK}
