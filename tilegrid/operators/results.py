"""Runs and their results: roll-ups, leaderboard, current states and export tables. All are views; nothing derived is stored."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilegrid.plans.scratch import ensure_folder
from tilegrid.schemas import MOVE, TRACE_EVENT

BOARD_COLUMNS = (
    "company_slug", "model_id", "model_name", "reasoning_effort", "release_date", "score_pct", "raw_points", "optimal_raw_points", "avg_total_tokens", "min_total_tokens", "max_total_tokens",
    "status", "mode", "board_count", "started_at",
)
ACTIVE, TERMINAL = ("queued", "running"), ("completed", "failed", "cancelled")


def percentage(points: Column, optimum: Column) -> Column:
    """100 * points / optimum, 0.0 if the optimum is 0."""
    return F.coalesce(F.try_divide(F.lit(100.0) * points, optimum), F.lit(0.0))


def roll_up(results: DataFrame) -> DataFrame:
    """run_id, raw_points, optimal_raw_points, score_pct, avg_total_tokens, min_total_tokens, max_total_tokens of runs with results."""
    out = results.groupBy("run_id").agg(
        F.sum("move_score").alias("raw_points"), F.sum("optimal_score").alias("optimal_raw_points"), F.avg("total_tokens").alias("avg_total_tokens"),
        F.min("total_tokens").alias("min_total_tokens"), F.max("total_tokens").alias("max_total_tokens"))
    return out.withColumn("score_pct", percentage(F.col("raw_points"), F.col("optimal_raw_points")))


def runs_with_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """``runs`` with the roll-up; runs without results have zeros."""
    rolled = roll_up(results).withColumnRenamed("run_id", "id")
    added = [c for c in rolled.columns if c != "id"]
    joined = runs.drop(*added).join(rolled, "id", "left")
    return joined.fillna(0, added)


def leaderboard(runs: DataFrame, results: DataFrame) -> DataFrame:
    """All runs, whatever their status, the best score first and of equals the newest."""
    return runs_with_results(runs, results).withColumnRenamed("id", "run_id").orderBy(F.desc("score_pct"), F.desc("started_at"))


def active(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin(*ACTIVE)).orderBy(F.desc("started_at"))


def latest_active(runs: DataFrame) -> DataFrame:
    """The newest run that is queued or running; ties by id."""
    return runs.where(F.col("status").isin(*ACTIVE)).orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def admit(runs: DataFrame, run: DataFrame) -> DataFrame:
    """``runs`` and ``run``; an active run refuses another."""
    if not latest_active(runs).isEmpty():
        raise RuntimeError("Another benchmark run is already active.")
    return runs.unionByName(run, allowMissingColumns=True)


def current_state(events: DataFrame) -> DataFrame:
    """run_id, status, finished_at, error from status events (run_id, seq, at, status, error).

    The last status counts; ``finished_at`` is the time of the last terminal one; an error stays once it is given.
    """
    terminal = F.col("status").isin(*TERMINAL)
    return events.groupBy("run_id").agg(
        F.max_by("status", "seq").alias("status"), F.max_by("at", F.when(terminal, F.col("seq"))).alias("finished_at"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"))


def summary(board: DataFrame) -> DataFrame:
    """One row: all runs, completed runs, and the best completed run's score."""
    done = F.col("status") == "completed"
    return board.agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.max(F.when(done, F.col("score_pct"))).alias("best_score"))


def run_detail(results: DataFrame, positions: DataFrame, order: str) -> DataFrame:
    """Results with their position's columns; results of unknown positions are dropped. Of positions with one id the last counts, by the column ``order``."""
    return results.join(first_by(positions, ["position_id"], F.desc(order)), "position_id")


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """``rows`` with ``index`` (from 1, in order) and ``total`` of their key."""
    return rows.withColumns({"index": F.row_number().over(Window.partitionBy(key).orderBy(*order)), "total": F.count("*").over(Window.partitionBy(key)).cast("int")})


def numbered_by_range(rows: DataFrame, key: str, name: str, *order: Column) -> DataFrame:
    """``rows`` with their place (from 1) within their key as ``name``, however many rows a key has.

    Rows are dealt to tasks by ranges of key and order and kept in the shared folder; a row's place is that within its range and the sizes of the ranges before.
    """
    spark = rows.sparkSession
    named = rows.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [key, *(f"_o{i}" for i in range(len(order)))]
    dealt = named.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    folder = f"{ensure_folder(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}"
    dealt.write.parquet(folder)
    kept = spark.read.schema(dealt.schema).parquet(folder)
    sizes = kept.groupBy(key, "_range").agg(F.count("*").alias("_n"))  # a row for each range and key
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_range")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*keys[1:]))
    return kept.withColumn("_own", own).join(before, [key, "_range"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).select(*rows.columns, name)


def decoded(results: DataFrame) -> DataFrame:
    """``results`` with ``parsed_move`` and ``attempt_trace`` as they are read: null where nothing is stored."""
    move = F.from_json(F.nullif("parsed_move", F.lit("")), MOVE)
    return results.withColumns({"parsed_move": move, "attempt_trace": F.from_json("attempt_trace", f"array<{TRACE_EVENT}>")})


def board_row(runs: DataFrame) -> DataFrame:
    """A run's own row as a row of the leaderboard."""
    return runs.select(F.col("id").alias("run_id"), *(c for c in BOARD_COLUMNS))


def known(runs: DataFrame, run_id: str) -> DataFrame:
    """The run; one that isn't there is an error."""
    own = runs.where(F.col("id") == run_id)
    if own.isEmpty():
        raise RuntimeError(f"Unknown run id: {run_id}")
    return own


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; with ``desc`` orders the last."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def quota(rows: DataFrame, quotas: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first rows of each key, as many as ``quotas`` (key, quota) allows; other keys have none."""
    ranked = rows.join(quotas, key).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def export_all(board: DataFrame) -> DataFrame:
    """The nine columns of the file of all runs."""
    return board.select(F.col("company_slug").alias("company"), F.col("model_name").alias("model"), "score_pct", "raw_points", "optimal_raw_points", "release_date", "avg_total_tokens", "min_total_tokens", "max_total_tokens")


def export_run(results: DataFrame, run_id) -> DataFrame:
    """The ten columns of one run's file, in the order of the results."""
    own = results.where(F.col("run_id") == run_id).orderBy("id")
    return own.select("position_id", "move_score", "optimal_score", "is_optimal", "retry_used", "prompt_tokens", "completion_tokens", "total_tokens", "latency_ms", "validation_error")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1, clamped to the pages there are) of ``size`` rows."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


def tail(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The last ``n`` rows, in order."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)
