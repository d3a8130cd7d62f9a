"""A store of runs: a log of what happens to runs, a parquet table of what they played, and the positions.

``log`` has an entry for each run created and each change of its status, numbered without gaps; ``board_results`` is only ever appended to. The current state
and all sums are views. A run is created by taking the next number after a look at all before it, so of two callers at once only one starts a run. Stores
that hold runs and their changes of status in parquet tables (``runs``, ``run_status``) are read too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid import schemas
from tilegrid.operators import results
from tilegrid.operators.attempts import board_results
from tilegrid.plans.evaluate import judged_attempts, mock_replies
from tilegrid.sources import changelog, files

STATUS = "run_id string, seq bigint, at string, status string, error string"
CREATED = "id string, model_id string, model_name string, company_slug string, release_date string, reasoning_effort string, mode string, board_count int, started_at string"
LOG = f"{STATUS}, run struct<{CREATED.replace(' string', ':string').replace(' int', ':int')}>"
#: Added to the numbers of entries, so that they come after all of an older table, whose order is a time in microseconds.
AFTER_TIMES = 10**16


def now() -> str:
    return datetime.now(UTC).isoformat()


def _append(rows: DataFrame, folder: str, schema: str) -> None:
    own = rows.sparkSession.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)
    own.write.mode("append").parquet(folder)


def _log(spark: SparkSession, store: str) -> DataFrame:
    folder = f"{store}/log"
    return spark.read.schema(LOG).json(folder) if changelog.last(spark, folder) else spark.createDataFrame([], LOG)


def runs(spark: SparkSession, store: str) -> DataFrame:
    """All runs with their current status."""
    log = _log(spark, store)
    made = log.where("run IS NOT NULL").select("run.*")
    made = files.with_effort(files.read_table(spark, f"{store}/runs", schemas.RUN).unionByName(made, allowMissingColumns=True))
    changes = files.read_table(spark, f"{store}/run_status", STATUS).unionByName(log.drop("run"))
    state = results.current_state(changes).select(F.col("run_id").alias("id"), *(F.col(c).alias(f"_{c}") for c in ("status", "finished_at", "error")))
    joined = made.join(state, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "finished_at", "error")}).drop("_status", "_finished_at", "_error")


def played(spark: SparkSession, store: str) -> DataFrame:
    return files.read_table(spark, f"{store}/board_results", schemas.BOARD_RESULT)


def _logged(spark: SparkSession, store: str, entry: dict, guard: Callable[[], None] = lambda: None) -> None:
    """Append an entry; ``guard`` looks at what is there before, again if another writer was faster."""
    folder = f"{store}/log"
    while True:
        number = changelog.last(spark, folder) + 1
        guard()
        if changelog.take(spark, folder, number, entry | {"seq": AFTER_TIMES + number, "at": now()}):
            return


def set_status(spark: SparkSession, store: str, run_id: str, status: str, error: str | None = None) -> None:
    _logged(spark, store, {"run_id": run_id, "status": status, "error": error})


def create_run(spark: SparkSession, store: str, model: DataFrame, effort: str, mode: str, board_count: int) -> str:
    """The id of a new run of the one ``model`` (model_id, model_name, company_slug, release_date), queued; an active run refuses it, one that another caller starts at the same time too."""

    def guard() -> None:
        if not results.latest_active(runs(spark, store)).isEmpty():
            raise RuntimeError("Another benchmark run is already active.")

    (row,) = model.select("model_id", "model_name", "company_slug", "release_date").collect()
    run = {"id": uuid.uuid4().hex, **row.asDict(), "reasoning_effort": effort, "mode": mode, "board_count": board_count, "started_at": now()}
    _logged(spark, store, {"run_id": run["id"], "status": "queued", "error": None, "run": run}, guard)
    return run["id"]


def record(spark: SparkSession, store: str, run_id: str, attempts: DataFrame) -> None:
    """Append a result for each position of judged ``attempts``, numbered in the order of the positions."""
    told = board_results(attempts)
    move = F.to_json(F.struct("placements", "score", "words"))
    right = F.when(F.col("error").isNull(), F.col("attempt_index"))
    last = attempts.groupBy("position_id").agg(F.max_by("reply", "attempt_index").alias("raw_response"), F.min_by(move, right).alias("parsed_move"))
    rows = told.join(last, "position_id").withColumns({"run_id": F.lit(run_id), "created_at": F.lit(now()), "attempt_trace": F.lit("[]"), "prompt_tokens": F.lit(0), "completion_tokens": F.lit(0)})
    rows = results.numbered(rows, "run_id", F.col("position_id")).withColumn("id", F.col("index").cast("long")).drop("index", "total")
    _append(rows, f"{store}/board_results", schemas.BOARD_RESULT)


def run(spark: SparkSession, store: str, run_id: str, positions: DataFrame, lexicon: DataFrame, replies: DataFrame | None = None) -> None:
    """Play a queued run over recorded ``replies`` (by default those of the provider that always plays one move) and complete it, or say why it failed."""
    results.known(runs(spark, store), run_id)
    set_status(spark, store, run_id, "running")
    try:
        record(spark, store, run_id, judged_attempts(positions, mock_replies(positions) if replies is None else replies, lexicon))
    except Exception as e:
        set_status(spark, store, run_id, "failed", str(e)[:500])
        raise
    set_status(spark, store, run_id, "completed")
