"""Following run logs: a stream of files of JSON lines, its dead letters, running totals, and the state of each position.

A log is landed as one file for each batch of lines, since a file source doesn't read a file again that has grown. A stream that starts
anew reads from its checkpoint; results are counted once for each run and position, whatever is replayed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilegrid.schemas import RUN_EVENT

#: Kinds that end a run; a cancelled run has ended too.
TERMINAL = ("run_completed", "run_failed", "run_cancelled")
#: Kinds that change a position's state.
MOVES = ("attempt_started", "board_result", "attempt_invalid")


def tail(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """Lines of all files that are or will be in ``folder``: value."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)


def follow(stream: DataFrame, write, checkpoint: str, every: str = "250 milliseconds", mode: str = "append"):
    """Start a stream that looks for new lines at this interval and hands each batch, with its number, to ``write``."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()


def landed(stream: DataFrame, folder: str, checkpoint: str, mode: str) -> DataFrame:
    """What a stream makes of all that lies in its source now, through files in ``folder``: all rows of an appending stream, the last state of a complete one,
    and every state of an updating one, with ``batch``: the last of a key's counts."""
    spark = stream.sparkSession
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/batch={n}")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/batch=*")
    if mode == "update":
        return spark.read.schema(f"{_ddl(stream)}, batch int").parquet(folder)
    if mode != "complete":
        return rows
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    batches = [int(f.getPath().getName().removeprefix("batch=")) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch={max(batches)}")


def _ddl(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)


def parsed(lines: DataFrame) -> DataFrame:
    """``value`` as an event; lines that aren't have a null ``event``."""
    event = F.from_json("value", RUN_EVENT)
    return lines.select("value", F.when(event["type"].isNotNull(), event).alias("event"))


def events(lines: DataFrame) -> DataFrame:
    return parsed(lines).where("event IS NOT NULL").select("event.*")


def dead_letters(lines: DataFrame) -> DataFrame:
    """The lines that can't be read; the others go on."""
    return parsed(lines).where("event IS NULL").select("value")


def totals(stream: DataFrame) -> DataFrame:
    """run_id, boards, points, optimal: running totals of results, each position once."""
    results = stream.where(F.col("type") == "board_result").dropDuplicates(["run_id", "position_id"])
    return results.groupBy("run_id").agg(F.count("*").alias("boards"), F.sum("move_score").alias("points"), F.sum("optimal_score").alias("optimal"))


def bounded_totals(stream: DataFrame, at: str, late: str = "1 hour", size: str = "10 minutes") -> DataFrame:
    """Totals by window of ``at``; duplicates are remembered and late lines awaited for ``late``, so the state stays bounded."""
    own = stream.where(F.col("type") == "board_result").withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return own.dropDuplicatesWithinWatermark(["run_id", "position_id"]).groupBy(F.window(at, size), "run_id").agg(F.count("*").alias("boards"), F.sum("move_score").alias("points"))


def finished(stream: DataFrame) -> DataFrame:
    """run_id, type of the events that end a run."""
    return stream.where(F.col("type").isin(*TERMINAL)).select("run_id", "type")


_STATE = "run_id string, position_id string, status string, attempt_index int, move_score int, optimal_score int, content string, reasoning string"
_PLACE = ["run_id", "position_id"]


def positions(stream: DataFrame, idle: str | None = None, order: str | None = None) -> DataFrame:
    """The state of each position as it changes: status, attempt, scores, and the texts of the current attempt.

    An attempt's start clears the texts, each delta adds to its channel's, and a result or an invalid attempt sets the status; other events change nothing.
    ``order``: the column that puts a position's lines in order, whichever batch they come in; of one moment, later batches come after earlier ones and a start before other lines. Spark
    aggregates these by itself; its state holds the last lines that count and the deltas of all of a position's attempts.
    Without ``order`` lines must come one file at a time and are folded as they come. ``idle``: forget positions that saw nothing for so long (in milliseconds), by processing time; ``order``
    then holds within a batch. Both take a call of Python for each position of a batch.
    """
    own = stream.where(F.col("position_id").isNotNull()).fillna(0, ["attempt_index", "move_score", "optimal_score"])
    return _aggregated(own, order) if order and not idle else _folded(own, idle, order)


def _aggregated(own: DataFrame, order: str) -> DataFrame:
    """``positions`` as an aggregation; lines without ``order`` come last."""
    kind = F.col("type")
    placed = own.withColumn("_at", F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("by"), F.current_timestamp().alias("batch")))
    last = lambda of, *columns: F.max(F.when(of, F.struct("_at", *columns)))
    said = F.struct("_at", F.coalesce(F.col("channel") == "content", F.lit(False)).alias("answer"), "text")
    state = placed.groupBy(*_PLACE).agg(
        last(kind == "attempt_started", "attempt_index").alias("start"), last(kind == "board_result", "move_score", "optimal_score").alias("result"),
        last(kind.isin(*MOVES), (kind != "attempt_started").alias("after"), "type").alias("move"), F.collect_list(F.when(kind == "output_delta", said)).alias("said"))
    status = F.when(F.col("move.type") == "board_result", "done").when(F.col("move.type") == "attempt_invalid", "invalid").otherwise("streaming")
    current = F.sort_array(F.filter("said", lambda x: F.col("start").isNull() | (x["_at"] >= F.col("start._at"))))
    text = lambda answer: F.array_join(F.transform(F.filter("current", lambda x: x["answer"] == F.lit(answer)), lambda x: x["text"]), "")
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c.rsplit(".")[-1])
    return state.withColumn("current", current).select(*_PLACE, status.alias("status"), whole("start.attempt_index"), whole("result.move_score"), whole("result.optimal_score"), text(True).alias("content"), text(False).alias("reasoning"))


def _folded(own: DataFrame, idle: str | None, order: str | None) -> DataFrame:
    """``positions`` by a fold of Python for each."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, attempt, score, optimum, content, reasoning = state.get if state.exists else ("streaming", 0, 0, 0, "", "")
        for batch in [pd.concat([*batches]).sort_values(order, kind="stable")] if order else batches:
            for e in batch.to_dict("records"):
                kind = e["type"]
                if kind == "attempt_started":
                    status, attempt, content, reasoning = "streaming", int(e["attempt_index"] or 0), "", ""
                elif kind == "output_delta" and e["channel"] == "content":
                    content += e["text"] or ""
                elif kind == "output_delta":
                    reasoning += e["text"] or ""
                elif kind == "board_result":
                    status, score, optimum = "done", int(e["move_score"] or 0), int(e["optimal_score"] or 0)
                elif kind == "attempt_invalid":
                    status = "invalid"
        state.update((status, attempt, score, optimum, content, reasoning))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame([(*key, status, attempt, score, optimum, content, reasoning)], columns=["run_id", "position_id", "status", "attempt_index", "move_score", "optimal_score", "content", "reasoning"])

    kept = "status string, attempt_index int, move_score int, optimal_score int, content string, reasoning string"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return own.groupBy(*_PLACE).applyInPandasWithState(fold, _STATE, kept, "update", timeout)


def progress(log: DataFrame) -> DataFrame:
    """run_id, boards, done, invalid, points of a log (run_id, position_id, seq, type, points): the last change of a position counts, its first result scores."""
    result = F.col("type") == "board_result"
    last = log.where(F.col("type").isin(*MOVES)).groupBy("run_id", "position_id").agg(F.max_by("type", "seq").alias("last"), F.min_by("points", F.when(result, F.col("seq"))).alias("points"))
    return last.groupBy("run_id").agg(F.count("*").alias("boards"), F.count_if(F.col("last") == "board_result").alias("done"), F.count_if(F.col("last") == "attempt_invalid").alias("invalid"), F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"))


def texts(log: DataFrame) -> DataFrame:
    """run_id, position_id, attempt_index, channel, text: the deltas of each attempt as one text. ``log`` has ``seq``."""
    said = log.where(F.col("type") == "output_delta")
    whole = F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_l")
    return said.groupBy("run_id", "position_id", "attempt_index", "channel").agg(whole).select("run_id", "position_id", "attempt_index", "channel", F.array_join(F.transform("_l", lambda x: x.text), "").alias("text"))
