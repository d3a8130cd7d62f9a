"""Roll-ups of runs that are kept up to date: each batch of new results is read once and added to what is held.

A batch leaves one file set of its own, named by its number, with what can be added up: counts, sums, least and largest of each run. A
batch that is given again, as after a failure, replaces its own and counts once. From time to time the parts are added up to a base,
whose name tells up to which batch it goes; the next base is made of the last one and the parts behind it, and a base that wasn't
finished is not taken. So the current roll-up reads one base and a bounded number of parts, never the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.operators.results import percentage

#: Parts after which they are added up to a base.
PARTS = 16
PARTIAL = "run_id string, boards long, points double, optimal double, tokens double, counted long, least long, largest long"


def partial(results: DataFrame) -> DataFrame:
    """What of a set of results can be added up: one row a run."""
    return results.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(
        F.count("*").alias("boards"), F.sum(F.col("move_score").cast("double")).alias("points"), F.sum(F.col("optimal_score").cast("double")).alias("optimal"),
        F.sum(F.col("total_tokens").cast("double")).alias("tokens"), F.count("total_tokens").alias("counted"), F.min(F.col("total_tokens").cast("long")).alias("least"), F.max(F.col("total_tokens").cast("long")).alias("largest"))


def added(partials: DataFrame) -> DataFrame:
    """Partial roll-ups of the same runs as one row a run."""
    total = lambda *columns: [F.sum(c).alias(c) for c in columns]
    return partials.groupBy("run_id").agg(*total("boards", "points", "optimal", "tokens", "counted"), F.min("least").alias("least"), F.max("largest").alias("largest"))


class RollUps:
    """The roll-ups in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        """The finished parts or bases, by the batch that they go up to."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.folder}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n) for n in names if fs.exists(path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def _held(self) -> tuple[DataFrame, int, list[int]]:
        """The last base with the parts behind it, its number (-1: none), and theirs."""
        base = max(self._numbers("base"), default=-1)
        parts = [n for n in self._numbers("parts") if n > base]
        paths = [f"{self.folder}/base/{base}"] * (base >= 0) + [f"{self.folder}/parts/{n}" for n in parts]
        return self.spark.read.schema(PARTIAL).parquet(*paths) if paths else self.spark.createDataFrame([], PARTIAL), base, parts

    def add(self, results: DataFrame, batch: int) -> None:
        """Add batch number ``batch`` of new results; for ``foreachBatch``. A batch that a base holds already is left alone."""
        if batch <= max(self._numbers("base"), default=-1):
            return
        partial(results).write.mode("overwrite").parquet(f"{self.folder}/parts/{batch}")
        _, _, parts = self._held()
        # The newest part stays out, so that its batch can still be given again.
        if len(parts) > PARTS:
            base = parts[-2]
            old = [n for n in parts if n <= base]
            before = [f"{self.folder}/base/{n}" for n in self._numbers("base")[-1:]]
            both = self.spark.read.schema(PARTIAL).parquet(*before, *(f"{self.folder}/parts/{n}" for n in old))
            added(both).write.mode("overwrite").parquet(f"{self.folder}/base/{base}")

    def current(self) -> DataFrame:
        """run_id, boards, raw_points, optimal_raw_points, avg_total_tokens, min_total_tokens, max_total_tokens, score_pct of all runs with results."""
        own = added(self._held()[0])
        return own.select(
            "run_id", "boards", F.col("points").alias("raw_points"), F.col("optimal").alias("optimal_raw_points"), F.try_divide("tokens", "counted").alias("avg_total_tokens"),
            F.col("least").alias("min_total_tokens"), F.col("largest").alias("max_total_tokens"), percentage(F.col("points"), F.col("optimal")).alias("score_pct"))


def followed(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> RollUps:
    """Add up all that a stream of results has to give now, or at each ``trigger``; returns when the stream ends."""
    rolled = RollUps(stream.sparkSession, folder)
    query = stream.writeStream.foreachBatch(rolled.add).trigger(**(trigger or {"availableNow": True})).option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    return rolled
