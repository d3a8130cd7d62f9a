"""Roll-ups kept by batch against a full computation."""

import random

from pyspark.sql import functions as F

from tilegrid.operators.results import roll_up
from tilegrid.streaming import rollups
from tilegrid.streaming.rollups import RollUps, followed

RESULTS = "run_id string, move_score int, optimal_score int, total_tokens int"
COLUMNS = ("run_id", "raw_points", "optimal_raw_points", "avg_total_tokens", "min_total_tokens", "max_total_tokens", "score_pct")


def rows(made):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in made.select(*COLUMNS).collect())


def batch(rng, n):
    return [(f"r{rng.randrange(6)}", rng.randrange(50), rng.randrange(3) * 25, rng.choice([None, *range(9)])) for _ in range(n)]


def test_batches_count_once(spark, tmp_path, monkeypatch):
    """Equal to a full computation after every batch, with some given twice and some older than a base."""
    monkeypatch.setattr(rollups, "PARTS", 2)
    rng, held, every = random.Random(3), RollUps(spark, f"file://{tmp_path}/held"), []
    assert rows(held.current()) == []
    for n in range(7):
        new = batch(rng, rng.choice([0, 5, 30]))
        every += new
        for _ in range(1 + n % 2):
            held.add(spark.createDataFrame(new, RESULTS), n)
        assert rows(held.current()) == rows(roll_up(spark.createDataFrame(every, RESULTS)))
    assert held._numbers("base") and len(held._held()[2]) <= 3
    held.add(spark.createDataFrame(every, RESULTS), 0)  # in a base by now
    assert rows(held.current()) == rows(roll_up(spark.createDataFrame(every, RESULTS)))


def test_a_stream_reads_new_files_only(spark, tmp_path):
    rng, every = random.Random(4), []
    for n in range(3):
        new = batch(rng, 20)
        every += new
        spark.createDataFrame(new, RESULTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/results")
        seen = []
        stream = spark.readStream.schema(RESULTS).parquet(f"{tmp_path}/results").withColumn("file", F.input_file_name())
        held = RollUps(spark, f"file://{tmp_path}/held")
        query = stream.writeStream.foreachBatch(lambda df, k, held=held, seen=seen: (seen.append(df.select("file").distinct().count()), held.add(df, k))).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
        query.awaitTermination()
        assert seen == [1] and rows(held.current()) == rows(roll_up(spark.createDataFrame(every, RESULTS)))
    assert rows(followed(spark.readStream.schema(RESULTS).parquet(f"{tmp_path}/results"), f"file://{tmp_path}/other", f"{tmp_path}/again").current()) == rows(held.current())
