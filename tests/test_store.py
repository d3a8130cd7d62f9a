"""The store's log under writers that come at once, and stores of the older kind."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from tilegrid.sources import changelog, store

MODEL = "model_id string, model_name string, company_slug string, release_date string"


def test_an_entry_is_created_once(spark, tmp_path):
    folder = f"file://{tmp_path}/a log"
    assert changelog.last(spark, folder) == 0
    with ThreadPoolExecutor(8) as pool:
        won = [*pool.map(lambda i: changelog.take(spark, folder, 1, {"i": i}), range(8))]
    assert won.count(True) == 1 and changelog.last(spark, folder) == 1
    assert [r.i for r in spark.read.json(f"{tmp_path}/a log").collect()] == [won.index(True)] and len([*(tmp_path / "a log").iterdir()]) == 1


def test_of_two_callers_one_starts_a_run(spark, tmp_path, monkeypatch):
    """Both look at the empty store before either writes."""
    model, both, folder = spark.createDataFrame([("m", "M", "c", None)], MODEL), Barrier(2), f"file://{tmp_path}/store"
    take, first = changelog.take, iter([True, True])
    monkeypatch.setattr(changelog, "take", lambda *a: (next(first, False) and both.wait(), take(*a))[1])

    def create(_):
        try:
            return store.create_run(spark, folder, model, "low", "smoke", 5)
        except RuntimeError as e:
            return e

    with ThreadPoolExecutor(2) as pool:
        told = [*pool.map(create, range(2))]
    (run_id,), (refused,) = ([t for t in told if isinstance(t, kind)] for kind in (str, RuntimeError))
    assert str(refused) == "Another benchmark run is already active."
    (row,) = store.runs(spark, folder).collect()
    assert (row.id, row.status, row.model_name, row.board_count, row.finished_at) == (run_id, "queued", "M", 5, None)
    store.set_status(spark, folder, run_id, "failed", "no")
    (row,) = store.runs(spark, folder).collect()
    assert (row.status, row.error) == ("failed", "no") and row.finished_at
    assert store.create_run(spark, folder, model, "low", "smoke", 5) != run_id


def test_older_stores_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    spark.createDataFrame([("old", "m", "2024-01-01")], "id string, model_id string, started_at string").write.parquet(f"{folder}/runs")
    spark.createDataFrame([("old", 1_700_000_000_000_000, "t", "running", None)], store.STATUS).write.parquet(f"{folder}/run_status")
    with pytest.raises(RuntimeError, match="already active"):
        store.create_run(spark, folder, spark.createDataFrame([("m", "M", "c", None)], MODEL), "low", "smoke", 5)
    store.set_status(spark, folder, "old", "cancelled")
    (row,) = store.runs(spark, folder).collect()
    assert (row.id, row.status, row.reasoning_effort) == ("old", "cancelled", "high")
