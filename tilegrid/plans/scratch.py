"""The folder for tables between the steps of a query, and how a table is dealt to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tilegrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(table: DataFrame) -> DataFrame:
    """``table``, dealt anew if fewer tasks than there are cores would hold all of its rows, as where a file has a single row group.

    For tables as they are read, whose rows cost much more to work on than to move; which tasks have rows is told by the file's own counts.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.select(F.spark_partition_id().alias("p")).distinct().count() >= cores else table.repartition(cores)
