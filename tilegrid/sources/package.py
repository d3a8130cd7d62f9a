"""The package itself, for executors that don't have it on their path."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tilegrid
from tilegrid.plans.scratch import ensure_folder


def ship(spark: SparkSession) -> None:
    """Once a Spark application: send the package to the executors, by way of the shared folder. (Classic sessions only: Spark Connect has no driver JVM at hand.)"""
    context, root = spark.sparkContext, Path(tilegrid.__file__).parent
    if getattr(context, "_tilegrid_sent", False) or not root.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, f"tilegrid/{file.relative_to(root)}")
    name = f"{ensure_folder(spark).rstrip('/')}/tilegrid-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(name)
    context._tilegrid_sent = True
