"""Session and storage helpers that the text operators share. They reach files by the driver's JVM, so they need a classic session, not Spark Connect."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.plans.scratch import ensure_folder, spread
from tilegrid.sources.package import ship

#: Text bytes and rows that one Arrow batch hands to a Python worker at most; one longer text makes a batch of its own.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 4096

#: The characters that separate words: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the input folder, dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def bound_batches(spark: SparkSession) -> None:
    """Prepare Python workers: bound what one holds at once, and give it this package.

    The session's two settings of Arrow batches are lowered for good, since plans are run after this returns; smaller ones stay.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))
    ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session without one gets its own."""
    return ensure_folder(spark).rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(out)
    back = spark.read.schema(df.schema).parquet(out)
    back.written_to = out
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        path, fs = _path(df.sparkSession, df.written_to)
        fs.delete(path, True)


def words(text: Column) -> Column:
    """All words of a text, as an array; of null or empty text, an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, so that every engine agrees."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain reference inside a lambda may be inlined and computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count proves that it has at most ``most_rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows of ``docs`` as one column ``doc``, so that none of their names can clash, and ``more``."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    return docs.select(whole, *(made.alias(name) for name, made in more.items()))


def unpacked(docs: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``docs`` out of ``doc``."""
    return [F.col(f"doc.`{c}`") for c in docs.columns if c not in without]
