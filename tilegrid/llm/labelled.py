"""A bounded, reproducible sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the sample's texts at most; the sample ends before the text that would pass it.
MOST_BYTES = 256 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, allowed: Column | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text, label int) of at most ``most`` labelled documents and ``most_bytes`` of text, those with the lowest hash of their id, in one partition.

    A doc_id with several labels takes the largest, one with several texts the one with the lowest hash; null ids and labels are left out.
    ``allowed`` restricts the ids.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if allowed is not None:
        known = known.where(allowed)
    present = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).join(present, "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).where(F.col("size") <= most_bytes)
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct("text", "size"), F.xxhash64("text")).alias("m"))  # bounded by ``most``
    order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id")
    held = rows.select("doc_id", "label", "m.text", F.sum("m.size").over(order).alias("total")).where(F.col("total") <= most_bytes)
    return held.select("doc_id", "text", "label").repartition(1).sortWithinPartitions("doc_id", "text")
