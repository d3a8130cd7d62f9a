"""Timing of model output: summaries of event arrays, gaps between events, and stalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds without model output that count as a stall.
STALL_SECONDS = 60


def summary(events: Column, latency: Column) -> Column:
    """Counts, characters, first and last time (by place, not by value) and waiting time of each channel of an array of events."""

    def channel(name: str) -> list[Column]:
        own = F.filter(F.coalesce(events, F.array().cast("array<struct<type:string,elapsed_ms:int,delta_ms:int,chars:int,source:string>>")), lambda e: e.type == f"{name}_delta")
        total = lambda field: F.aggregate(own, F.lit(0), lambda n, e: n + F.coalesce(e[field], F.lit(0)))
        return [
            F.size(own).alias(f"{name}_events"), total("chars").alias(f"{name}_chars"), F.get(own, F.lit(0))["elapsed_ms"].alias(f"first_{name}_ms"),
            F.get(own, F.size(own) - 1)["elapsed_ms"].alias(f"last_{name}_ms"), total("delta_ms").alias(f"wait_before_{name}_ms"),
        ]

    return F.struct(latency.alias("latency_ms"), *channel("reasoning"), *channel("content"))


def deltas(rows: DataFrame, key: str, order: str, elapsed: str) -> DataFrame:
    """``rows`` with ``delta_ms``: time since the row before (since 0 for the first), never negative."""
    before = F.coalesce(F.lag(elapsed).over(Window.partitionBy(key).orderBy(order)), F.lit(0))
    return rows.withColumn("delta_ms", F.greatest(F.lit(0), F.col(elapsed) - before))


def model_deltas(rows: DataFrame, key: str, order: str, elapsed: str, kind: str) -> DataFrame:
    """The rows of model output alone, with the time since the one before."""
    return deltas(rows.where(F.col(kind).isin("reasoning_delta", "content_delta")), key, order, elapsed)


def stalls(rows: DataFrame, key: str, at: Column, order: list[str], seconds: int = STALL_SECONDS) -> DataFrame:
    """Rows that come more than ``seconds`` after the one before of their key, with the gap in seconds."""
    gap = F.unix_seconds(at) - F.unix_seconds(F.lag(at).over(Window.partitionBy(key).orderBy(*order)))
    return rows.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > seconds)


def joined_text(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """The texts of each key, in order, as one."""
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(listed.alias("_l")).select(*keys, F.array_join(F.transform("_l", lambda x: x[text]), "").alias("text"))


def whole_trace(early: Column, late: Column) -> Column:
    """The events before and after the first answer as one trace; either may be missing."""
    none = F.array().cast("array<struct<type:string,elapsed_ms:int,delta_ms:int,chars:int,source:string>>")
    return F.concat(F.coalesce(early, none), F.coalesce(late, none))
