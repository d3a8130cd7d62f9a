"""Telling silence while it lasts: what has not been heard of for a while is told as stalled, once, by a timer, and what speaks again as revived.

The state of a key is when it was last heard and whether its silence has been told; it lies in the RocksDB state store. Keys are dealt by hash to groups, each with
one state and one timer for all of its keys, so calls of Python don't grow in number with the keys. The clock is
either that of the machines (``at`` None) or that of the log (``at`` names a column of times): then a silence is told when the stream's watermark
has passed it, so a log tells the same however late it is read. Gaps between two lines of one batch are told too, as both at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructField, StructType

from tilegrid.operators.traces import STALL_SECONDS
from tilegrid.sources.package import ship

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Groups that keys are dealt to.
GROUPS = 256
_TOLD = "kind string, since_ms bigint, gap_seconds bigint, seq bigint"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started meanwhile keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def _packed(table: pd.DataFrame) -> bytes:
    arrow, out = pa.Table.from_pandas(table, preserve_index=False).replace_schema_metadata(None), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, arrow.schema) as stream:
        stream.write_table(arrow)
    return out.getvalue().to_pybytes()


class Silence(StatefulProcessor):
    """``kind`` is ``stalled`` (``since_ms``: when it was last heard) or ``revived`` (and ``gap_seconds`` of silence, ended by line ``seq``).

    ``grouped``: a group's lines are those of many keys, whose columns they have; else its own key is the only one. The state is a table (Arrow) of ``keys``, at, stalled; its timer, that of the silence due first.
    """

    def __init__(self, keys: list[str], seconds: int, own_clock: bool, grouped: bool = False):
        self.keys, self.seconds, self.own_clock, self.grouped = keys, seconds, own_clock, grouped

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "held binary")

    def _held(self) -> pd.DataFrame:
        state = self.heard.get()
        return pd.DataFrame(columns=[*self.keys, "at", "stalled"]) if state is None else pa.ipc.open_stream(state[0]).read_all().to_pandas()

    def _told(self, keys: pd.DataFrame, kind: str, since: np.ndarray, gap=None, seq=None) -> pd.DataFrame:
        frame = keys.assign(kind=kind, since_ms=since, gap_seconds=gap, seq=seq)
        return frame.astype({"gap_seconds": "Int64", "seq": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        lines, held = pd.concat([*rows], ignore_index=True), self._held()
        if not self.grouped:
            lines = lines.assign(**dict(zip(self.keys, key, strict=True)))
        due = self._due(held)
        # Each key's line of the state, if it has one, then its new ones in order.
        keys = pd.concat([held[self.keys], lines[self.keys]], ignore_index=True) if len(held) else lines[self.keys]
        new = np.arange(len(keys)) >= len(held)
        at = np.append(held["at"].to_numpy(np.int64), lines["line_at"].to_numpy(np.int64) if self.own_clock else np.full(len(lines), timerValues.getCurrentProcessingTimeInMs()))
        seq = pd.concat([pd.Series(0, range(len(held))), lines["line_seq"]]).astype("Int64").array
        stalled = np.append(held["stalled"].to_numpy(bool), np.zeros(len(lines), bool))
        code = keys.groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
        order = np.lexsort((seq.fillna(0).to_numpy(np.int64), seq.isna(), new, code))
        code, at, seq, stalled = code[order], at[order], seq[order], stalled[order]
        same, gap = code[1:] == code[:-1], at[1:] - at[:-1]
        ended = np.flatnonzero(same & (gap > 1000 * self.seconds))
        unheard, last = ended[~stalled[ended]], np.flatnonzero(np.append(~same, True))
        now = keys.iloc[order[last]].assign(at=at[last], stalled=stalled[last])
        self.heard.update((_packed(now),))
        if self._due(now) != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if self._due(now) is not None:
                self.handle.registerTimer(self._due(now))
        if len(ended):
            began = self._told(keys.iloc[order[unheard]], "stalled", at[unheard]).set_axis(unheard)
            revived = self._told(keys.iloc[order[ended]], "revived", at[ended], gap[ended] // 1000, seq[ended + 1]).set_axis(ended)
            yield pd.concat([began, revived]).sort_index(kind="stable")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if not self.grouped:
            now = expiredTimerInfo.getExpiryTimeInMs()
        else:  # others may be due as well
            now = timerValues.getCurrentWatermarkInMs() if self.own_clock else timerValues.getCurrentProcessingTimeInMs()
        due = ~held["stalled"].to_numpy(bool) & (held["at"].to_numpy(np.int64) <= now - 1000 * self.seconds - 1)
        if due.any():
            held["stalled"] |= due
            self.heard.update((_packed(held),))
            if self._due(held) is not None:
                self.handle.registerTimer(self._due(held))
            yield self._told(held.loc[due, self.keys], "stalled", held["at"].to_numpy(np.int64)[due])

    def _due(self, held: pd.DataFrame) -> int | None:
        """When the first silence is to be told that hasn't been yet."""
        awake = held["at"].to_numpy(np.int64)[~held["stalled"].to_numpy(bool)]
        return int(awake.min()) + 1000 * self.seconds + 1 if len(awake) else None

    def close(self) -> None:
        pass


def silences(stream: DataFrame, keys: list[str], seq: str, at: str | None = None, seconds: int = STALL_SECONDS, late: str = "1 minute", came: str | None = None, groups: int = GROUPS) -> DataFrame:
    """``keys``, kind, since_ms, gap_seconds, seq as silences begin and end. ``seq``: the order of a key's lines within a batch. To be started within ``rocksdb``.

    With ``at``, lines may come ``late`` behind others, by their times or, if given, by ``came``; later ones are dropped, and so are lines without a time. Times count in whole seconds.
    A task holds the lines that one of the ``groups`` of keys has in a batch; a checkpoint goes with their number.
    """
    ship(stream.sparkSession)
    order = F.col(seq).cast("long").alias("line_seq")
    group = F.pmod(F.hash(*keys), F.lit(groups)).alias("line_group")
    if at is None:
        own, mode = stream.select(*keys, group, order, F.lit(None).cast("long").alias("line_at")), "processingTime"
    else:
        moment = F.col(at).cast("timestamp")
        own = stream.where(moment.isNotNull()).select(*keys, group, order, F.col(came or at).cast("timestamp").alias("line_moment"), (F.unix_seconds(moment) * 1000).alias("line_at"))
        own, mode = own.withWatermark("line_moment", late), "eventTime"
    schema = StructType([*(StructField(k, stream.schema[k].dataType) for k in keys), *StructType.fromDDL(_TOLD)])
    return own.groupBy("line_group").transformWithStateInPandas(Silence(keys, seconds, at is not None, grouped=True), schema, "append", mode)
