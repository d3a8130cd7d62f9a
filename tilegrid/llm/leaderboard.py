"""Operator 13: the change feed of a leaderboard, by a tournament tree for each nation, kept as streaming state.

A nation's items are dealt to leaves by a hash of their ids. A leaf keeps the running revenue of its items and tells its node the ten
best of them; a node keeps the tens of up to ``FAN`` children, and tells its own ten to the next; the root's ten are the board. Each
level is a stateful streaming query of its own, keyed by nation and node, and reads the files that the level below appends (one query
can't hold several such operators). Within a batch the days are gone through in order; a day's updates touch only the leaves they fall
in, and only a node one of whose children changed its ten that day is worked out again, up to the root, which is compared with what it
was. Along with a new ten goes the revenue of the items that left it, since a board tells that of its exits too.

So no task holds a nation: a leaf has about ``LEAF`` items, a node ``FAN`` tens, and the number of levels follows from the number of
items. Lines of one item and day are added up before they are dealt, so a hot item moves a few rows a task and batch.

Lines are first cut into batches by arrival: they meet ``items`` and ``vendors`` in shuffled joins, whose hot keys Spark's adaptive
skew join splits, and are written once. Each batch then becomes the new files of the stream's folder, and every level is started anew
on its checkpoint; files and state are committed together, so a start that fails can be made again.

Defined cases: null ids, amounts, quantities, prices, flags and dates as the contract says; lines that arrive before the first day
belong to batch 1; of repeated rows of an item or a vendor the least price or nation counts; repeated lines all count; a nation or
items without lines have no rows; empty tables give no rows; further columns of the tables are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilegrid.llm.shared import _path, bound_batches, shared_folder, written

#: Places of a board; items of a leaf, about; children of a node.
TOP, LEAF, FAN = 10, 2048, 32
#: Batches, the first day, the days that they divide, and how many days a line may be late.
BATCHES, FIRST_DAY, DAYS, LATE = 10, 19723, 180, 3
_TEN = "day long, child int, items array<long>, cents array<long>, gone array<long>, gone_cents array<long>"
_COLUMNS = ["nation_id", "node", *(c.split()[0] for c in _TEN.split(", "))]
_CHANGES = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"


def batch_of(arrival: Column) -> Column:
    """The batch of an arrival day."""
    return F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((arrival - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def placed_lines(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """batch, arrival, day, nation_id (null: the line is ignored), item_id, cents of each line."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat(text("sale_id"), F.lit(","), text("item_id"), F.lit(","), text("vendor_id"), F.lit(","), text("line_no"))
    own = lines.select("item_id", "vendor_id", "quantity", "amount", (F.col("flag") == "swapped").alias("back"), F.unix_date(F.to_date("shipped_at")).cast("long").alias("day"), F.crc32(key.cast("binary")).alias("h"))
    own = own.withColumn("day", F.coalesce("day", FIRST_DAY + F.col("h") % 150))
    arrival = F.col("day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    own = own.select("item_id", "vendor_id", "quantity", F.floor(100 * F.col("amount") + 0.5).alias("cents"), "back", "day", arrival.alias("arrival"))
    prices = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min(F.floor(100 * F.col("price") + 0.5)).alias("price")).withColumn("known", F.lit(True))
    homes = vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id"))
    # Tables, so that each join's sides are plain shuffles, which alone the adaptive skew join can split; the hints keep both from being broadcast.
    own = own.join(written(prices, "board-prices").hint("shuffle_hash"), "item_id", "left")
    cents = F.coalesce("cents", F.col("quantity") * F.col("price"), F.lit(0)) * F.when(F.col("back"), -1).otherwise(1)
    own = own.select("item_id", "vendor_id", cents.cast("long").alias("cents"), "known", "day", "arrival")
    own = own.join(written(homes, "board-homes").hint("shuffle_hash"), "vendor_id", "left")
    return own.select(batch_of(F.col("arrival")).alias("batch"), "arrival", "day", F.when(F.col("known"), F.col("nation_id")).alias("nation_id"), "item_id", "cents")


def best(items: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ten highest positive revenues, highest first, ties to smaller ids."""
    up = np.flatnonzero(cents > 0)
    if len(up) > TOP:
        value = cents[up]
        up = up[value >= np.partition(value, len(up) - TOP)[len(up) - TOP]]
    up = up[np.lexsort((items[up], -cents[up]))][:TOP]
    return items[up], cents[up]


def added_up(lines: DataFrame) -> DataFrame:
    """nation_id, item_id, arrival, cents with the lines of one nation, item and day as one row for each Arrow batch: a hot item's lines never move one by one."""
    keys = ["nation_id", "item_id", "arrival"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("cents", "sum")])
            yield from sums.select([*keys, "cents_sum"]).rename_columns([*keys, "cents"]).to_batches()

    return lines.select(*keys, "cents").mapInArrow(run, "nation_id int, item_id long, arrival long, cents long")


def _frames(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = [*frames]
    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)


def _longs(kept: bytes | bytearray) -> np.ndarray:
    return np.frombuffer(bytes(kept), np.int64)


def leaf_tens(lines: DataFrame, leaves: int) -> DataFrame:
    """The changes of each leaf's ten, for its node: nation_id, node, day, child (the leaf), items, cents, gone, gone_cents."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nation, leaf = key
        rows = _frames(frames)
        items, cents = map(_longs, state.get) if state.exists else (np.zeros(0, np.int64),) * 2
        new, days, amounts = rows["item_id"].to_numpy(), rows["arrival"].to_numpy(), rows["cents"].to_numpy()
        every = np.union1d(items, new)
        sums = np.zeros(len(every), np.int64)
        sums[np.searchsorted(every, items)] = cents
        at, order = np.searchsorted(every, new), np.argsort(days, kind="stable")
        ten, out, placed = best(every, sums), [], np.zeros(len(every), bool)
        placed[np.searchsorted(every, ten[0])] = True
        starts = np.flatnonzero(np.diff(days[order], prepend=-1))
        for some in np.split(order, starts[1:]):
            touched = at[some]
            np.add.at(sums, touched, amounts[some])
            least = ten[1][-1] if len(ten[1]) == TOP else 1
            if sums[touched].max() < least and not placed[touched].any():  # nothing in the ten, and nothing that could enter it
                continue
            placed[np.searchsorted(every, ten[0])] = False
            before, ten = ten, best(every, sums)
            placed[np.searchsorted(every, ten[0])] = True
            if not (np.array_equal(before[0], ten[0]) and np.array_equal(before[1], ten[1])):
                gone = np.setdiff1d(before[0], ten[0])
                out.append((int(nation), int(leaf) // FAN, int(days[some[0]]), int(leaf), *ten, gone, sums[np.searchsorted(every, gone)]))
        state.update((every.tobytes(), sums.tobytes()))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    own = lines.where("nation_id IS NOT NULL").withColumn("leaf", F.pmod(F.xxhash64("item_id"), F.lit(leaves)).cast("int"))
    return own.groupBy("nation_id", "leaf").applyInPandasWithState(fold, f"nation_id int, node int, {_TEN}", "items binary, cents binary", "append", GroupStateTimeout.NoTimeout)


def _days(rows: pd.DataFrame, state: GroupState) -> Iterator[tuple[int, tuple, tuple, dict[int, int]]]:
    """Of each day with changed children, in order: the day, the node's ten before and after, and the revenue of all items that left them. Updates the state: child, item and cents of each place of each child."""
    held = _longs(state.get[0]).reshape(-1, 3) if state.exists else np.zeros((0, 3), np.int64)
    ten = best(held[:, 1], held[:, 2])
    for day, told in rows.sort_values(["day", "child"]).groupby("day", sort=True):
        known = dict(zip(held[:, 1].tolist(), held[:, 2].tolist(), strict=True))
        new = [np.column_stack((np.full(len(i), c), i, m)) for c, i, m in zip(told["child"], told["items"], told["cents"], strict=True)]
        held = np.concatenate([held[~np.isin(held[:, 0], told["child"])], *new]).astype(np.int64)
        known |= {i: m for ids, sums in zip(told["gone"], told["gone_cents"], strict=True) for i, m in zip(ids.tolist(), sums.tolist(), strict=True)}
        known |= dict(zip(held[:, 1].tolist(), held[:, 2].tolist(), strict=True))
        before, ten = ten, best(held[:, 1], held[:, 2])
        yield int(day), before, ten, known
    state.update((held.tobytes(),))


def node_tens(tens: DataFrame) -> DataFrame:
    """The changes of each node's ten, for the node above."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nation, node = key
        out = []
        for day, before, ten, known in _days(_frames(frames), state):
            if not (np.array_equal(before[0], ten[0]) and np.array_equal(before[1], ten[1])):
                gone = np.setdiff1d(before[0], ten[0])
                out.append((int(nation), int(node) // FAN, day, int(node), *ten, gone, np.array([known[i] for i in gone.tolist()], np.int64)))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return tens.groupBy("nation_id", "node").applyInPandasWithState(fold, f"nation_id int, node int, {_TEN}", "held binary", "append", GroupStateTimeout.NoTimeout)


def root_changes(tens: DataFrame) -> DataFrame:
    """What changes on each nation's board: nation_id, arrival_day, item_id, change, old_rank, new_rank, revenue."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        for day, before, ten, known in _days(_frames(frames), state):
            old, new = ({item: rank for rank, item in enumerate(ids.tolist(), 1)} for ids in (before[0], ten[0]))
            for item in sorted(old.keys() | new.keys()):
                if old.get(item) != new.get(item):
                    change = "enter" if item not in old else "exit" if item not in new else "move"
                    out.append((int(key[0]), day, item, change, old.get(item), new.get(item), known[item]))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGES.split(", ")])
            yield frame.astype({"old_rank": "Int32", "new_rank": "Int32"})

    return tens.groupBy("nation_id").applyInPandasWithState(fold, _CHANGES, "held binary", "append", GroupStateTimeout.NoTimeout)


def _step(made: DataFrame, folder: str, name: str) -> None:
    """Work through all that is new in a stream's source, once; what it gives is appended to ``folder/name``."""
    query = made.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start()
    query.awaitTermination()


def leaderboard_changes(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue: cut ``lines`` into batches and feed them, one start of each level's query for each."""
    spark = lines.sparkSession
    bound_batches(spark)
    folder = f"{shared_folder(spark)}/leaderboard-{uuid.uuid4().hex}"
    placed = placed_lines(lines, items, vendors)
    placed.write.partitionBy("batch").parquet(f"{folder}/cut")
    last = {r.batch: r.day for r in spark.read.schema(placed.schema).parquet(f"{folder}/cut").groupBy("batch").agg(F.max("day").alias("day")).collect()}  # a row for each batch
    leaves = max(1, -(-items.count() // LEAF))
    widths = [-(-leaves // FAN)]  # nodes of each level above the leaves, a nation
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // FAN))
    names = ["lines", *(f"tens{i}" for i in range(len(widths))), "changes"]
    paths = {name: _path(spark, f"{folder}/{name}") for name in names}
    for path, fs in paths.values():
        fs.mkdirs(path)
    ten = f"nation_id int, node int, {_TEN}"
    read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", name == "lines").parquet(f"{folder}/{name}")
    seen = None
    for batch in range(1, BATCHES + 1):
        if batch in last:
            path, fs = paths["lines"]
            fs.rename(_path(spark, f"{folder}/cut/batch={batch}")[0], _path(spark, f"{folder}/lines/{batch}")[0])
        stream = read("lines", placed.drop("batch").schema)
        fresh = stream if seen is None else stream.where(F.col("day") + LATE >= seen)
        _step(leaf_tens(added_up(fresh), leaves), folder, "tens0")
        for i in range(1, len(widths)):
            _step(node_tens(read(f"tens{i - 1}", ten)), folder, f"tens{i}")
        _step(root_changes(read(names[-2], ten)), folder, "changes")
        seen = max((x for x in (seen, last.get(batch)) if x is not None), default=None)
    told = spark.read.schema(_CHANGES).parquet(f"{folder}/changes")
    return told.select("nation_id", "arrival_day", "item_id", batch_of(F.col("arrival_day")).alias("batch"), "change", "old_rank", "new_rank", "revenue")
