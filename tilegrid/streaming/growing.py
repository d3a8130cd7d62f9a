"""Following files that grow: a streaming source whose offsets are byte positions, one for each file of a folder.

A batch holds the lines that have been completed since the last: its end is behind the last line break of each file, so a line that is
still being written waits for the rest of itself, and a stream that starts anew from its checkpoint goes on at the byte where it
stopped. Ranges of bytes are dealt to tasks in blocks; a block's lines are those that begin in it, as with any text file.

The folder is reached by Arrow's file systems (local, HDFS, S3, GCS), whose listing the driver does anew at each trigger. A file is only
ever appended to: what has vanished or has become shorter gives no lines until it is longer than it was. Lines are UTF-8, and what isn't
becomes replacement characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tilegrid.sources.package import ship

#: Bytes of a task's block; bytes that are looked through at once for a line break.
BLOCK, STEP = 16 << 20, 1 << 16
SCHEMA = "value string, path string, at bigint"
#: Lines that one Arrow batch has at most.
LINES = 10_000


class Block(NamedTuple):
    path: str
    start: int
    stop: int
    end: int


class BlockPartition(InputPartition):
    def __init__(self, block: Block):
        super().__init__(tuple(block))


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _last_break(file, size: int) -> int:
    """The place behind the last line break of a file's first ``size`` bytes; 0 if there is none."""
    stop = size
    while stop:
        start = max(0, stop - STEP)
        file.seek(start)
        found = file.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return 0


def complete(uri: str) -> dict[str, int]:
    """How many bytes of each file in a folder hold whole lines. Names that begin with a dot or an underscore are none of the log's."""
    system, folder = _folder(uri)
    out = {}
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.is_file and info.size and info.base_name[0] not in "._":
            with system.open_input_file(info.path) as file:
                out[info.path] = _last_break(file, info.size)
    return out


def blocks(start: dict[str, int], end: dict[str, int], size: int = BLOCK) -> list[Block]:
    """What lies between two offsets, in blocks."""
    return [Block(path, a, min(a + size, stop), stop) for path, stop in sorted(end.items()) for a in range(start.get(path, 0), stop, size)]


def lines(uri: str, block: Block) -> Iterator[tuple[bytes, int]]:
    """The lines that begin in a block, and where."""
    system, _ = _folder(uri)
    with system.open_input_file(block.path) as file:
        at = max(0, block.start - 1)
        file.seek(at)
        rest, skipping = b"", block.start > 0  # from one byte before the block, up to a line break: not the block's
        where = at
        while at < block.end:
            piece = file.read(min(1 << 20, block.end - at))
            if not piece:
                return
            at += len(piece)
            *whole, rest = (rest + piece).split(b"\n")
            for line in whole:
                if skipping:
                    skipping = False
                elif where >= block.stop:
                    return
                else:
                    yield line, where
                where += len(line) + 1
            if where >= block.stop and not skipping:
                return


def _dealt(found: list[Block]) -> list[InputPartition]:
    """A partition for each block; one of nothing if there is none, which Spark wants."""
    return [BlockPartition(b) for b in found or [Block("", 0, 0, 0)]]


def _read(uri: str, partition: InputPartition) -> Iterator[pa.RecordBatch]:
    block = Block(*partition.value)
    values, places = [], []

    def batch() -> pa.RecordBatch:
        texts = pa.array([v.decode("utf-8", "replace") for v in values], pa.string())
        return pa.RecordBatch.from_arrays([texts, pa.array([block.path] * len(values), pa.string()), pa.array(places, pa.int64())], ["value", "path", "at"])

    for value, at in lines(uri, block) if block.path else ():
        values.append(value.removesuffix(b"\r"))
        places.append(at)
        if len(values) == LINES:
            yield batch()
            values, places = [], []
    yield batch()


class _Stream(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": complete(self.uri)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(blocks(start["files"], end["files"]))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition)


class _Batch(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        return _dealt(blocks({}, complete(self.uri)))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition)


class GrowingLines(DataSource):
    """``growing_lines``: value, path, at (where the line begins) of the whole lines in the files of the folder ``path``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """value, path, at of all lines that are or will be completed in the files of ``folder``, as a stream."""
    ship(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", folder).load()


def held(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines as they are now, as a table."""
    ship(spark)
    spark.dataSource.register(GrowingLines)
    return spark.read.format("growing_lines").option("path", folder).load()
