"""A folder of numbered entries, each a file of one JSON line, of which the next can be created by one writer only.

An entry is written aside and then moved to its number, which fails if another writer was there first: by a hard link on a local file
system, else by the rename of the Hadoop file system, which on HDFS doesn't replace a file. (On object stores without an exclusive
rename two writers could still meet.) So a reader never sees half an entry, and whoever checks something against all entries before
taking the next number knows that nothing has come in between.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _name(number: int) -> str:
    return f"{number:012d}.json"


def last(spark: SparkSession, folder: str) -> int:
    """The number of the last entry; 0 if there is none."""
    path, fs = _fs(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "._"), default=0)


def take(spark: SparkSession, folder: str, number: int, entry: dict) -> bool:
    """Create entry ``number``; False if it is there already."""
    path, fs = _fs(spark, folder)
    fs.mkdirs(path)
    text = (json.dumps(entry) + "\n").encode()
    qualified = fs.makeQualified(path).toString()
    aside = f"_{uuid.uuid4().hex}"
    if urlparse(qualified).scheme == "file":
        local = unquote(urlparse(qualified).path)
        with open(f"{local}/{aside}", "wb") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(f"{local}/{aside}", f"{local}/{_name(number)}")
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(f"{local}/{aside}")
    make = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = fs.create(make(aside), False)
    out.write(text)
    out.close()
    if fs.rename(make(aside), make(_name(number))):
        return True
    fs.delete(make(aside), False)
    return False
