"""Operator 9: token ids in seekable files.

A file is a row of independent zstandard frames, one for each document (its ids as little-endian unsigned 32-bit integers),
then a skippable frame with the document ids, then the seek table of the public zstandard seekable format: compressed size,
size and checksum (low half of XXH64) of each frame. A reader takes the table from the file's end and decompresses only the
frames of the documents asked for; each is checked against its checksum. Documents are in ascending doc_id order within and
across the files of a folder.

Files are written under a name of the attempt and then moved, so a lost executor leaves no broken file and a task that runs again
replaces its file by an equal one. Paths may be in any store that pyarrow opens.

Defined cases: null or empty text has the end id alone; rows with a null doc_id come first; repeated rows are written as often as
they occur, those of one doc_id in the order of their checksums, and an id that would fill several files is divided among them (rows that are
equal in text too are not); doc_id must be a whole number (cast to long); an empty table gives files without documents; further columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilegrid.llm.kernels import PIECE, Words, equal_spans, lower, pieces, texts_of, tidied
from tilegrid.llm.shared import bound_batches, shared_folder, written

# Of the zstandard seekable format, and a magic number of the range that readers skip.
SEEK_MAGIC, SKIP_TABLE, SKIP_IDS, HAS_CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x80
#: Words remembered by a worker, about (50 bytes each), and the longest of them.
REMEMBERED, LONGEST = 500_000, 256
#: Documents of a file, about, and files at most (their bounds are in the driver; beyond 160 million documents files grow instead).
DOCS_A_FILE, MOST_FILES = 8192, 20_000
#: Bytes that are read at once, about.
A_READ = 4 << 20


#: Lines as (word of Latin letters, mark after it, "") or ("", "", line). No normalizer composes such letters anew, and every Unicode version lower-cases them alike.
_PARTS = re.compile("^(?:([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)$|([^\n]*)$)", re.M).findall
#: Words that tell whether the short way below gives a tokenizer's own ids.
_PROBES = ["a", "word", "Word", "WORDS", "z\u00e9ro", "\u00dcber", "stra\u00dfe", "\u00c9t\u00e9", "se\u00f1or", "xqzjv", "internationalisation", "\u00f0\u00fe\u00e6\u00f8"]


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet for UTF-8 bytes of letters: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    printable = {10, *range(33, 127), *range(161, 173), *range(174, 256)}  # the line end stays, to split at
    rest = (chr(256 + n) for n in range(256))
    skipped = [b for b in range(256) if b not in printable or b == 10]
    stands = dict(zip(skipped, rest, strict=False))
    return {b: chr(b) if b in printable else stands[b] for b in range(256)}


class Encoder:
    """Token ids of texts as bytes.

    Probes tell whether the tokenizer lower-cases, splits at white space and splits marks from letters. If so, the words of a batch are
    hashed at once, each different word is looked up in a sorted table (bounded in size), only new words are
    encoded - those of Latin letters by the tokenizer's model directly - and the ids are gathered from one array. Words of one hash are
    compared byte by byte, so a hash never decides. Very long texts go through in pieces, cut between words. Otherwise, and for
    texts that spell a special token or where two words share a hash, the tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.special = [t["content"].lower().encode() for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.letters = _byte_letters()
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        #: The bytes of the words in the table: where each begins and ends in ``spelt``.
        self.spelt, self.from_, self.upto = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        marked = [w + m for w in _PROBES for m in ("", ".", ",")]
        whole, self.plain = self._whole(marked), True
        self.marks = dict(zip(".,", self._whole([".", ","]), strict=True)) | {"": b""}
        self.plain = self._short(marked) == whole and b"".join(whole) == self._whole([" \t\r\n\v\f ".join(marked)])[0]

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _short(self, chunks: list[str]) -> list[bytes]:
        """Words of Latin letters by the model alone, the others whole. No chunk holds a line end."""
        if not self.plain:
            return self._whole(chunks)
        parts = _PARTS("\n".join(chunks))
        words = "\n".join([word for word, _, _ in parts if word]).lower()
        if not words.isascii():
            words = words.encode().decode("latin-1").translate(self.letters)
        short = iter([_packed(e.ids) for e in self.model.encode_batch_fast(words.split("\n"), add_special_tokens=False)] if words else [])
        long = iter(self._whole([rest for word, _, rest in parts if not word]))
        marks = self.marks
        return [next(long) if not word else next(short) + marks[mark] if mark else next(short) for word, mark, _ in parts]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new words are in the store, and how many."""
        made = self._short(words)
        size = np.array([len(x) // 4 for x in made], np.int32)
        ids = np.frombuffer(b"".join(made), np.uint32)
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros(len(self.store), np.uint32)))
        self.store[self.used : self.used + len(ids)] = ids
        return self.used + np.cumsum(size) - size, size

    def ids(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of a string column; of null, none."""
        data, bounds = texts_of(column)
        if not self.plain or len(data) <= 2 * PIECE:
            return self._ids(data, bounds)
        return [b"".join(self._ids(p, np.array([0, len(p)]))[0] for p in pieces(data[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _ids(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        low = lower(data)
        raw = low.tobytes()
        whole = lambda: self._whole([data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        if not self.plain or any(s in raw for s in self.special):
            return whole()
        words = Words(low, bounds)
        own, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        a, b = words.starts[first], words.ends[first]
        if not equal_spans(low, words.starts, words.ends, low, a[which], b[which]):
            return whole()
        place = np.searchsorted(self.hashes, own)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == own[known]
        if not equal_spans(low, a[known], b[known], self.spelt, self.from_[place[known]], self.upto[place[known]]):
            return whole()
        at, size = np.zeros(len(own), np.int64), np.zeros(len(own), np.int32)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        if not known.all():
            short = ~known & (b - a <= LONGEST)
            new = np.concatenate((np.flatnonzero(short), np.flatnonzero(~known & ~short)))
            at[new], size[new] = self._words([raw[x:y].decode() for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True)])
            if len(self.hashes) < REMEMBERED:
                self.used += int(size[short].sum())
                where, length = place[short], (b - a)[short]
                upto = len(self.spelt) + np.cumsum(length)
                self.spelt = np.concatenate([self.spelt, *(low[x:y] for x, y in zip(a[short].tolist(), b[short].tolist(), strict=True))])
                columns = ((self.hashes, own[short]), (self.at, at[short]), (self.size, size[short]), (self.from_, upto - length), (self.upto, upto))
                self.hashes, self.at, self.size, self.from_, self.upto = (np.insert(old, where, x) for old, x in columns)
        sizes = size[which].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.store[np.repeat(at[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4", copy=False)
        cuts = np.concatenate((np.zeros(1, np.int64), ends))[words.first].tolist()
        return [ids[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it remembers serves all its tasks."""
    return Encoder(path)


def check_of(ids: bytes) -> int:
    return xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF


class Writer:
    """Writes one file from frames that are ready, document by document."""

    def __init__(self, out):
        self.out, self.table, self.doc_ids = out, [], []

    def add(self, doc_id: int | None, frame: bytes, size: int, check: int) -> None:
        self.out.write(frame)
        self.table.append((len(frame), size, check))
        self.doc_ids.append(struct.pack("<Bq", doc_id is not None, doc_id or 0))

    def close(self) -> None:
        ids = b"".join(self.doc_ids)
        self.out.write(struct.pack("<II", SKIP_IDS, len(ids)) + ids)
        self.table.append((len(ids) + 8, 0, check_of(b"")))
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(body)) + body)
        self.out.close()


class Reader:
    """Reads documents of one file: ``len(reader)``, ``reader.doc_ids``, ``reader.read(position)``."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.table[:, 0], dtype=np.int64)))
        file.seek(int(self.at[n - 1]) + 8)
        raw = np.frombuffer(file.read(9 * (n - 1)), np.dtype([("known", "u1"), ("id", "<i8")]))
        self.doc_ids = [int(x["id"]) if x["known"] else None for x in raw]
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def read(self, position: int) -> bytes:
        """The ids of the document at ``position``; only its frame is read and decompressed."""
        return next(self.read_range(position, position + 1))

    def read_range(self, begin: int, end: int) -> Iterator[bytes]:
        """The ids of the documents from ``begin`` up to ``end``: neighbouring frames come in one read of about ``A_READ`` bytes."""
        while begin < end:
            stop = max(begin + 1, min(end, int(np.searchsorted(self.at, self.at[begin] + A_READ, "right")) - 1))
            self.file.seek(int(self.at[begin]))
            raw, start = self.file.read(int(self.at[stop] - self.at[begin])), int(self.at[begin])
            for position in range(begin, stop):
                a, (packed, size, check) = int(self.at[position]) - start, (int(x) for x in self.table[position])
                ids = self.unpacker.decompress(raw[a : a + packed], max_output_size=size) if size else b""
                if len(ids) != size or check_of(ids) != check:
                    raise ValueError(f"frame {position} is damaged")
                yield ids
            begin = stop


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _ordered(doc_id: Column) -> Column:
    """The id, or the least there is for null."""
    return F.coalesce(doc_id.cast("long"), F.lit(int(np.iinfo(np.int64).min)))


def _bounds(docs: DataFrame, docs_a_file: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, checksum) pairs that divide the documents, in their order, into files of about ``docs_a_file``; at most ``MOST_FILES``.

    An id that fills several files, because its rows repeat, is divided by the checksums of its texts.
    """
    n = docs.count()
    files = min(MOST_FILES, -(-n // docs_a_file))
    if files < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = docs.agg(F.percentile_approx(_ordered(F.col("doc_id")), [k / files for k in range(1, files)], 100 * files).alias("at")).first()["at"]
    ids, times = np.unique(np.array(at, np.int64), return_counts=True)
    pairs = [(i, (k << 32) // m) for i, m in zip(ids.tolist(), times.tolist(), strict=True) for k in range(1, m + 1)]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def _parts(bounds: tuple[np.ndarray, np.ndarray], ids: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The file of each document: how many bounds lie before it."""
    first, last = np.searchsorted(bounds[0], ids, "left"), np.searchsorted(bounds[0], ids, "right")
    for i in np.flatnonzero(last - first > 1).tolist():
        first[i] += np.searchsorted(bounds[1][first[i] : last[i]], checks[i], "left")
    return first.astype(np.int32)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, docs_a_file: int = DOCS_A_FILE) -> DataFrame:
    """Encode and write all texts; returns (part, path, n_docs, n_tokens), a row for each file. Runs at once.

    Texts are encoded and packed where they are read; only packed frames are shuffled.
    """
    bound_batches(docs.sparkSession)
    bounds = _bounds(docs, docs_a_file)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, struct.pack("<I", end_id)
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
        for batch in batches:
            ids = [x + end for x in encode(batch.column("text"))]
            doc_id, check = batch.column("doc_id"), np.array([check_of(x) for x in ids], np.int64)
            part = _parts(bounds, doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(), check)
            columns = [pa.array(part), doc_id, pa.array([packer.compress(x) for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(check)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "frame", "size", "checksum"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        name, draft = f"{root}/part-{part:06d}.ids", f"{root}/.draft-{part:06d}-{uuid.uuid4().hex}"
        writer, n_bytes = Writer(store.open_output_stream(draft)), 0
        for batch in batches:
            for doc_id, frame, size, check in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "frame", "size", "checksum")), strict=True):
                writer.add(doc_id, frame, size, check)
                n_bytes += size
        writer.close()
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.doc_ids)]), pa.array([n_bytes // 4])], ["part", "path", "n_docs", "n_tokens"])

    frames = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: tidied(pack(batches)), "part int, doc_id long, frame binary, size long, checksum long")
    placed = frames.repartitionById(len(bounds[0]) + 1, "part").sortWithinPartitions("doc_id", "checksum", "frame").drop("part")
    return written(placed.mapInArrow(lambda batches: tidied(write(batches)), "part int, path string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, read back frame by frame."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    based = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    reader = Reader(file)
                    for a in range(0, len(reader), 4096):
                        own = range(a, min(a + 4096, len(reader)))
                        sums = [zlib.crc32(ids) for ids in reader.read_range(own.start, own.stop)]
                        sizes = reader.table[own.start : own.stop, 1].astype(np.int64) // 4
                        starts = base + np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
                        base = int(starts[-1])
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[a : own.stop], pa.int64()), pa.array(starts[:-1]), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = based.repartition(max(1, files.count()), "part")
    return spread.mapInArrow(lambda batches: tidied(run(batches)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token files and return what reading them back gives. ``folder``: a URI; by default one of its own in the shared folder."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id), folder)
