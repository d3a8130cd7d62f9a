"""Operator 12: fingerprints of documents by SimHash, and all of them within a Hamming radius by permuted block tables.

A text's terms are its pairs of neighbouring words, A-Z in lower case (of a single word, the word). Each different term is hashed to
``BITS`` bits and votes on all of them, for a one or against it, with a weight that grows with the logarithm of how often it occurs.
The signs of the sums are the fingerprint. Weights are whole numbers, so equal texts have equal fingerprints, however they are dealt.
Two fingerprints that differ in d bits tell a cosine of about cos(pi * d / BITS); that, or 0 if it is negative, is their likeness.

Search: fingerprints are cut into ``BLOCKS`` blocks. Of two that differ in ``RADIUS`` bits at most, BLOCKS - RADIUS blocks are equal, so
a table for each choice of that many blocks, keyed by them, brings the two together: no pair within the radius is missed. Equal
fingerprints are one from the start, and keys that only one has are dropped first. What shares a key is compared in groups of bounded size: a key of
more than ``GROUP`` fingerprints is cut into parts, and every two of its parts meet in a task of their own. A group hands on links that connect all
that its pairs connect, at most one for each of its members, and components join them.

Each document is also compared with an edited copy: its last third is replaced by as much of the beginning of the next document, in
descending order of doc_id. For that, texts move once, to ranges of ids whose bounds are ids of a sample (8 a range); the first of a
range goes to the one before too. So no task holds more than a batch of texts and one more.

Defined cases: null texts are empty; texts without words have a fingerprint of zeros and lie within no radius; rows without a doc_id come after all others,
and rows of one doc_id in the order of their texts, and each is a document; a single document is its own next; an empty table gives no rows; further columns are ignored.
Very long texts are hashed in pieces of 1 MB; their terms take 8 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilegrid.llm.graph import components
from tilegrid.llm.kernels import PIECE, U64, Words, lower, mix, texts_of, tidied, word_hashes
from tilegrid.llm.shared import bound_batches, small, written

#: Bits of a fingerprint; blocks it is cut into for the search, and the radius.
BITS, BLOCKS, RADIUS = 256, 8, 7
#: Text bytes of a range of ids, about, where there is more than a few of them a core.
RANGE_BYTES = 64 << 20
#: Fingerprints of a part of a key; classes up to which they are broadcast (40 bytes each).
GROUP, MOST_BROADCAST = 2048, 500_000
_SALTS = np.array([mix(np.array([k + 1], U64))[0] for k in range(BITS // 64)], U64)
#: What a byte votes on each of its eight bits.
_VOTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) * 2 - 1


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash for each two neighbours."""
    return mix(h[:-1] * U64(0xD6E8FEB86659FD93) + h[1:])


def _votes(terms: np.ndarray, counts: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """The sums of votes on all bits for ``n`` texts: of different terms, how often each occurs and whose it is."""
    weight = np.rint(64 * (1 + np.log(counts)))
    out = np.empty((n, BITS), np.int64)
    for k, salt in enumerate(_SALTS):
        octets = mix(terms ^ salt).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            sums = np.bincount(owners * 256 + octets[:, j], weight, n * 256).astype(np.int64).reshape(n, 256)
            out[:, 64 * k + 8 * j : 64 * k + 8 * j + 8] = sums @ _VOTES
    return out


def _distinct(terms: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((terms, owners))
    terms, owners = terms[order], owners[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(terms)), bool), (terms[1:] != terms[:-1]) | (owners[1:] != owners[:-1]))))
    return terms[new], np.diff(np.append(new, len(terms))), owners[new]


def simhashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` / 8 bytes for each text."""
    n = len(bounds) - 1
    if len(data) <= 2 * PIECE:
        words = Words(lower(data), bounds)
        h, owner, size = words.hashes(), words.owners(), np.diff(words.first)
        inside = owner[1:] == owner[:-1]
        single = words.first[:-1][size == 1]
        terms, whose = np.concatenate([_pairs(h)[inside], h[single]]) if len(h) else h, np.concatenate([owner[1:][inside], owner[single]])
        votes = _votes(*_distinct(terms, whose), n)
    else:
        votes = np.zeros((n, BITS), np.int64)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            h = word_hashes(lower(data[a:b]))
            terms, counts = np.unique(_pairs(h) if len(h) > 1 else h, return_counts=True)
            for at in range(0, len(terms), PIECE):
                some = slice(at, at + PIECE)
                votes[i] += _votes(terms[some], counts[some], np.zeros(len(terms[some]), np.int64), 1)[0]
    return np.packbits(votes > 0, axis=1)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How alike the fingerprints of two tables are, row by row: an estimate of the cosine of their terms, 0 at least."""
    return np.maximum(0.0, np.cos(np.pi * np.bitwise_count(x ^ y).sum(1) / BITS))


def _code_points(data: np.ndarray) -> np.ndarray:
    """Where code points begin."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def _bounds_of_ranges(docs: DataFrame) -> list[int]:
    """Ids, the largest first, that begin ranges of about equal numbers of documents and ``RANGE_BYTES`` of text: every eighth id of a sample, 64 bytes a range on the driver."""
    n, largest, size = docs.agg(F.count("doc_id"), F.max("doc_id"), F.sum(F.octet_length("text"))).first()
    if not n:
        return []
    ranges = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // RANGE_BYTES)
    every = max(1, n // (8 * ranges))
    sample = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).distinct()
    found = np.union1d(sample.toArrow()["doc_id"].to_numpy(), [largest])[::-1]
    return found[:: max(1, len(found) // ranges)].tolist()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs`` (doc_id, text); fingerprints are binary."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    firsts = np.array(_bounds_of_ranges(docs), np.int64)
    ranges = max(1, len(firsts))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text with its fingerprint and its range; those that begin a range also close the one before."""
        names = ["part", "closing", "doc_id", "text", "fingerprint"]
        for batch in batches:
            prints = pa.array([p.tobytes() for p in simhashes(*texts_of(batch.column("text")))], pa.binary())
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy()
            part = np.where(known, ranges - np.searchsorted(firsts[::-1], value, "left") - 1, ranges - 1).clip(0)
            closing = np.zeros(len(batch), np.int32)
            own = [pa.array(part.astype(np.int32)), pa.array(closing), ids, batch.column("text"), prints]
            yield pa.RecordBatch.from_arrays(own, names)
            first = np.flatnonzero(known & np.isin(value, firsts))
            if len(first):
                again = pa.RecordBatch.from_arrays(own, names).take(pa.array(first))
                before = (part[first] - 1) % ranges
                yield pa.RecordBatch.from_arrays([pa.array(before.astype(np.int32)), pa.array(closing[first] + 1), *again.columns[2:]], names)

    dealt = docs.mapInArrow(lambda batches: tidied(signed(batches)), "part int, closing int, doc_id long, text string, fingerprint binary")
    if not len(firsts):  # no row has an id: in the order of their texts, round and round
        first = docs.orderBy("text").limit(1).withColumn("closing", F.lit(1))
        prints = first.select("doc_id", "text").mapInArrow(lambda batches: signed(batches), dealt.schema).withColumn("closing", F.lit(1))
        dealt = dealt.union(prints)
    dealt = dealt.repartition(ranges, "part").sortWithinPartitions("part", "closing", F.desc_nulls_last("doc_id"), "text")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            last = rows.slice(len(rows) - 1)
            if len(rows) > 1:
                yield _compared(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return dealt.mapInArrow(lambda batches: tidied(edited(batches)), schema)


def _compared(rows: pa.RecordBatch) -> pa.RecordBatch:
    """What is told of all rows but the last, each with the row after it; rows that only close a range are left out."""
    data, bounds = texts_of(rows.column("text"))
    begins = _code_points(data)
    first = np.searchsorted(begins, bounds)
    n_chars = np.diff(first)
    begins = np.append(begins, len(data))
    some = np.flatnonzero(rows.column("closing").to_numpy()[:-1] == 0)
    n, follows = n_chars[some], n_chars[some + 1]
    gone = n // 3
    kept_to, taken_to = begins[first[some] + n - gone], begins[first[some + 1] + np.minimum(gone, follows)]
    texts = [data[a:b].tobytes() + data[c:d].tobytes() for a, b, c, d in zip(bounds[some], kept_to, bounds[some + 1], taken_to, strict=True)]
    sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)))
    after = simhashes(np.frombuffer(b"".join(texts), np.uint8), sizes)
    prints = np.frombuffer(b"".join(rows.column("fingerprint").to_pylist()), np.uint8).reshape(-1, BITS // 8)
    columns = [
        rows.column("doc_id").take(pa.array(some)), pa.array(n), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), rows.column("fingerprint").take(pa.array(some)),
        pa.array([p.tobytes() for p in after], pa.binary()), pa.array(likeness(prints[some], after)), pa.array(likeness(prints[some], prints[some + 1])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _keys(prints: np.ndarray, blocks: int, radius: int) -> np.ndarray:
    """A row of keys for each fingerprint, one for each choice of blocks that may be the equal ones."""
    bits = np.unpackbits(prints, axis=1)
    cuts = np.linspace(0, prints.shape[1] * 8, blocks + 1).astype(int)
    out = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        h = np.full(len(prints), k + 1, U64)
        for block in chosen:
            part = np.packbits(bits[:, cuts[block] : cuts[block + 1]], axis=1)
            for j in range(part.shape[1]):
                h = h * U64(0x100000001B3) ^ part[:, j].astype(U64)
            h = mix(h)
        out.append(h.view(np.int64))
    return np.stack(out, 1)


def _spanning(nodes: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all that the pairs within the radius connect, one for each node at most."""
    words, open_, out = np.ascontiguousarray(prints).view(U64), np.arange(len(nodes)), []
    while len(open_):
        reached, open_ = [int(open_[0])], open_[1:]
        while reached and len(open_):
            i = reached.pop()
            near = np.bitwise_count(words[open_] ^ words[i]).sum(1) <= radius
            out += [(int(nodes[i]), int(nodes[j])) for j in open_[near]]
            reached += open_[near].tolist()
            open_ = open_[~near]
    return out


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links of ``prints`` (node, fingerprint; all different) that connect all that pairs within ``radius`` connect."""
    bound_batches(prints.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint8).reshape(len(batch), -1)
            made = _keys(own, blocks, radius)
            at = np.repeat(np.arange(len(batch)), made.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), batch.column("node").take(pa.array(at))], ["key", "node"])

    keys = prints.mapInArrow(keyed, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    shared = written(shared, "fingerprints-keys")
    held = keys.join(small(shared, MOST_BROADCAST), "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    # A part meets every other part of its key; all of a key in one part meet at once.
    other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("own")) | (F.col("parts") == 1))
    met = held.select("key", "node", "own", F.explode(other).alias("other")).select("key", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    met = met.join(prints, "node").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, own = None, [], []

        def told() -> pa.RecordBatch:
            links = _spanning(np.array(nodes), np.frombuffer(b"".join(own), np.uint8).reshape(len(own), -1), radius) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for *key, node, print_ in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y", "node", "fingerprint")), strict=True):
                if key != at:
                    yield told()
                    at, nodes, own = key, [], []
                nodes.append(node)
                own.append(print_)
        yield told()

    return met.select("key", "x", "y", "node", "fingerprint").mapInArrow(linked, "a long, b long").distinct()


def near_classes(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fingerprint, class_id of all different fingerprints of ``prints`` (doc_id, fingerprint): the smallest doc_id that can be reached by steps within the radius."""
    zero = F.lit(bytes(BITS // 8))
    once = prints.where((F.col("fingerprint") != zero) & F.col("doc_id").isNotNull()).groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    once = written(once, "fingerprints-once")
    joined = components(written(near_links(once, radius, blocks), "fingerprints-links"), "fingerprints-classes")
    return once.join(small(joined, MOST_BROADCAST), "node", "left").select("fingerprint", F.coalesce("component", "node").alias("class_id"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All of ``fingerprinted`` for every row, fingerprints in hex, and class_id: the smallest doc_id that fingerprints within ``radius`` lead to (null without a doc_id)."""
    rows = written(fingerprinted(docs), "fingerprints-rows")
    classes = near_classes(rows.select("doc_id", "fingerprint"), radius, blocks)
    told = rows.join(classes, "fingerprint", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return told.select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next", own)
