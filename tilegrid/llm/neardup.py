"""Operator 5: near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct 5-word shingles. Documents of equal sets form a class, and one row stands for the class, so a
group of exact copies costs one document from there on. A class has a signature of ``CHUNKS * WIDTH`` MinHash symbols of 8 bits.
Signatures are cut into chunks; within each chunk one wrong symbol is enumerated, that is, each symbol is left out in turn and the
others are the key. Signatures that differ in at most ``2 * CHUNKS - 1`` (35) symbols have a chunk with at most one difference
(pigeonhole), so they share a key: no such pair is missed. That is the guaranteed threshold. Beyond it a pair is found if any chunk
differs in at most one symbol; of pairs at a similarity of 0.8, 3 in a million are not, and of those at 0.85, 4 in a thousand
million.

Classes that share a key are candidates. A key's classes meet its least class, never each other, so candidates grow with the keys
and not with their pairs. Each class is first compared, on full shingle sets, with the class that is the least of most of its keys,
and, where that doesn't link it, with the next (``ROUNDS``): a group of n copies costs n comparisons, and each of its texts moves
once a round. Only classes that these links leave outside the largest component of their candidate group are then compared with
the group's others, in blocks of bounded size, by signature first (within ``FAR`` symbols) and then on full sets.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; rows with a null doc_id are returned
with a null component, kept, and link nothing; repeated rows are returned as often as they occur; rows that share a doc_id are one
document, which links by each of its texts and lies in one component; doc_id must be a whole number (cast to long); further columns
are ignored by ``near_duplicates`` and stay in ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilegrid.llm.graph import Sets, components
from tilegrid.llm.kernels import PIECE, U64, Words, distinct, lower, mix, pieces, shingles, texts_of, tidied
from tilegrid.llm.shared import bound_batches, dropped, packed, small, unpacked, written

#: Words of a shingle; links need PERCENT * union <= 100 * intersection.
SHINGLE, PERCENT = 5, 85
#: Chunks of a signature and symbols of a chunk.
CHUNKS, WIDTH = 18, 8
SYMBOLS = CHUNKS * WIDTH
#: Signatures that differ in more symbols aren't compared: at a similarity of 0.8, 28.8 are expected, and 58 lie six deviations above.
FAR = 58
#: Rounds of comparisons with a least class before the rest is compared in blocks.
ROUNDS = 2
#: Documents and shingles of a block, about; and documents that pass by it in one task.
BLOCK_DOCS, BLOCK_SHINGLES, PASSING = 512, 1 << 20, 2048
#: Rows of ids or keys up to which they are broadcast (16 bytes each); beyond, the join shuffles.
MOST_BROADCAST = 500_000
_CHUNKS = [f"c{i}" for i in range(CHUNKS)]
_FACTORS = np.random.default_rng(11).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, bounds = texts_of(column)
    if len(data) <= 2 * PIECE:
        words = Words(lower(data), bounds)
        return distinct(*shingles(words.hashes(), words.first, k))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # among them a very long text
        hashes = np.concatenate([Words(lower(p), np.array([0, len(p)])).hashes() for p in pieces(data[a:b])])
        out += distinct(*shingles(hashes, np.array([0, len(hashes)]), k))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 8-bit MinHash symbols for each set; of empty sets, zeros."""
    out = np.zeros((len(sets), SYMBOLS), np.uint8)
    least = np.zeros((len(sets), SYMBOLS), np.uint32)
    short = [i for i, s in enumerate(sets) if 0 < len(s) <= PIECE]
    if short:
        values = np.concatenate([sets[i] for i in short])
        at = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(sets[i]) for i in short])))[:-1]
        for j, factor in enumerate(_FACTORS):
            least[short, j] = np.minimum.reduceat(((values * factor) >> U64(32)).astype(np.uint32), at)
    for i in (i for i, s in enumerate(sets) if len(s) > PIECE):
        parts = [sets[i][a : a + PIECE] for a in range(0, len(sets[i]), PIECE)]
        for j, factor in enumerate(_FACTORS):
            least[i, j] = min(int(((p * factor) >> U64(32)).min()) for p in parts)
    full = [i for i, s in enumerate(sets) if len(s)]
    out[full] = (mix(least[full].astype(np.uint64).ravel()) & U64(255)).astype(np.uint8).reshape(-1, SYMBOLS)
    return out


def _digest(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, set_key (binary), c0, c1, ...: the chunks of the signature, eight symbols to a long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            longs = signatures(sets).view("<i8")
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(CHUNKS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *own], ["doc_id", "t", "n_shingles", "set_key", *_CHUNKS])

    schema = "doc_id long, t long, n_shingles long, set_key binary, " + ", ".join(f"{c} long" for c in _CHUNKS)
    return _texts(docs).mapInArrow(lambda batches: tidied(run(batches)), schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def _keys() -> Column:
    """For each chunk and each symbol left out of it, a hash of the place and the other symbols."""
    masks = [~(0xFF << 8 * j) & (2**64 - 1) for j in range(WIDTH)]
    masks = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.array(*(F.xxhash64(F.lit(i * WIDTH + j), F.col(f"c{i}").bitwiseAND(F.lit(masks[j]).cast("long"))) for i in range(CHUNKS) for j in range(WIDTH)))


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(a, b, n): each class with the least class of its keys, and how many keys say so."""
    keyed = classes.select("node", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
    shared = written(shared, "neardup-keys")
    pairs = keyed.join(shared, "key").where("node <> low").groupBy(F.col("node").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("n"))
    pairs = written(pairs, "neardup-pairs")
    dropped(shared)
    return pairs


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, sorted, overlap enough."""
    small_, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small_) < percent * len(large):
        return False
    place = np.minimum(np.searchsorted(large, small_), len(large) - 1)
    both = int((large[place] == small_).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _blocks(rows: Column, shingles_: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_DOCS), F.ceil(shingles_ / BLOCK_SHINGLES)).cast("int")


def star_links(texts: DataFrame, stars: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): which of the pairs ``stars`` (a, b; each a once) are links. A text moves once as an ``a``; that of a ``b`` once for each block of its partners."""
    blocks = stars.groupBy("b").agg(_blocks(F.count("*"), F.lit(0)).alias("blocks"))
    text = texts.select("node", "text")
    outer = stars.join(blocks, "b").select("a", "b", F.pmod(F.xxhash64("a", F.lit(5)), F.col("blocks")).cast("int").alias("block"))
    outer = outer.join(text.withColumnRenamed("node", "a"), "a").select("b", "block", F.lit(1).alias("side"), F.col("a").alias("node"), "text")
    inner = blocks.join(text.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("b").alias("node"), "text")
    dealt = inner.union(outer).repartition("b", "block").sortWithinPartitions("b", "block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, []
        for batch in batches:
            sets, found = shingle_sets(batch.column("text")), []
            for i, (b, block, side, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "block", "side", "node")), strict=True)):
                if (b, block) != at:
                    at, centre = (b, block), []
                if not side:
                    centre.append(sets[i])
                elif any(_linked(sets[i], c, percent) for c in centre):
                    found.append((node, b))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(lambda batches: tidied(run(batches)), "a long, b long").distinct()


def block_links(texts: DataFrame, grouped: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect what ``grouped`` (node, grp, part, rest) leaves apart: nodes of the ``rest`` of a group with its nodes of other parts."""
    rows = grouped.join(texts, "node")
    rest = F.col("rest").cast("int")
    sizes = rows.groupBy("grp").agg(_blocks(F.sum(rest), F.sum(rest * F.col("n_shingles"))).alias("blocks"), F.ceil(F.count("*") / PASSING).cast("int").alias("passes"))
    rows = rows.join(sizes, "grp")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n)).cast("int")
    inner = rows.where("rest").withColumns({"block": own("blocks"), "side": F.lit(0)}).withColumn("pass", all_of("passes"))
    outer = rows.withColumns({"pass": own("passes"), "side": F.lit(1)}).withColumn("block", all_of("blocks"))
    columns = ["grp", "block", "pass", "side", "node", "part", "rest", "text", *_CHUNKS]
    dealt = inner.select(*columns).union(outer.select(*columns)).repartition("grp", "block", "pass").sortWithinPartitions("grp", "block", "pass", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, joined = None, None, Sets()
        for batch in batches:
            sets, found = shingle_sets(batch.column("text")), []
            sigs = np.stack([batch.column(c).to_numpy() for c in _CHUNKS], 1).view(np.uint8)
            for i, (*key, side, node, part, rest) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns[:7]), strict=True)):
                if key != at:
                    at, block, joined = key, ([], [], [], []), Sets()
                if not side:
                    for kept, value in zip(block, (node, part, sigs[i], sets[i]), strict=True):
                        kept.append(value)
                    continue
                if isinstance(block, tuple):  # it is complete
                    block = [np.array(block[0]), np.array(block[1]), np.stack(block[2]), block[3]]
                nodes, parts, others, own = block
                near = (parts != part) & ((others != sigs[i]).sum(1) <= FAR)
                if rest:  # the same pair comes the other way round too
                    near &= nodes < node
                for k in np.flatnonzero(near).tolist():
                    if joined.find(part) != joined.find(int(parts[k])) and _linked(sets[i], own[k], percent):
                        joined.join(part, int(parts[k]))
                        found.append((node, int(nodes[k])))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(lambda batches: tidied(run(batches)), "a long, b long")


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """``pairs`` whose nodes lie in different components of ``linked`` (node, component)."""
    of = lambda c: linked.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select(pairs.columns)


def _left_apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """node, grp, part, rest of the candidate groups that ``linked`` doesn't connect: ``rest`` is what lies outside a group's largest part."""
    groups = components(pairs, "neardup-groups").withColumnRenamed("component", "grp")
    placed = groups.join(linked, "node", "left").select("node", "grp", F.coalesce("component", "node").alias("part"))
    parts = placed.groupBy("grp", "part").agg(F.count("*").alias("n"))
    largest = parts.groupBy("grp").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(largest, "grp").select("node", "grp", "part", (F.col("part") != F.col("main")).alias("rest"))


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of all classes that are linked with another. ``classes``: node, t, n_shingles, chunks."""
    pairs = candidate_edges(classes)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    found = written(classes.join(small(nodes, MOST_BROADCAST), "node", "left_semi"), "neardup-candidates")
    own = small(found.select(F.col("node").alias("doc_id"), "t"), MOST_BROADCAST)
    texts = _texts(docs).join(own, ["doc_id", "t"], "left_semi").groupBy(F.col("doc_id").alias("node"), "t").agg(F.first("text").alias("text"))
    texts = written(texts.join(found, ["node", "t"]).drop("t"), "neardup-texts")
    told, linked, left = None, None, pairs
    for turn in range(ROUNDS):
        stars = written(left.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")), "neardup-stars")
        new = star_links(texts, stars, percent)
        told = written(new if told is None else told.union(new), "neardup-links")
        linked = components(told, "neardup-linked")
        if turn < ROUNDS - 1:
            left = written(_apart(left.join(stars, ["a", "b"], "left_anti"), linked), "neardup-left")
            if left.isEmpty():
                break
    rest = written(_left_apart(pairs, linked), "neardup-rest")
    if not rest.isEmpty():
        more = written(block_links(texts, rest, percent), "neardup-links")
        if not more.isEmpty():
            linked = components(written(told.union(more), "neardup-links"), "neardup-linked")
    dropped(pairs, found, texts, stars, told, rest)
    return linked


def placed_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_key, component_id of every row."""
    rows = written(signed(docs), "neardup-rows")
    least = F.min(F.struct("doc_id", "t")).alias("least")
    classes = rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_key").agg(least, F.first("n_shingles").alias("n_shingles"), *(F.first(c).alias(c) for c in _CHUNKS))
    classes = written(classes.select("set_key", F.col("least.doc_id").alias("node"), "least.t", "n_shingles", *_CHUNKS), "neardup-classes")
    linked = links(docs, classes.drop("set_key"), percent)
    known = classes.select("set_key", "node").join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left").select("doc_id", "n_shingles", "set_key", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (whether it is the row's own) of every row."""
    placed = placed_documents(docs, percent)
    return placed.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component the rows of its smallest doc_id, of equal ids and texts one."""
    gone = written(near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct(), "neardup-gone")
    left = packed(docs, doc_id=F.col("doc_id"), row=F.xxhash64("doc_id", "text")).join(gone, "doc_id", "left_anti")
    return left.dropDuplicates(["doc_id", "row"]).select(*unpacked(docs))
