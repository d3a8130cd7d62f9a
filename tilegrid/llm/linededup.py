"""Operator 4: line dedup by a segment-partition edit join.

Lines are linked if they differ by no more insertions, deletions and substitutions than the shorter one's length allows (``ALLOWED``, a
parameter): two from 32 characters on, one from 16 on. Shorter lines are linked only if they are equal, since one edit makes another word
of them. A line is split into one segment more than the edits allowed; by pigeonhole a linked line holds one of them unchanged, near the
same place. So each line's segments are indexed by its length, and each line probes, for every length that it could be linked
with, the few substrings whose place allows a link (the multi-match-aware choice of Pass-Join, Li et al. 2011). Keys that
no other line shares are dropped before any text moves; keys that a sample of the documents shows to be frequent are salted, so that no
task holds all lines of one. Lines that share a key are compared by a banded bit-parallel edit distance (after Hyyro, 2003), many pairs at
a time, in blocks of bounded size; only a forest of links leaves a task. A key that n different lines share costs their n^2 / 2 pairs.

Equal lines are one from the start (by 64 bits of hash, and 96 where lines are removed), so a very frequent line costs one line
a task. Linked lines form a class; its first line, in the order of doc_id and place, stays.

Defined cases: null and empty texts have no lines; lines without a word are neither counted nor removed; rows with a null doc_id
come first; equal rows count as one document, in which a line may stay; an empty table gives an empty result; further columns
are ignored by ``line_counts`` and stay in ``drop_repeated_lines``. Texts of any length are keyed in pieces of about a million
characters cut at line ends; a longer line is a piece of its own, of which only the few substrings that it is looked up by are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilegrid.llm.graph import Sets, components
from tilegrid.llm.kernels import PIECE, U64, _powers, mix, tidied
from tilegrid.llm.shared import SPACE, bound_batches, dropped, packed, small, written

#: (characters, edits): from so many characters on so many edits are allowed, in ascending order.
ALLOWED = ((16, 1), (32, 2))
#: Lines of a block; lines that a task remembers having told; and linked candidates up to which a broadcast is allowed (16 bytes each).
BLOCK, REMEMBERED, MOST_BROADCAST = 1024, 200_000, 2_000_000
#: Characters from which two lines are compared by themselves, along diagonals.
LONG = 1 << 13
#: Lines of a small group, and pairs that wait to be compared at once.
FEW, WAITING = 8, 2048
#: Documents, about, that tell which keys are frequent; lines among them that make a key frequent; and parts that it is salted into.
SAMPLE, FREQUENT, SALTS = 4_000, 32, 64
_GAPS = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def segments(size: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of ``edits + 1`` segments of lines of these sizes; the later ones are longer by one where sizes don't divide."""
    n = edits + 1
    base, more = size // n, size % n
    return [(i * base + np.maximum(0, i - (n - more)), base + (i >= n - more)) for i in range(n)]


def probes(edits: int) -> Iterator[tuple[int, int, int]]:
    """(shorter by, segment, shift): which substrings of a line to look up for lines that are shorter by so much."""
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                yield less, i, shift


def allowance(size: np.ndarray, allowed: tuple) -> np.ndarray:
    """The edits that lines of these sizes allow."""
    steps = np.array([0, *(e for _, e in allowed)])
    return steps[np.searchsorted([n for n, _ in allowed], size, "right")]


def line_pieces(texts: Iterator[str]) -> Iterator[str]:
    """All lines of some texts, in pieces of about ``PIECE`` characters that cut no line; a line longer than that is a piece of its own."""
    held, size = [], 0
    for text in texts:
        at = 0
        while at <= len(text):
            stop = len(text)
            if stop - at > PIECE:
                stop = text.rfind("\n", at, at + PIECE)
                if stop < 0:  # a long line
                    end = text.find("\n", at + PIECE)
                    stop = len(text) if end < 0 else end
                    if held:
                        yield "\n".join(held)
                        held, size = [], 0
                    yield text[at:stop]
                    at = stop + 1
                    continue
            held.append(text[at:stop])
            size += stop - at + 1
            at = stop + 1
            if size >= PIECE:
                yield "\n".join(held)
                held, size = [], 0
    if held:
        yield "\n".join(held)


def _node(line: bytes) -> int:
    h = xxhash.xxh64_intdigest(line, 42)
    return h - (1 << 64) if h >> 63 else h


def long_line_keys(line: str, allowed: tuple) -> tuple[np.ndarray, np.ndarray]:
    """As ``line_keys``, of one line of any length over ``PIECE``: each of its few substrings is hashed by itself, without sums over the line."""
    node, edits = _node(line.encode()), allowed[-1][1]
    keys, owners = [], []
    for less, i, shift in probes(edits):
        size = len(line) - less
        place, length = (int(x[0]) for x in segments(np.array([size]), edits)[i])
        part = line[place + shift : place + shift + length]
        if size > PIECE:
            h = xxhash.xxh3_64_intdigest(part.encode())
        else:  # as in the lines of up to a piece that it could be linked with
            codes = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)
            h = int((mix(codes + U64(0x9E3779B97F4A7C15)) * _powers(length)[0][:length]).sum(dtype=U64))
        keys.append((h + (size * 16 + i) * 0xD6E8FEB86659FD93) & (1 << 64) - 1)
        owners.append(node & ~1 | (less == 0 and shift == 0))
    return mix(np.array(keys, U64)).view(np.int64), np.array(owners)


def line_keys(whole: str, allowed: tuple, told: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of the lines of a text: node is the line's hash with its last bit telling an indexed segment (1) from a probe (0)."""
    if len(whole) > PIECE and "\n" not in whole:
        return long_line_keys(whole, allowed)
    raw = whole.encode()
    chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    breaks = np.flatnonzero(chars == 10)
    begin, end = np.concatenate((np.zeros(1, np.int64), breaks + 1)), np.concatenate((breaks, [len(chars)]))
    at, nodes = 0, np.zeros(len(begin), np.int64)
    size = end - begin
    keep = allowance(size, allowed) > 0
    for i, line in enumerate(raw.split(b"\n")):
        if keep[i]:
            h = xxhash.xxh64_intdigest(line, 42)
            if h in told:
                keep[i] = False
            elif len(told) < REMEMBERED:
                told.add(h)
            nodes[i] = h - (1 << 64) if h >> 63 else h
    begin, size, nodes = begin[keep], size[keep], nodes[keep]
    power, inverse = _powers(len(chars))
    sums = np.zeros(len(chars) + 1, U64)
    np.cumsum(mix(chars.astype(np.uint64) + U64(0x9E3779B97F4A7C15)) * power[: len(chars)], out=sums[1:])
    keys, owners = [], []
    for edits, (less, i, shift) in ((e, p) for _, e in allowed for p in probes(e)):
        place, length = segments(size - less, edits)[i]
        a = begin + place + shift
        fits = (place + shift >= 0) & (place + shift + length <= size) & (allowance(size - less, allowed) == edits)
        a, b, tag = a[fits], (a + length)[fits], ((size - less)[fits] * 16 + i).astype(np.uint64)
        keys.append(mix((sums[b] - sums[a]) * inverse[a] + tag * U64(0xD6E8FEB86659FD93)))
        owners.append(nodes[fits] & ~1 | (less == 0 and shift == 0))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def distances(a: list[np.ndarray], b: list[np.ndarray], edits: int) -> np.ndarray:
    """For each pair of code-point arrays the edit distance if it is at most ``edits``, else more than that. Sizes differ by ``edits`` at most and are larger.

    One machine word holds, for each pair, the vertical differences in the band of ``2 * edits + 1`` rows around the diagonal; the
    band moves down by a row with each column.
    """
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    band, pairs = 2 * edits + 1, len(a)
    left = np.full((m.max() + n.max() + 2 * band, pairs), 0xFFFFFFFF, np.uint32)
    right = np.full((n.max(), pairs), 0xFFFFFFFE, np.uint32)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        left[edits : edits + len(x), k] = x
        right[: len(y), k] = y
    all_rows, top = (1 << band) - 1, 1 << (band - 1)
    plus = np.full(pairs, all_rows & ~((1 << edits) - 1), np.int64)
    minus = np.zeros(pairs, np.int64)
    distance = np.full(pairs, edits, np.int64)
    for column in range(n.max()):
        same = np.zeros(pairs, np.int64)
        for k in range(band):
            same |= (left[column + k] == right[column]).astype(np.int64) << k
        zero = ((((same & plus) + plus) ^ plus) | same | minus) & all_rows
        rise, fall = (minus | ~(zero | plus)) & all_rows, zero & plus
        row = m - column - 1 + edits  # of the last row, in the band
        going = column < n
        on_edge = row >= band - 1
        bit = np.left_shift(1, np.clip(row, 0, band - 1))
        step = np.where(on_edge, (zero & top) == 0, ((rise & bit) != 0).astype(np.int64) - ((fall & bit) != 0))
        distance += np.where(going, step, 0)
        down = zero >> 1
        plus, minus = (fall | ~(down | rise)) & all_rows, down & rise
        # The row that enters the band at its lower edge counts as one more than the row above it.
        plus |= top
        minus &= ~top
    return distance


def far_apart(x: np.ndarray, y: np.ndarray, edits: int) -> int:
    """The edit distance of two long lines if it is at most ``edits``, else one more: how far each diagonal reaches with so many edits (Ukkonen, 1985)."""

    def same(i: int, j: int) -> int:
        """How many characters are equal from there on."""
        n, step = 0, 1 << 16
        while True:
            a, b = x[i + n : i + n + step], y[j + n : j + n + step]
            size = min(len(a), len(b))
            other = np.flatnonzero(a[:size] != b[:size])
            if len(other) or not size:
                return n + (int(other[0]) if len(other) else 0)
            n += size

    reach: dict[int, int] = {}  # by how far y is ahead: the place in x
    for done in range(edits + 1):
        new = {}
        for ahead in range(-done, done + 1):
            i = max(reach[ahead] + 1 if ahead in reach else -1, reach[ahead + 1] + 1 if ahead + 1 in reach else -1, reach.get(ahead - 1, -1)) if done else 0
            i = min(i, len(x), len(y) - ahead)
            if i >= 0 and i + ahead >= 0:
                new[ahead] = i + same(i, i + ahead)
                if new[ahead] == len(x) and new[ahead] + ahead == len(y):
                    return done
        reach = new
    return edits + 1


class _Links:
    """Collects the links between lines that share a key. Pairs of small groups wait until there are many to compare at once."""

    def __init__(self, allowed: tuple):
        self.allowed, self.most, self.waiting, self.seen, self.found = allowed, allowed[-1][1], [], set(), []

    def group(self, nodes: list[int], indexed: list[int], side: list[int], lines: list[str]) -> None:
        """One block of lines, or two (``side`` 0 and 1), between which alone links are sought."""
        codes = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in lines]
        bins = [np.bincount(x & 63, minlength=64).astype(np.int32) for x in codes]
        edits = allowance(np.array([len(x) for x in codes]), self.allowed)
        (self._few if len(nodes) <= FEW else self._many)(nodes, indexed, side, codes, bins, edits)

    def _few(self, nodes, indexed, side, codes, bins, edits) -> None:
        """All pairs wait to be compared."""
        two, edits = len(set(side)) == 2, edits.tolist()
        for i in range(len(nodes)):
            for j in range(i):
                most = min(edits[i], edits[j])
                fits = (indexed[i] or indexed[j]) and (not two or side[i] != side[j]) and abs(len(codes[i]) - len(codes[j])) <= most and nodes[i] != nodes[j]
                pair = (nodes[i], nodes[j]) if nodes[i] < nodes[j] else (nodes[j], nodes[i])
                if fits and pair not in self.seen and np.abs(bins[i] - bins[j]).sum() <= 2 * most:
                    if len(self.seen) < REMEMBERED:
                        self.seen.add(pair)
                    if max(len(codes[i]), len(codes[j])) > LONG:
                        self.found += [pair] * (far_apart(codes[i], codes[j], most) <= most)
                    else:
                        self.waiting.append((pair, codes[i], codes[j], most))
        if len(self.waiting) >= WAITING:
            self.flush()

    def flush(self) -> None:
        self.waiting.sort(key=lambda w: len(w[1]))
        for a in range(0, len(self.waiting), 256):
            part = self.waiting[a : a + 256]
            far = distances([w[1] for w in part], [w[2] for w in part], self.most)
            self.found += [w[0] for w, d in zip(part, far.tolist(), strict=True) if d <= w[3]]
        self.waiting.clear()

    def _many(self, nodes, indexed, side, codes, bins, edits) -> None:
        """A forest of the links: what is connected already isn't compared."""
        size, ids, sides, counts = np.array([len(x) for x in codes]), np.array(nodes), np.array(side), np.stack(bins)
        two, joined = bool(sides.any() and not sides.all()), Sets()
        for x in np.flatnonzero(np.array(indexed)).tolist():
            most = np.minimum(edits, edits[x])
            fits = (np.abs(size - size[x]) <= most) & (ids != ids[x])
            if two:
                fits &= sides != sides[x]
            others = np.flatnonzero(fits)
            others = others[np.abs(counts[others] - counts[x]).sum(1) <= 2 * most[others]]
            root = joined.find(x)
            others = [y for y in others.tolist() if joined.find(y) != root]
            for a in range(0, len(others), 256):
                part = np.array(others[a : a + 256])
                if size[x] + self.most > LONG:
                    far = np.array([far_apart(codes[x], codes[y], self.most) for y in part])
                else:
                    far = distances([codes[x]] * len(part), [codes[y] for y in part], self.most)
                for y in part[far <= most[part]].tolist():
                    if joined.join(x, y):
                        self.found.append((int(ids[x]), int(ids[y])))


def _lines(docs: DataFrame, *more: Column) -> DataFrame:
    """``more``, place and line of every line with a word, and its hash ``node``."""
    rows = docs.where(F.length("text") > 0).select(*more, F.split("text", "\n").alias("_lines"))
    rows = rows.select(*(F.col(c) for c in rows.columns if c != "_lines"), F.posexplode("_lines").alias("place", "line"))
    return rows.where(F.col("line").rlike(f"[^{SPACE}]")).withColumn("node", F.xxhash64("line"))


def _keyed(docs: DataFrame, allowed: tuple) -> DataFrame:
    """(key, node) of all lines long enough, with few repetitions of equal lines."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for whole in line_pieces(text.as_py() for batch in batches for text in batch.column("text") if text.is_valid):
            key, node = line_keys(whole, allowed, told)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])

    return docs.select("text").mapInArrow(lambda batches: tidied(run(batches)), "key long, node long")


def frequent_keys(docs: DataFrame, allowed: tuple = ALLOWED) -> DataFrame:
    """Keys that many different lines of a sample share. They only decide how rows are dealt to tasks, never what is compared."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    line = F.shiftrightunsigned("node", 1)
    counted = _keyed(docs.sample(share, 7), allowed).groupBy("key", line.alias("half")).agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"))
    return written(counted.where(F.col("n") >= FREQUENT).select("key", F.lit(True).alias("hot")), "line-frequent")


def shared_keys(docs: DataFrame, allowed: tuple = ALLOWED) -> DataFrame:
    """(key, half, indexed) of lines that share a key with another line; ``half`` is a node without its last bit."""
    hot = small(frequent_keys(docs, allowed), MOST_BROADCAST)
    line = F.shiftrightunsigned("node", 1)
    rows = _keyed(docs, allowed).join(hot, "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(line), F.lit(SALTS))).otherwise(0).cast("int"))
    own, order = Window.partitionBy("key", "salt"), Window.partitionBy("key", "salt").orderBy("node")
    rows = rows.withColumns({"low": F.min(line).over(own), "high": F.max(line).over(own), "any": F.max(F.col("node").bitwiseAND(1)).over(own), "last": F.lag("node").over(order)})
    shared = F.col("hot").isNotNull() | ((F.col("low") < F.col("high")) & (F.col("any") == 1))
    rows = rows.where(shared & (F.col("last").isNull() | (F.col("last") != F.col("node"))))
    return rows.groupBy("key", line.alias("half")).agg(F.max(F.col("node").bitwiseAND(1)).alias("indexed"))


def confirmed_edges(docs: DataFrame, keys: DataFrame, allowed: tuple = ALLOWED) -> DataFrame:
    """(a, b): links between nodes, enough to connect each class. ``keys`` of ``shared_keys``."""
    halves = keys.select("half").distinct()
    texts = _lines(docs).select("node", "line").withColumn("half", F.shiftrightunsigned("node", 1)).join(small(halves, MOST_BROADCAST), "half", "left_semi")
    texts = texts.where(F.length("line") >= allowed[0][0]).groupBy("half", "node").agg(F.first("line").alias("line"))
    blocks = keys.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n"), F.max("indexed").alias("any")).where("n > 1 AND any = 1").drop("n", "any")
    rows = keys.join(blocks, "key").join(texts, "half").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "indexed", "line")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, links = None, [], _Links(allowed)

        def close() -> None:
            if len(held) > 1:
                links.group(*(list(z) for z in zip(*held, strict=True)))
            held.clear()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([e[i] for e in links.found], pa.int64()) for i in (0, 1)], ["a", "b"])
            links.found.clear()
            return out

        for batch in batches:
            for key, x, y, side, node, indexed, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, x, y) != open_key:
                    close()
                    open_key = (key, x, y)
                held.append((node, indexed, side, line))
            yield told()
        close()
        links.flush()
        yield told()

    return dealt.mapInArrow(lambda batches: tidied(run(batches)), "a long, b long")


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def classified_lines(docs: DataFrame, allowed: tuple = ALLOWED) -> DataFrame:
    """row, doc_id, place, class, check of every line with a word. ``row`` is the hash of doc_id and text; ``class`` the smallest hash of a line
    of its class, with ``check``, another hash, where the line is linked with no other."""
    keys = written(shared_keys(docs, allowed), "line-keys")
    edges = written(confirmed_edges(docs, keys, allowed), "line-edges")
    classes = components(edges, "line-links")
    dropped(keys)
    rows = _lines(docs, _row().alias("row"), F.col("doc_id")).select("row", "doc_id", "place", "node", F.hash("line").alias("check"))
    rows = rows.join(classes, "node", "left")
    own = rows.select("row", "doc_id", "place", F.coalesce("component", "node").alias("class"), F.when(F.col("component").isNull(), F.col("check")).alias("check"))
    return written(own, "line-classes")


def first_lines(lines: DataFrame) -> DataFrame:
    """(row, place): the lines that stay, one of each class."""
    return lines.groupBy("class", "check").agg(F.min(F.struct("doc_id", "place", "row")).alias("first")).select("first.row", "first.place")


def line_counts(docs: DataFrame, allowed: tuple = ALLOWED) -> DataFrame:
    """doc_id, n_lines (with a word), n_kept, n_removed, line_classes (the class of each of these lines, in order) of every row."""
    lines = classified_lines(docs, allowed)
    kept = first_lines(lines).groupBy("row").agg(F.count("*").alias("n_kept"))
    own = lines.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("place", "class"))).alias("c"))
    rows = docs.select("doc_id", _row().alias("row")).join(own, "row", "left").join(kept, "row", "left")
    n, k = F.when(F.col("c").isNull(), 0).otherwise(F.size("c")).cast("long"), F.coalesce("n_kept", F.lit(0))
    return rows.select("doc_id", n.alias("n_lines"), k.alias("n_kept"), (n - k).alias("n_removed"), F.coalesce(F.transform("c", lambda x: x["class"]), F.array().cast("array<long>")).alias("line_classes"))


def drop_repeated_lines(docs: DataFrame, allowed: tuple = ALLOWED) -> DataFrame:
    """``docs`` with the lines that don't stay cut from ``text``; other columns stay as they are."""
    kept = first_lines(classified_lines(docs, allowed)).groupBy("row").agg(F.collect_list("place").alias("kept"))
    rows = packed(docs, row=_row()).join(kept, "row", "left")
    stays = lambda x, i: ~x.rlike(f"[^{SPACE}]") | F.coalesce(F.array_contains("kept", i), F.lit(False))
    text = F.when(F.col("doc.text").isNotNull(), F.array_join(F.filter(F.split("doc.text", "\n"), stays), "\n"))
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))
