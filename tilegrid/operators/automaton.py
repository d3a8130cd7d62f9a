"""The lexicon as a minimal acyclic word graph: words that end alike share their endings, and all that begin alike their beginnings.

A node is a mask of the letters that can follow (bit 26: a word ends here) and the place of its first edge; its edges lie in the order of
their letters, so an edge is found by counting the mask's bits below its letter. The graph is built in parts, one a task, by the words' first two
letters, which share no endings with each other; together they are sent to the workers as bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilegrid.sources.package import ship

#: Words of a lexicon that is sent to all workers: the places of its edges, 15 a word at most, have 32 bits. A graph takes 6 to 9 bytes a word as a rule (1.7 million words of documents).
MOST_WORDS = 200_000_000
LAST = np.uint32(1 << 26)


def minimal(words: Iterable[str]) -> tuple[list[int], list[int], list[int]]:
    """Masks, first edges and targets of the minimal graph of sorted different words of A-Z; the last node is the root."""
    masks, firsts, targets, known = [], [], [], {}
    path, before = [[0, []]], ""  # mask and targets of the nodes of the last word, none of them in the graph yet

    def closed(upto: int) -> None:
        while len(path) > upto:
            mask, to = path.pop()
            key = (mask, *to)
            if key not in known:
                known[key] = len(masks)
                masks.append(mask)
                firsts.append(len(targets))
                targets.extend(to)
            if path:
                path[-1][1].append(known[key])

    for word in words:
        same = 0
        while same < len(before) and same < len(word) and before[same] == word[same]:
            same += 1
        closed(same + 1)
        for letter in word[same:]:
            path[-1][0] |= 1 << ord(letter) - 65
            path.append([0, []])
        path[-1][0] |= 1 << 26
        before = word
    closed(0)
    return masks, firsts, targets


class Graph:
    """A word graph, walked by arrays of nodes and letters."""

    def __init__(self, packed: bytes):
        nodes = int.from_bytes(packed[:8], "little")
        self.masks, self.firsts = (np.frombuffer(packed, np.uint32, nodes, 8 + 4 * nodes * k) for k in (0, 1))
        self.targets = np.frombuffer(packed, np.uint32, -1, 8 + 8 * nodes)
        self.root = nodes - 1

    @staticmethod
    def packed(words: Iterable[str]) -> bytes:
        arrays = [np.array(part, np.uint32) for part in minimal(words)]
        return len(arrays[0]).to_bytes(8, "little") + b"".join(a.tobytes() for a in arrays)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have an edge for their letter, and where those lead."""
        mask, bit = self.masks[nodes], np.uint32(1) << letters.astype(np.uint32)
        has = np.flatnonzero(mask & bit)
        return has, self.targets[self.firsts[nodes[has]] + np.bitwise_count(mask[has] & (bit[has] - np.uint32(1)))]

    def edges(self, node: int) -> list[tuple[int, int]]:
        """Letters and targets of a node's edges."""
        letters = [k for k in range(26) if int(self.masks[node]) >> k & 1]
        return [(k, int(self.targets[int(self.firsts[node]) + i])) for i, k in enumerate(letters)]

    def ends(self, nodes: np.ndarray) -> np.ndarray:
        """Which nodes end a word."""
        return self.masks[nodes] & LAST != 0

    def words(self) -> Iterator[str]:
        """All words, in order."""
        todo = [("", self.root)]
        while todo:
            text, node = todo.pop()
            if int(self.masks[node]) >> 26:
                yield text
            todo += [(text + chr(65 + k), to) for k, to in reversed(self.edges(node))]


def merged(parts: Iterable[bytes]) -> bytes:
    """Packed graphs as one, if all words with the same first two letters are in the same of them: only the root and its children are made anew."""
    masks, firsts, targets, tops, nodes, edges = [], [], [], {}, 0, 0
    for graph in map(Graph, parts):
        masks.append(graph.masks)
        firsts.append(graph.firsts + np.uint32(edges))
        targets.append(graph.targets + np.uint32(nodes))
        for first, child in graph.edges(graph.root):
            mask, below = tops.get(first, (0, []))
            tops[first] = mask | int(graph.masks[child] & LAST), below + [(second, to + nodes) for second, to in graph.edges(child)]
        nodes, edges = nodes + len(graph.masks), edges + len(graph.targets)
    made = [tops[k] for k in sorted(tops)]
    made.append((0, [(k, nodes + i) for i, k in enumerate(sorted(tops))]))
    for mask, below in made:
        masks.append(np.array([mask | sum(1 << k for k, _ in below)], np.uint32))
        firsts.append(np.array([edges], np.uint32))
        targets.append(np.array([to for _, to in sorted(below)], np.uint32))
        edges += len(below)
    return (nodes + len(made)).to_bytes(8, "little") + b"".join(a.tobytes() for a in (*masks, *firsts, *targets))


def broadcast_graph(lexicon: DataFrame) -> Broadcast | None:
    """The graph of a lexicon (word), as bytes on all workers; None if the lexicon has more than ``MOST_WORDS`` words. The lexicon is read once.

    Words are dealt by their first two letters and put in order by Spark; each task makes the graph of its share as it reads it.
    """
    spark = lexicon.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0

        def words() -> Iterator[str]:
            nonlocal count
            before = None
            for batch in batches:
                for word in batch.column("word").to_pylist():
                    if word != before:
                        count, before = count + 1, word
                        if count > MOST_WORDS:
                            return
                        yield word

        packed = Graph.packed(words())
        yield pa.RecordBatch.from_arrays([pa.array([packed if count <= MOST_WORDS else None], pa.binary()), pa.array([count], pa.int64())], ["graph", "n"])

    shares = lexicon.select("word").where("word RLIKE '^[A-Z]+$'").repartition(spark.sparkContext.defaultParallelism, F.left("word", F.lit(2))).sortWithinPartitions("word")
    rows = shares.mapInArrow(run, "graph binary, n bigint").collect()  # a row a task
    return spark.sparkContext.broadcast(merged(bytes(r.graph) for r in rows)) if sum(r.n for r in rows) <= MOST_WORDS else None
