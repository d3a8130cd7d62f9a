"""Operator 1: token counts by a linear longest-match automaton.

Each word, led by one space, is cut greedily into the longest pieces of a vocabulary. The trie of the vocabulary carries for each
node a failure link and the number of tokens that following it pops, so a word's count comes from one pass over its bytes: no
backing up and no pieces built (after Song et al., "Fast WordPiece Tokenization", 2021). Counts of short words are remembered in a
table of bounded size.

Defined cases: null and empty texts have 0 tokens; all bytes are in the vocabulary, so every text can be counted, whatever its
length; repeated rows count each by itself; rows with a null doc_id are counted too; further columns are ignored;
doc_id must be a whole number (cast to long).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilegrid.llm.kernels import pieces
from tilegrid.llm.shared import bound_batches

#: Words remembered at most, and the longest word remembered.
REMEMBERED, LONGEST = 300_000, 48


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a tiktoken file: base64 and a rank a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """``count(data)``: how many pieces greedy longest match cuts ``data`` into. Every single byte must be a piece."""

    def __init__(self, pieces: Iterable[bytes]):
        step: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                nxt = step[at].get(byte)
                if nxt is None:
                    nxt = step[at][byte] = len(step)
                    step.append({})
                    ends.append(False)
                at = nxt
            ends[at] = at > 0
        if any(not ends[step[0].get(b, 0)] for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        # Breadth first: a node's link depends on shallower nodes only. From a node that ends a piece, one token pops and the rest starts anew.
        link, pops, level = [0] * len(step), [0] * len(step), [0]
        while level:
            deeper = []
            for parent in level:
                for byte, node in step[parent].items():
                    deeper.append(node)
                    if ends[node]:
                        pops[node] = 1
                        continue
                    back, n = link[parent], pops[parent]
                    while byte not in step[back]:
                        n += pops[back]
                        back = link[back]
                    link[node], pops[node] = step[back][byte], n
            level = deeper
        self.step, self.link, self.pops = step, link, pops

    def count(self, data: bytes) -> int:
        step, link, pops = self.step, self.link, self.pops
        at = n = 0
        for byte in data:
            nxt = step[at].get(byte)
            while nxt is None:
                n += pops[at]
                at = link[at]
                nxt = step[at].get(byte)
            at = nxt
        while at:
            n += pops[at]
            at = link[at]
        return n


class _Counts(dict):
    """Token counts of words, counted when first asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@lru_cache(2)
def counter(vocabulary: str) -> _Counts:
    """One for each worker process, so that the trie serves all its tasks."""
    return _Counts(Automaton(read_vocabulary(vocabulary)))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens (long) of every row. ``vocabulary``: path of a tiktoken file, which executors have too."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            look, rows = counter(vocabulary).__getitem__, []
            for text in batch.column("text").cast(pa.binary() if pa.types.is_string(batch.schema.field("text").type) else pa.large_binary()).to_pylist():
                n_words = n_tokens = 0
                for piece in pieces(np.frombuffer(text or b"", np.uint8)):
                    split = piece.tobytes().split()
                    n_words, n_tokens = n_words + len(split), n_tokens + sum(map(look, split))
                rows.append((len(text or b""), n_words, n_tokens))
            made = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(made[:, i]) for i in range(3))], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
