"""Token counts against greedy cutting, and token files against the tokenizer and the format."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from tilegrid.llm.queries import vocabulary
from tilegrid.llm.token_counts import Automaton, read_vocabulary, token_counts
from tilegrid.llm.token_files import Encoder, Reader, read_token_files, token_files, write_token_files

WORDS = vocabulary("word_bpe_49k.json")


def greedy(pieces, data):
    n, i = 0, 0
    while i < len(data):
        i = next(j for j in range(len(data), i, -1) if data[i:j] in pieces)
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.binary(max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_automaton_is_greedy(more, data):
    pieces = {bytes([b]) for b in range(256)} | set(more)
    assert Automaton(pieces).count(data) == greedy(pieces, data)


def test_automaton_needs_all_bytes():
    with pytest.raises(ValueError):
        Automaton([b"a", b"ab"])


def test_counts_of_documents(spark):
    path = vocabulary("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces, seen = set(read_vocabulary(path)), {}
    longest = max(map(len, pieces))

    def cut(word):
        n = i = 0
        while i < len(word):
            i = next(j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in pieces)
            n += 1
        return n

    for r in token_counts(docs, path).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = r.text.encode().split()
        want = sum(seen[w] if w in seen else seen.setdefault(w, cut(b" " + w)) for w in words)
        assert (r.n_words, r.n_tokens, r.n_bytes) == (len(words), want, len(r.text.encode()))


TEXTS = [
    "", " ", "Hello, World.", "it's Can't WE'LL", "a<|endoftext|>b", "<|STARTOFTEXT|> x", "É é straße STRASSE ΣΑΣ İi", "x.. y., z,. 3.14 w3b", "tab\tvt\x0bff\x0ccr\rnl\n end", "漢字 かな \U0001f600\U0001f44d", " nbsp em",
    "a" * 5000, "ﬁ ﬀ Å̊", "\x00\x01 \x1c\x1d", "...,,,", ".", "Ünïcödé. Ñandú, ø",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_tokenizer(name):
    path = vocabulary(name)
    whole, own = Tokenizer.from_file(path), Encoder(path)
    assert own.plain == (name == "word_bpe_49k.json")
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(TEXTS) for _ in range(6)) for _ in range(60)]
    for group in ([t] for t in texts), [[t for t in texts if "<|" not in t]], [texts]:
        for batch in group:
            want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(batch, add_special_tokens=False)]
            assert own.ids(pa.array(batch, pa.string())) == want


def test_round_trip_and_random_access(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = f"file://{tmp_path}/ids"
    files = write_token_files(docs, WORDS, folder, docs_a_file=30)
    back = sorted(read_token_files(files, folder).collect())
    whole, start = Tokenizer.from_file(WORDS), 0
    texts = dict(docs.select("doc_id", "text").collect())
    assert [r.doc_id for r in back] == sorted(texts)
    for r in back:
        ids = np.array([*whole.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    paths = [r.path for r in files.orderBy("part").collect()]
    assert len(paths) > 3
    with fs.LocalFileSystem().open_input_file(paths[1]) as f:
        reader = Reader(f)
        assert reader.doc_ids == sorted(reader.doc_ids)
        ids = np.frombuffer(reader.read(len(reader) - 1), "<u4").tolist()
        assert ids == [*whole.encode(texts[reader.doc_ids[-1]], add_special_tokens=False).ids, 1]
        at = int(reader.at[2]) + 12
    raw = bytearray(open(paths[1], "rb").read())
    raw[at] ^= 0xFF
    open(paths[1], "wb").write(raw)
    with fs.LocalFileSystem().open_input_file(paths[1]) as f, pytest.raises(Exception):  # noqa: B017  the frame or its checksum is damaged
        Reader(f).read(2)
    with fs.LocalFileSystem().open_input_file(paths[1]) as f:
        assert Reader(f).read(3)  # others still read


def test_ties_and_nulls_are_in_order(spark):
    rows = [(2, "b"), (None, "n"), (1, "a"), (2, "b"), (2, "c d e"), (1, None)]
    got = token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 2, 2] and sum(r.n_tokens for r in got) == 2 + 1 + 2 + 2 + 2 + 4


def test_an_id_that_repeats_is_divided_among_files(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(120)] + [(i, "t") for i in range(30)] + [(None, f"none {i}") for i in range(40)]
    folder = f"file://{tmp_path}/ids"
    files = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), WORDS, folder, docs_a_file=20)
    sizes = [r.n_docs for r in files.orderBy("part").collect()]
    assert sum(sizes) == 190 and max(sizes) < 60 and len(sizes) >= 8
    got = read_token_files(files, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    tokenizer = Tokenizer.from_file(WORDS)
    want = [zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for _, t in rows]
    assert sorted(r.ids_crc32 for r in got) == sorted(want)
