"""Words that share polynomial hashes, and very long texts: equal results piece by piece, in bounded memory."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tilegrid.llm import features, kernels, neardup, token_counts, token_files
from tilegrid.llm.neardup import near_duplicates, shingle_sets, signatures
from tilegrid.llm.queries import vocabulary
from tilegrid.llm.token_files import Encoder

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.tiktoken")


def twins(levels):
    """A word of ``2**levels`` letters and its letter swap: all polynomials modulo 2**64 with odd bases agree on them from 11 levels on."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("levels", [6, 11])
def test_long_words_that_a_polynomial_confuses(spark, levels):
    a, b = twins(levels)
    tokenizer = Tokenizer.from_file(WORDS)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (a, b, f"x {a} {b}")]
    own = Encoder(WORDS)
    assert own.ids(pa.array([a, b, f"x {a} {b}"])) == want == [own.ids(pa.array([t]))[0] for t in (a, b, f"x {a} {b}")]
    rows = near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 1}
    one, two = features.gram_features(pa.array([a, b]))
    assert set(one) != set(two)


def test_words_of_one_hash_go_to_the_tokenizer(monkeypatch):
    monkeypatch.setattr(kernels.Words, "hashes", lambda self, *spans: np.zeros(len(self.starts), np.uint64))
    texts = ["one two three", "three two one four", "one"]
    tokenizer = Tokenizer.from_file(WORDS)
    assert Encoder(WORDS).ids(pa.array(texts)) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def _results(texts, count):
    column = pa.array(texts, pa.string())
    encoder = Encoder(WORDS)
    sets = shingle_sets(column)
    return (
        [s.tolist() for s in sets], signatures(sets).tolist(), [[x.tolist() for x in w] for w in features.word_counts(column)], [g.tolist() for g in features.gram_features(column)],
        encoder.ids(column), [count(t) for t in texts],
    )


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice(["word", "Word", "the", "é", "ü", "a.b", "x" * 40, "x" * 300, "l1", "l1 l1 l1"]) + rng.choice([" ", "  ", "\n", "\t \r", ". "]) for _ in range(n))
    texts = ["", "   ", made(3), made(400), "y" * 1000, "  " + "z" * 500 + " end " + made(50), "é" * 700, made(900).replace(" ", "")]
    automaton = token_counts.counter(BYTES)

    def count(text):
        return [sum(automaton[w] for p in kernels.pieces(np.frombuffer(text.encode(), np.uint8)) for w in p.tobytes().split())]

    plain = _results(texts, count)
    for size in (64, 257):
        for module in (kernels, features, neardup, token_files):
            monkeypatch.setattr(module, "PIECE", size)
        assert _results(texts, count) == plain
        for t in texts:
            cut = list(kernels.pieces(np.frombuffer(t.encode(), np.uint8)))
            assert b"".join(p.tobytes() for p in cut) == t.encode() and [w for p in cut for w in p.tobytes().split()] == t.encode().split()


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
from tilegrid.llm import crc, features, fingerprints, kernels, linededup, neardup, token_files
from tilegrid.llm.queries import vocabulary
rng = np.random.default_rng(1)
words = np.array([f"w{i}" for i in range(30_000)])
part = " ".join(rng.choice(words, 1_000_000))
column = pa.array([(part + "\\n") * (100_000_000 // len(part))])
del part
did = {"op2": lambda: features.gram_features(column), "op5": lambda: neardup.signatures(neardup.shingle_sets(column)), "op6": lambda: list(features.word_counts(column)), "op9": lambda: token_files.Encoder(vocabulary("word_bpe_49k.json")).ids(column), "op4": lambda: [len(linededup.line_keys(p, linededup.ALLOWED, set())[0]) for p in linededup.line_pieces(t.as_py() for t in column)], "op11": lambda: [len(c) for c, *_ in crc.run_crcs(column, 2)], "op12": lambda: fingerprints.simhashes(*kernels.texts_of(column))}[sys.argv[1]]()
print(column.nbytes / 1e6, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3)
"""


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op9", "op11", "op12"])
def test_a_text_of_100_mb_takes_under_1_gb(name):
    root = str(Path(__file__).resolve().parent.parent.parent)
    out = subprocess.run([sys.executable, "-c", MEMORY, name], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    size, peak = map(float, out.stdout.split())
    assert size > 95 and peak < 1000, peak
