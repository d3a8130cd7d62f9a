"""The operators that run in the JVM alone, on a text of 5 MB among short ones: equal to plain Python over all of it."""

import random
from collections import Counter

import pytest

from tilegrid.llm.decontam import contamination
from tilegrid.llm.licenses import license_scan
from tilegrid.llm.mixing import Mix, mixed
from tilegrid.llm.quality_rules import quality_rules

PASSAGE = "fifteen words of a passage that stands at the very end of one long text"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + rng.choice(["", "", "", "#", "<b>", "é"]) for _ in range(rng.randint(1, 30))) for _ in range(60_000)]
    lines += rng.choices(lines, k=500)
    text = "\n".join([*lines[:30_000], "Released under the MIT License.", *lines[30_000:], PASSAGE])
    assert len(text.encode()) > 5_000_000
    return spark.createDataFrame([(1, text, "en", "s"), (2, "a short text " * 5, "en", "s")], "doc_id long, text string, lang string, source string"), text


def test_quality_rules(docs):
    rows, text = docs
    (row,) = [r for r in quality_rules(rows).collect() if r.doc_id == 1]
    words = text.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.split()]
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len({*lines}), len(again))


def test_the_others(spark, docs):
    rows, text = docs
    assert {r.doc_id: r.n_license_lines for r in license_scan(rows).collect()} == {1: 1, 2: 0}
    items = spark.createDataFrame([(7, PASSAGE), (8, "another passage of fifteen words that is nowhere to be found in any of these texts")], "item_id long, text string")
    assert {r.doc_id: list(r["items"] or []) for r in contamination(rows, items).collect()} == {1: [7], 2: []}
    assert {r.doc_id: r.n_tokens for r in mixed(rows, Mix(percent=100, epochs=1)).collect()} == {1: len(text.split()), 2: 15}
