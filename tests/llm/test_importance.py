"""CRC algebra against zlib, and the resampling against plain strings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tilegrid.llm import crc
from tilegrid.llm.importance import resampled

SCHEMA = "doc_id long, text string, rank long, fit string, n long, weight string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def texts(rng, n):
    alphabet = ["a", "Word", "déjà", "漢字", "x" * 63, "y" * 64, "z" * 65, "q" * 300, "7", "I'm", "--", "\U0001f600", "end.\n"]
    return ["", None, " ", "one", *(" ".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(n))]


def test_algebra_is_zlibs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 64, 65, 130, 1000]))) for _ in range(2))
        got = crc.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert got[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_of_words(longest):
    rng = random.Random(longest)
    column = texts(rng, 60)
    found = [Counter() for _ in column]
    for crcs, whose, _ in crc.run_crcs(pa.array(column), longest):
        for c, d in zip(crcs.tolist(), whose.tolist(), strict=True):
            found[d][c] += 1
    assert found == [Counter(zlib.crc32(g.encode()) for g in grams(t, longest)) for t in column]


def test_long_texts_come_in_pieces():
    rng = random.Random(3)
    text = " ".join(rng.choice(["Ab", "longer", "é", "w" * 70]) for _ in range(150_000)) + " " + "k" * 2_500_000 + " end of it"
    want, found, n_words = Counter(zlib.crc32(g.encode()) for g in grams(text, 3)), Counter(), 0
    parts = [*crc.run_crcs(pa.array(["first one", text]), 3)]
    for crcs, whose, of_words in parts:
        n_words += int((of_words == 1).sum())
        found.update(crcs[whose == 1].tolist())
    assert len(parts) > 3 and found == want and n_words == len(words(text))


def expected(docs, target, longest, buckets, percent, least):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in rows for g in grams(x, longest)) for rows in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s_all + buckets) / ((s[k] + 1) * (t_all + buckets)))) for k in range(buckets)]
    rows = []
    for i, text, *_ in docs:
        g = grams(text, longest)
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(text)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[2]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest):
    rng = random.Random(7)
    docs = [(i, t, 1, "f", 2, "w") for i, t in enumerate(texts(rng, 200))] + [(None, "a text without an id " * 9, 1, "f", 2, "w"), (11, "again " * 30, 1, "f", 2, "w"), (11, "again " * 30, 1, "f", 2, "w")]
    target = ["word word déjà 7", None, "", "words of a target 漢字"]
    made = resampled(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), longest, 500, 30, 5)
    assert [t for _, t in made.dtypes] == ["bigint"] * 6
    assert sorted((tuple(r) for r in made.collect()), key=str) == expected(docs, target, longest, 500, 30, 5)


def test_empty_tables(spark, none):
    assert resampled(none, none).collect() == []
    some = spark.createDataFrame([(1, "word " * 25, 1, "f", 2, "w")], SCHEMA)
    assert [(r.n_words, r.rank) for r in resampled(some, none, percent=100).collect()] == [(25, 1)]
