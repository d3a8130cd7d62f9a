"""Fingerprints, edited copies and the search within a radius, each against a plain way."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tilegrid.llm import fingerprints
from tilegrid.llm.fingerprints import BITS, document_fingerprints, fingerprinted, near_classes, near_links, simhashes
from tilegrid.llm.kernels import texts_of

SCHEMA = "doc_id long, text string, fingerprint string, part string, node long"
VOCABULARY = [f"w{i}" for i in range(300)] + ["Été", "漢字", "\U0001f600"]


def ring(docs):
    """Each text with the next, in descending order of ids, rows without one last."""
    rows = sorted(((i, t or "") for i, t, *_ in docs), key=lambda r: (math.inf if r[0] is None else -r[0], r[1].encode()))
    return [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]


def edited(text, after):
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def texts(rng, n):
    text = lambda: " ".join(rng.choices(VOCABULARY, k=rng.randrange(1, 120)))
    return [text() for _ in range(n)]


@pytest.mark.parametrize("ids", ["all", "some", "none"])
def test_edited_copies(spark, ids):
    rng = random.Random(ids)
    own = [None, "", " ", "one", "two words", *texts(rng, 300), "same text", "same text"]
    doc_id = {"all": lambda i: i * 3, "some": lambda i: None if i % 7 == 0 else i // 2, "none": lambda i: None}[ids]
    docs = [(doc_id(i), t, "f", "p", 1) for i, t in enumerate(own)]
    rows = fingerprinted(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    want = Counter((i, len(t), hashlib.sha256(edited(t, n).encode()).hexdigest()) for i, t, n in ring(docs))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    prints = {t: p.tobytes() for t, p in zip(own[1:], simhashes(*texts_of(pa.array(own[1:]))), strict=True)}
    like = lambda x, y: max(0.0, math.cos(math.pi * (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() / BITS))
    after = {e: simhashes(*texts_of(pa.array([e])))[0].tobytes() for e in (edited(t, n) for _, t, n in ring(docs))}
    told = sorted((hashlib.sha256(edited(t, n).encode()).hexdigest(), prints[t], after[edited(t, n)], round(like(prints[t], after[edited(t, n)]), 9), round(like(prints[t], prints[n]), 9)) for _, t, n in ring(docs))
    assert sorted((r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9)) for r in rows) == told


def test_votes_are_those_of_single_terms():
    """A text's fingerprint is the sign of the weighted votes of its pairs of words, each of which is the fingerprint of a text of its own."""
    rng = random.Random(1)
    for text in texts(rng, 20):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        pairs = Counter(zip(w, w[1:], strict=False))
        if not pairs:
            continue
        sums = np.zeros(BITS, np.int64)
        for pair, n in pairs.items():
            votes = np.unpackbits(simhashes(*texts_of(pa.array([" ".join(pair)])))[0]).astype(int) * 2 - 1
            sums += votes * round(64 * (1 + math.log(n)))
        assert np.array_equal(np.unpackbits(simhashes(*texts_of(pa.array([text])))[0]), sums > 0)


def test_equal_texts_in_batches_of_any_size():
    """A text has one fingerprint, alone, among others and in pieces."""
    rng = random.Random(4)
    long = " ".join(rng.choices(VOCABULARY, k=600_000))
    assert len(long.encode()) > 2 << 20
    short = texts(rng, 50)
    alone = [simhashes(*texts_of(pa.array([t])))[0].tobytes() for t in short]
    assert [p.tobytes() for p in simhashes(*texts_of(pa.array([*short, long])))[:-1]] == alone == [p.tobytes() for p in simhashes(*texts_of(pa.array(short)))]
    assert simhashes(*texts_of(pa.array(["", " \n"]))).sum() == 0


def test_edits_stay_near_and_others_do_not():
    rng = random.Random(9)
    own = [" ".join(rng.choices(VOCABULARY, k=300)) for _ in range(60)]
    prints = simhashes(*texts_of(pa.array(own)))
    copies = simhashes(*texts_of(pa.array([edited(t, own[i - 1]) for i, t in enumerate(own)])))
    assert fingerprints.likeness(prints, copies).min() > 0.45 > 0.35 > fingerprints.likeness(prints[1:], prints[:-1]).max()


def planted(rng, families, members, flips):
    """Fingerprints in families of chains, each a few bits from the one before."""
    out = []
    for _ in range(families):
        now = rng.getrandbits(BITS)
        for _ in range(members):
            out.append(now)
            for bit in rng.sample(range(BITS), rng.choice(flips)):
                now ^= 1 << bit
    return [*dict.fromkeys(out)]


def classes_by_all_pairs(prints, radius):
    least = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    return least


@pytest.mark.parametrize(("radius", "blocks", "group"), [(7, 8, 2048), (7, 8, 5), (3, 5, 2048), (0, 1, 2048)])
def test_search_misses_nothing(spark, monkeypatch, radius, blocks, group):
    monkeypatch.setattr(fingerprints, "GROUP", group)
    rng = random.Random(radius)
    prints = planted(rng, 25, 12, [1, 2, radius, radius, radius + 1, 20])
    table = spark.createDataFrame([(i, bytearray(p.to_bytes(BITS // 8))) for i, p in enumerate(prints)], "doc_id long, fingerprint binary")
    rows = near_classes(table.union(table), radius, blocks).collect()
    least = classes_by_all_pairs(prints, radius)
    assert {int.from_bytes(r.fingerprint): r.class_id for r in rows} == dict(zip(prints, least, strict=True)) and len(rows) == len(prints)
    links = near_links(table.withColumnRenamed("doc_id", "node"), radius, blocks).collect()
    assert all((prints[r.a] ^ prints[r.b]).bit_count() <= radius for r in links)


def test_odd_rows_and_empty_tables(odd, none):
    rows = {r.doc_id: r for r in document_fingerprints(odd).collect()}
    assert document_fingerprints(odd).count() == odd.count() and rows[8].class_id == 8 and rows[None].class_id is None
    assert rows[1].fingerprint == rows[3].fingerprint == "0" * 64 and rows[1].class_id == 1 and rows[1].n_chars == 0 and rows[6].n_chars > 200_000
    assert document_fingerprints(none).collect() == []
