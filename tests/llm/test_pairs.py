"""Near duplicates, line classes and decontamination against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilegrid.llm import graph, linededup, neardup
from tilegrid.llm.decontam import LEAST, MASKS, NEED, REGION, SPAN, STRIDE, contamination
from tilegrid.llm.graph import components
from tilegrid.llm.linededup import ALLOWED, distances, drop_repeated_lines, line_counts, line_keys
from tilegrid.llm.neardup import drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        up[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("one_task", "broadcast"), [(10**6, 10**6), (0, 10**6), (0, 0)])
def test_components(spark, monkeypatch, one_task, broadcast):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    monkeypatch.setattr(graph, "MOST_BROADCAST", broadcast)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    want = classes(6000, [e for e in edges if e[0] != e[1]])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}


def _copies(rng, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = rng.choice(["zug", "ram", "Tel", "ovi"]) + str(rng.randrange(50))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("block", "percent", "most", "rounds"), [(512, 85, 10**6, 2), (6, 85, 0, 1), (512, 80, 10**6, 1)])
def test_near_duplicates(spark, monkeypatch, block, percent, most, rounds):
    for name, value in (("BLOCK_DOCS", block), ("PASSING", 4 * block), ("MOST_BROADCAST", most), ("ROUNDS", rounds)):
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(graph, "ONE_TASK", most)
    rng = random.Random(block)
    bases = [[f"v{rng.randrange(900)}" for _ in range(size)] for size in (3, 6, 40, 80, 150)]
    texts = [t for b in bases for t in _copies(rng, b, 24, max(1, len(b) // 25))] + [" ".join(f"u{rng.randrange(5000)}" for _ in range(60)) for _ in range(20)]
    texts += [texts[0], texts[50], "", None, texts[60].upper()]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    linked = [(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = classes(len(texts), linked)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(docs, percent).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in got)
    assert sorted(r.doc_id for r in drop_near_duplicates(docs, percent).collect()) == sorted(set(want))


def test_equal_symbols_as_often_as_sets_overlap():
    rng = np.random.default_rng(3)
    share = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.sort(base[:370]), np.sort(base[30:])
        x, y = neardup.signatures([a, b])
        share.append((x == y).mean())
    assert abs(np.mean(share) - 340 / 400) < 0.02


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, s, n):
    t = list(s)
    for _ in range(n):
        i = rng.randrange(len(t))
        k = rng.randrange(3)
        t[i : i + (k != 1)] = [] if k == 2 else [rng.choice("abcé")]
    return "".join(t)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 3))
def test_bounded_distance(seed, edits):
    rng = random.Random(seed)
    pairs = []
    for _ in range(8):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(8, 40)))
        b = edited(rng, a, rng.randint(0, edits + 2))
        if abs(len(a) - len(b)) <= edits and len(b) > edits:
            pairs.append((a, b))
    if pairs:
        code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
        assert [min(d, edits + 1) for d in distances([code(a) for a, _ in pairs], [code(b) for _, b in pairs], edits).tolist()] == [min(distance(a, b), edits + 1) for a, b in pairs]


def may_link(a, b, allowed=ALLOWED):
    """Whether two lines are linked, by comparing them in full."""
    return a == b or distance(a, b) <= max((e for n, e in allowed if n <= min(len(a), len(b))), default=0)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([ALLOWED, ((3, 1), (8, 2), (30, 3)), ((3, 2),)]))
def test_linked_lines_share_a_key(seed, allowed):
    rng = random.Random(seed)
    a = "".join(rng.choice("abcdé ") for _ in range(rng.choice([*range(3, 41), rng.randint(3, 70)])))
    b = edited(rng, a, rng.randint(1, allowed[-1][1]))
    if a != b and may_link(a, b, allowed):
        (ka, oa), (kb, ob) = (line_keys(x, allowed, set()) for x in (a, b))
        assert {k for k, o in zip(ka, oa, strict=True) if o & 1} & set(kb) or {k for k, o in zip(kb, ob, strict=True) if o & 1} & set(ka)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_long_lines_share_keys_with_each_other_and_with_shorter_ones(seed):
    """Lines about as long as a piece: some are hashed at once, some substring by substring."""
    rng = random.Random(seed)
    a = "".join(rng.choice("abcdé") for _ in range(rng.randint(46, 54)))
    b = edited(rng, a, rng.randint(1, 2))
    was, linededup.PIECE = linededup.PIECE, 50
    try:
        (ka, oa), (kb, ob) = (line_keys(x, ALLOWED, set()) for x in (a, b))
    finally:
        linededup.PIECE = was
    if may_link(a, b):
        assert {k for k, o in zip(ka, oa, strict=True) if o & 1} & set(kb) or {k for k, o in zip(kb, ob, strict=True) if o & 1} & set(ka)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 3))
def test_distance_along_diagonals(seed, edits):
    rng = random.Random(seed)
    a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 25)))
    b = rng.choice([edited(rng, a, rng.randint(0, 4)), "", a[:3], a + "ab"])
    code = lambda s: np.frombuffer(s.encode("utf-32-le"), np.uint32)
    assert linededup.far_apart(code(a), code(b), edits) == min(distance(a, b), edits + 1)


def test_pieces_hold_all_lines(monkeypatch):
    monkeypatch.setattr(linededup, "PIECE", 20)
    rng = random.Random(3)
    for _ in range(200):
        texts = ["\n".join("x" * rng.choice([0, 1, 5, 19, 20, 21, 60]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 4))]
        pieces = [*linededup.line_pieces(iter(texts))]
        assert [line for p in pieces for line in p.split("\n")] == [line for t in texts for line in t.split("\n")]
        assert all(len(p) <= 42 or "\n" not in p for p in pieces)


def test_long_lines_are_linked(spark, monkeypatch):
    """Lines over a piece and the limit of the banded distance, compared with brute force."""
    for name, value in (("PIECE", 60), ("LONG", 50)):
        monkeypatch.setattr(linededup, name, value)
    rng = random.Random(12)
    bases = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (40, 49, 52, 59, 60, 61, 62, 90, 200)]
    lines = [edited(rng, b, rng.randint(0, 3)) for b in bases for _ in range(6)]
    rows = linededup.line_counts(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string").coalesce(1)).collect()
    got = {r.doc_id: r.line_classes[0] for r in rows}
    least = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if may_link(lines[i], lines[j]):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    assert len({*zip((got[i] for i in range(len(lines))), least, strict=True)}) == len({*got.values()}) == len({*least})


@pytest.mark.parametrize(("block", "frequent"), [(1024, 32), (5, 4)])
def test_line_classes(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(linededup, "BLOCK", block)
    monkeypatch.setattr(linededup, "FREQUENT", frequent)
    rng = random.Random(block)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (3, 10, 17, 33, 40, 120)]
    lines = [edited(rng, b, rng.randint(0, 3)) for b in bases for _ in range(16)]
    lines += ["x" * n for n in (15, 16, 17, 30, 31, 32, 33, 34)] * 2
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) + rng.choice(["", "\n", "\n \n"]) for i in range(0, len(lines), 4)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    own = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate(t.split("\n")) if WORD.search(x)]
    linked = [(i, j) for i, j in combinations(range(len(own)), 2) if may_link(own[i][2], own[j][2])]
    first = classes(len(own), linked)
    kept = {(own[i][0], own[i][1]) for i in first}
    rows = {r.doc_id: r for r in line_counts(docs).collect()}
    assert [rows[i].n_kept for i in range(len(texts))] == [sum(d == i for d, _ in kept) for i in range(len(texts))]
    told = [c for i in range(len(texts)) for c in rows[i].line_classes]
    assert {(a == b) == (x == y) for (a, x), (b, y) in combinations(zip(told, first, strict=True), 2)} == {True}
    cut = {r.doc_id: r.text for r in drop_repeated_lines(docs).collect()}
    assert cut == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if not WORD.search(x) or (i, p) in kept) for i, t in enumerate(texts)}


def test_masks_find_every_region():
    for odd in range(STRIDE):
        hits = [{s + x for x in m} for m in MASKS for s in range(REGION - max(m)) if (s + odd) % STRIDE == 0]
        assert all(any(not h & set(wrong) for h in hits) for wrong in combinations(range(REGION), REGION - NEED))


def test_masks_find_every_short_item():
    for n in range(LEAST, REGION):
        for odd in range(STRIDE):  # the first document position within the item that is hashed
            assert any(s + SPAN <= n for s in range(odd, n, STRIDE))


@pytest.mark.parametrize(("most", "size"), [(10**6, 10**6), (3, 10**6), (10**6, 3)])
def test_contamination(spark, most, size):
    rng = random.Random(most)
    word = lambda: f"w{rng.randrange(60)}"
    items = [[word() for _ in range(n)] for n in (5, 8, 9, 12, 13, 14, 20, 40)]
    texts = []
    for _ in range(150):
        text = [word() for _ in range(rng.randrange(30))]
        part = list(rng.choice(items))
        cut = rng.randrange(0, max(1, len(part) - 10))
        part = part[cut : cut + rng.randint(10, 40)]
        for _ in range(rng.randrange(5)):
            part[rng.randrange(len(part))] = "other"
        texts.append(" ".join(text + part + [word() for _ in range(rng.randrange(10))]).title())

    texts += [" ".join([word() for _ in range(k)] + item) for item in items for k in (0, 1, 2, 3)]

    def found(text):
        w, out = text.lower().split(), []
        for i, item in enumerate(items):
            if len(item) >= LEAST:
                need = NEED if len(item) >= REGION else len(item)
                for shift in range(-len(item), len(w)):
                    same = [0 <= shift + k < len(w) and w[shift + k] == x for k, x in enumerate(item)]
                    if any(sum(same[k : k + REGION]) >= need for k in range(len(same))):
                        out.append(i)
                        break
        return out

    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in contamination(docs, bench, most, size).collect()}
    want = {i: found(t) for i, t in enumerate(texts)}
    assert got == want and 20 < sum(map(bool, want.values())) < 160 and {i for x in want.values() for i in x} >= {2, 3}
