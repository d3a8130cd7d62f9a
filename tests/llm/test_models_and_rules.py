"""Classifiers on held-out labels, rules and licences by case, mixing by hand, and all queries against their SQL."""

import random
import re
from hashlib import md5

import pytest
from oracle import database, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

import corpus_pipeline
from tilegrid.llm import licenses, mixing
from tilegrid.llm import quality_rules as quality_rules_module
from tilegrid.llm import queries as q
from tilegrid.llm.license_texts import KNOWN, SPELLINGS
from tilegrid.llm.licenses import license_scan
from tilegrid.llm.mixing import Mix, budgets, mixed
from tilegrid.llm.quality_model import held_out, score_quality
from tilegrid.llm.quality_rules import MEASURES, REACH, fences, quality_rules

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert rows_of_spark(q.queries()[name](spark, SMALL)) == rows_of_sql(database(SMALL), q.oracle_sql()[name])


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    before, after = ({r.doc_id: r.score for r in score_quality(docs, x).collect()} for x in (labels, turned))
    assert before == after and all(0 <= s <= 1 for s in before.values())
    moved = docs.withColumns({"source": F.lit("other"), "lang": F.lit("xx")})
    assert {r.doc_id: r.score for r in score_quality(moved, labels).collect()} == before


@pytest.mark.parametrize("most", [10**6, 0])
def test_rules(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules_module, "MOST_FENCES", most)
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(40)), "en", f"s{i % 3}") for i in range(60)]
    bad = [(100, "a b c d e " * 10, "en", "s0"), (101, "few words", "en", "s0"), (102, " ".join(f"w{k}###" for k in range(40)), "en", "s1"), (103, "\n".join(["one line of the text"] * 3 + [f"t{k} u{k} v{k} x{k}" for k in range(9)]), "en", "s1")]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string"), enough=10).collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(got[i].kept for i in (100, 101, 102))
    assert (got[100].n_words, got[100].n_repeat_words, got[100].base_failed) == (50, 50, True)
    assert got[102].n_symbols == 120 and got[103].n_dup_lines == 2 and got[101].base_failed


def slow_digest(text):
    """The digest of a text's words, worked out word by word."""
    ones, pairs = ({old: new for old, new in SPELLINGS if (" " in old) == two} for two in (False, True))
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    holder = re.compile(r"(copyright[ \t]*(\(c\)|©|[0-9<])|\(c\)[ \t]*[0-9]|©|all[ \t]+rights[ \t]+reserved)")
    words = []
    for line in text.split("\n"):
        found = holder.search(line)
        if found and not re.search(r"[a-z0-9©(<]", line[: found.start()]):
            continue
        words.append([ones.get(w, w) for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", line) if w])
    out = []
    for line in words:
        i = 0
        while i < len(line):
            two = pairs.get(" ".join(line[i : i + 2]))
            out += two.split() if two else [line[i]]
            i += 2 if two else 1
    return md5(" ".join(out).encode()).hexdigest()


def test_whole_license_texts(spark):
    """Whole texts, with their lines broken anew, other case, punctuation, spelling and holders, are found by their digest."""
    rng = random.Random(3)
    british = {new: old for old, new in SPELLINGS if " " not in old and old != "https"}
    texts, want = [], {}
    for name, text in KNOWN:
        want.setdefault(slow_digest(text), set()).add(name)
        changed = re.sub(r"[A-Za-z]+", lambda m: british.get(m[0], m[0]) if rng.random() < 0.5 else m[0], text) if rng.random() < 0.5 else text
        changed = re.sub(r"(?<=[a-z,;]) (?=[a-z])", lambda m: rng.choice([" ", "  ", "\t"]), changed)
        texts.append("Copyright (c) 2019 Some Body\nAll rights reserved.\n\n" + (re.sub("[a-z]+", lambda m: m[0].upper(), changed) if rng.random() < 0.3 else changed))
    texts += [t + " and more" for _, t in KNOWN[:50]] + ["licence licence", "license license", "sub licence sub licence", "sublicense sublicense"]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    names = {d: min(n) for d, n in want.items()}
    assert len(want) > 150 and len({n for n, _ in KNOWN}) > 60
    for i, text in enumerate(texts):
        assert got[i].digest == slow_digest(text), text[:200]
        assert got[i].license_id == names.get(got[i].digest)
    n = len(KNOWN)
    assert all(got[i].license_id for i in range(n)) and not any(got[i].license_id for i in range(n, n + 54))
    assert got[n + 50].digest == got[n + 51].digest and got[n + 52].digest == got[n + 53].digest


@pytest.mark.parametrize(("most", "sizes"), [(10**6, 10**6), (0, 10**6), (10**6, 0)])
def test_licenses(spark, monkeypatch, most, sizes):
    monkeypatch.setattr(licenses, "MOST_BROADCAST", most)
    monkeypatch.setattr(licenses, "MOST_SIZES", sizes)
    mit = dict(KNOWN)["MIT"]
    short = [("MIT", "MIT License\n\n" + mit), ("MIT", mit), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("MIT", "Released under the MIT License.")]
    texts = [t for _, t in short] + ["Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + short[0][1].upper().replace(".", " ;").replace(" ", "\n", 7), short[0][1].replace("sublicense", "sub-licence"), mit + " more", "x\nReleased  under the mit LICENCE\ny\nReleased under the MIT License."]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), short).collect()}
    assert [got[i].license_id for i in range(4)] == [k for k, _ in short]
    assert (got[4].license_id, got[5].license_id, got[6].license_id) == ("MIT", "MIT", None)
    assert (got[7].license_id, got[7].n_license_lines, got[7].line_licenses) == (None, 2, "MIT")
    assert license_scan(spark.createDataFrame([(1, mit)], "doc_id long, text string"), []).first().license_id is None


def test_budgets_by_hand(spark):
    mix = Mix(domain={"a": 3, "b": 1}, lang={}, source={}, percent=100, epochs=1)
    # a has 100 tokens and b 300; of 400, a's share is 300, so 200 move to b. In b, x lacks 50 that go to its siblings.
    rows = [("a", "x", "s", 100), ("b", "x", "s", 50), ("b", "y", "s", 150), ("b", "z", "s", 70), ("b", "z", "t", 30)]
    got = {(r.domain, r.lang, r.source): r.budget for r in budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), mix).collect()}
    assert got == {k[:3]: k[3] for k in rows}
    half = Mix(domain={"a": 3, "b": 1}, lang={"z": 2}, source={"t": 3}, percent=50, epochs=1)
    got = {(r.domain, r.lang, r.source): r.budget for r in budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), half).collect()}
    # 200: a takes its 100 of 150; b gets 100: x, y, z weigh 1, 1, 2 -> 25, 25, 50; in z, s and t weigh 1 and 3 -> 20 and 30, as t has no more.
    assert got == {("a", "x", "s"): 100, ("b", "x", "s"): 25, ("b", "y", "s"): 25, ("b", "z", "s"): 20, ("b", "z", "t"): 30}


@pytest.mark.parametrize("most", [10**6, 0])
def test_mix_takes_prefixes(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_LEAVES", most)
    docs = spark.createDataFrame([(i, "w " * (i % 7), "en", f"src{i % 5}") for i in range(200)] + [(7, "w w w w w w w", "en", "src2")] * 5, "doc_id long, text string, lang string, source string")
    got = mixed(docs, Mix(percent=150, epochs=3, domain={}, source={"src1": 5})).collect()
    total = sum(i % 7 for i in range(200)) + 35
    assert sum(r.take_tokens for r in got) == total * 150 // 100
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        last = max(r.epoch for r in rows)
        assert sum(0 < r.take_tokens < r.n_tokens for r in rows) <= 1 and all(r.take_tokens == r.n_tokens for r in rows if r.epoch < last)


def test_mix_of_many_equal_rows(spark):
    """The budget ends among equal rows; the same ids and texts lie in several leaves, whose hashes are thus equal."""
    rows = [(7, "a b c d e f", "en", f"src{s}") for s in (1, 2) for _ in range(30)] + [(i, "x y z", "en", f"src{s}") for i in (1, 2, 3) for s in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for percent in (10, 50, 90):
        got = mixed(docs, Mix(percent=percent, epochs=1, domain={}, source={"src1": 3})).collect()
        total = 2 * (30 * 6 + 9)
        assert sum(r.take_tokens for r in got) == total * percent // 100
        for s in ("src1", "src2"):
            assert sum(0 < r.take_tokens < r.n_tokens for r in got if r.source == s) <= 1


def test_fences_of_sketches_that_compact(spark):
    """With far more rows than a sketch holds, its fences have ranks near those asked for, however the rows are dealt."""
    k = 64
    rows = spark.range(20_000).selectExpr("'en' AS lang", "'s' AS source", "false AS base_failed", *(f"(xxhash64(id, '{m}') % 100000 + 100000) / 2000D AS {m}" for m in MEASURES))
    for parts in (1, 7):
        fence = fences(rows.repartition(parts), k=k).first().fence
        for m, least in MEASURES.items():
            values = sorted(r[0] for r in rows.select(m).collect())
            q = lambda share, off: values[min(len(values) - 1, max(0, int((share + off) * len(values))))]
            reach = [q(0.75, off) + REACH * max(q(0.75, off) - q(0.25, -off), least) for off in (-0.06, 0.06)]
            assert reach[0] <= fence[m] <= reach[1]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    ids, kept = [], docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, MORE)
        if name != "token_output":
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.toPandas(), docs.schema)
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[2]) > len(ids[3]) == len(ids[4]) > 500
    assert {r.doc_id for r in corpus_pipeline.run(spark, MORE).collect()} == ids[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
