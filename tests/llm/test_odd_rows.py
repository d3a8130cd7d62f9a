"""Each operator on odd rows and on an empty table."""

import zlib
from collections import Counter

import pytest

from tilegrid.llm.decontam import contamination, decontaminate
from tilegrid.llm.licenses import license_scan
from tilegrid.llm.linededup import drop_repeated_lines, line_counts
from tilegrid.llm.mixing import Mix, mixed, mixed_documents
from tilegrid.llm.neardup import drop_near_duplicates, near_duplicates
from tilegrid.llm.quality_model import score_quality
from tilegrid.llm.quality_rules import quality_rules
from tilegrid.llm.queries import vocabulary
from tilegrid.llm.token_counts import token_counts
from tilegrid.llm.token_files import token_files
from tilegrid.llm.toxicity import reject_toxic, severity, train

BPE, WORDS = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("word_bpe_49k.json")


@pytest.fixture
def each(labels, benchmark):
    return {
        "counts": lambda d: token_counts(d, BPE), "quality": lambda d: score_quality(d, labels), "lines": line_counts, "cut": drop_repeated_lines, "near": near_duplicates,
        "toxic": lambda d: severity(d, train(d, labels)), "rules": quality_rules, "licenses": license_scan, "files": lambda d: token_files(d, WORDS), "leaks": lambda d: contamination(d, benchmark),
    }


def test_every_row_comes_back(odd, each):
    ids = Counter(r.doc_id for r in odd.select("doc_id").collect())
    for name, operator in each.items():
        rows = operator(odd).collect()
        assert Counter(r["doc_id"] for r in rows) == ids, name


def test_empty_table(none, each, labels, benchmark):
    for name, operator in each.items():
        assert operator(none).collect() == [], name
    assert mixed(none).collect() == []
    assert decontaminate(none, benchmark).collect() == [] == drop_near_duplicates(none).collect() == reject_toxic(none, labels).collect()


def test_filters_keep_columns_and_values(odd, labels, benchmark):
    for made in (decontaminate(odd, benchmark), drop_near_duplicates(odd), reject_toxic(odd, labels), mixed_documents(odd, Mix(percent=100, epochs=1)), drop_repeated_lines(odd)):
        assert made.columns == odd.columns
        assert {(r.key, r.items, r.doc, r["class"], r.label, r.row) for r in made.collect()} == {("k", "i", "d", "c", 1, "r")}


def test_defined_values(odd, labels):
    near = {r.doc_id: r for r in near_duplicates(odd).collect()}
    assert (near[1].n_shingles, near[2].n_shingles, near[3].n_shingles, near[4].n_shingles, near[5].n_shingles) == (0, 0, 0, 1, 1)
    assert near[None].component_id is None and near[None].kept and near[8].component_id == 8
    assert len([r for r in drop_near_duplicates(odd).collect() if r.doc_id == 8]) == 1
    rules = {r.doc_id: r for r in quality_rules(odd).collect() if r.doc_id}
    assert rules[1].base_failed and rules[9].n_dup_lines == 499 and rules[9].n_repeat_words == 500 and rules[7].word_chars == 200_000
    counts = {r.doc_id: r for r in line_counts(odd).collect()}
    assert (counts[9].n_lines, counts[9].n_kept, counts[9].n_removed) == (500, 1, 499) and counts[1].n_lines == 0
    files = {r.doc_id: r for r in token_files(odd, WORDS).collect()}
    assert files[1].n_tokens == files[2].n_tokens == 1
    assert {r.doc_id: r.n_tokens for r in token_counts(odd, BPE).collect()}[2] == 0


def test_no_labels_of_a_class(spark, odd, labels):
    own = next(i for i in range(1, 13) if zlib.crc32(str(i).encode()) % 3 != 1)
    one = spark.createDataFrame([(own, 1, 0)], labels.schema)
    assert {round(r.score, 3) for r in score_quality(odd, one).collect()} == {1.0}
    assert not any(r.toxic for r in severity(odd, train(odd, one)).collect())
    assert {r.score for r in score_quality(odd, labels.where("false")).collect()} == {0.5}


def test_empty_tables_beside_the_documents(odd, labels, benchmark):
    nothing = labels.where("false")
    assert not any(r.toxic for r in severity(odd, train(odd, nothing)).collect()) and reject_toxic(odd, nothing).count() == odd.count()
    clean = contamination(odd, benchmark.where("false")).collect()
    assert len(clean) == odd.count() and not any(r.contaminated for r in clean) and decontaminate(odd, benchmark.where("false")).count() == odd.count()


def test_an_id_with_several_texts_is_one_document(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (7, " ".join(base[:-1])), (9, " ".join(other[:-1])), (11, "something else that is linked with nothing"), (6, " ".join(other[1:]))]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (6, 5, False), (11, 11, True)}


def test_ids_of_other_whole_types(spark, labels):
    docs = spark.createDataFrame([(1, "one text of some words here"), (2, "one text of some words here")], "doc_id int, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {1}
    for operator in (lambda d: token_counts(d, BPE), lambda d: token_files(d, WORDS), lambda d: score_quality(d, labels)):
        assert sorted(r.doc_id for r in operator(docs).collect()) == [1, 2]
