import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, items string, doc string, class string, label int, row string, h string, part string, take string, severity string, epoch string"


def document(doc_id, text, lang="en", source="src1"):
    return (doc_id, text, lang, source, None if text is None else len(text), "k", "i", "d", "c", 1, "r", "h", "p", "t", "s", "e")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like the operators' own."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [
        document(1, None), document(2, ""), document(3, " \t\n\x0b "), document(4, "word"), document(5, "one two three four"), document(6, long), document(7, "x" * 200_000),
        document(8, "same text of a repeated row, with some words in it to be counted twice"), document(8, "same text of a repeated row, with some words in it to be counted twice"),
        document(None, "no id but a text that has ten words or a few more"), document(None, None), document(9, "line\n" * 500), document(10, "é ü ß 漢字 \U0001f600 <|endoftext|> ok"),
        document(11, "no language", None, None), document(12, "null source", "en", None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 0, 0), (5, 1, 1), (6, 1, 0), (8, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "this passage has fifteen words in all so that it can be found in texts"), (2, "short"), (3, None), (None, "")], "item_id long, text string")
