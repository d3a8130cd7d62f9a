"""The pipeline's stages on a small fixture, each against what it should keep, worked out without them."""

import random
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from oracle import database
from tokenizers import Tokenizer

import corpus_pipeline
from tilegrid.llm import oracles
from tilegrid.llm.queries import vocabulary

TABLES = "region nation customer supplier part orders lineitem events embeddings pages conversations"


def _fixture(folder):
    """Tables in ``folder``, the texts, and the ids of toxic ones: they alone hold words that begin with ``vile``."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("bal", "kor", "min", "tes") for b in "aeiou" for c in ("n", "r", "st", "th")]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(15), text(20)]
    docs, toxic = [text(rng.randint(40, 70)) for _ in range(70)], set(range(0, 70, 7))
    for i in toxic:
        docs[i] = [f"vile{w}" if k % 2 else w for k, w in enumerate(docs[i])]
    docs += [[*docs[1][:-1], "other"], docs[2][:], [*docs[3][:20], "x", *docs[3][20:]], [*docs[4][:10], *text(40)], [*text(9), *items[0], *text(30)], [*text(30), *items[1][:6], "x", *items[1][7:]], [*text(30), *items[1][:9]]]
    benchmark = [" ".join(x) for x in items]
    texts = [" ".join(d) for d in docs]
    n = len(texts)
    rows = pd.DataFrame({"doc_id": range(n), "text": texts, "lang": [("en", "de", "fr")[i % 3] for i in range(n)], "source": [f"src{i % 5}" for i in range(n)], "n_chars": [len(t) for t in texts]})
    rows.to_parquet(f"{folder}/documents.parquet")
    pd.DataFrame({"item_id": [0, 1], "text": benchmark}).to_parquet(f"{folder}/benchmark.parquet")
    pd.DataFrame({"doc_id": range(n), "quality": 1, "toxic": [int(i in toxic) for i in range(n)]}).to_parquet(f"{folder}/labels.parquet")
    for name in TABLES.split():
        pd.DataFrame({"x": [1]}).to_parquet(f"{folder}/{name}.parquet")
    return rows, docs, items, toxic


def test_each_stage_keeps_what_it_should(spark, tmp_path):
    rows, docs, items, toxic = _fixture(tmp_path)
    want = [set(range(len(docs))) - toxic]
    # Near copies: components of pairs that share 80 % of their shingles; the least id stays.
    shingles = {i: {tuple(docs[i][k : k + 5]) for k in range(len(docs[i]) - 4)} for i in want[0]}
    first = {i: i for i in want[0]}
    for i, j in combinations(sorted(want[0]), 2):
        if 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
            low, high = sorted((first[i], first[j]))
            first = {k: low if v == high else v for k, v in first.items()}
    want.append({i for i, v in first.items() if i == v})
    # Passages: 11 of 13 aligned words are equal.
    hit = lambda d, x: any(sum(same[k : k + 13]) >= 11 for s in range(-len(x), len(d)) for same in [[0 <= s + k < len(d) and d[s + k] == w for k, w in enumerate(x)]] for k in range(len(x)))
    want.append({i for i in want[1] if not any(hit(docs[i], x) for x in items)})
    rows[rows.doc_id.isin(want[2])].to_parquet(f"{tmp_path}/documents.kept")
    db = database(str(tmp_path))
    db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.kept')")
    want.append({r[0] for r in db.execute(oracles.mixing_sql(corpus_pipeline.MIX)).fetchall()})
    assert len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 20

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        kept = spark.createDataFrame(stage(spark, kept, str(tmp_path)).toPandas(), kept.schema)
        got = [tuple(r) for r in kept.collect()]
        assert sorted(got) == [tuple(r) for r in rows[rows.doc_id.isin(ids)].itertuples(index=False)], name

    tokenizer, start, told = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0, []
    for i in sorted(want[3]):
        ids = np.array([*tokenizer.encode(" ".join(docs[i]), add_special_tokens=False).ids, 1], "<u4")
        told.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, out)) == told
