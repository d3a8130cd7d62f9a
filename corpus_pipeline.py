"""From raw documents to token files: the stages of a training corpus, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilegrid.llm.decontam import decontaminate
from tilegrid.llm.mixing import Mix, mixed_documents
from tilegrid.llm.neardup import drop_near_duplicates
from tilegrid.llm.queries import vocabulary
from tilegrid.llm.shared import documents, written
from tilegrid.llm.token_files import token_files
from tilegrid.llm.toxicity import reject_toxic

#: Percent of five-word shingles that near copies share.
SIMILARITY = 80
#: The mix of the corpus: as the operator's own, but no document twice.
MIX = Mix(epochs=1)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't reject."""
    return reject_toxic(docs, documents(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: that with the smallest doc_id."""
    return drop_near_duplicates(docs, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights take."""
    return mixed_documents(docs, MIX)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents; the rows tell where each is, as read back."""
    return token_files(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output),
]

#: No SQL fits a model or encodes tokens; tests/llm/test_pipeline_stages.py compares each stage and the token rows with what a small fixture should give.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
