"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.llm import oracles
from tilegrid.llm.decontam import contamination
from tilegrid.llm.fingerprints import document_fingerprints
from tilegrid.llm.importance import resampled
from tilegrid.llm.leaderboard import leaderboard_changes
from tilegrid.llm.licenses import license_scan
from tilegrid.llm.linededup import line_counts
from tilegrid.llm.mixing import mixed
from tilegrid.llm.neardup import near_duplicates
from tilegrid.llm.quality_model import score_quality
from tilegrid.llm.quality_rules import quality_rules
from tilegrid.llm.shared import documents
from tilegrid.llm.token_counts import token_counts
from tilegrid.llm.token_files import token_files
from tilegrid.llm.toxicity import severity, train


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; it is the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixed(documents(spark, sf_dir))
    return taken.select("doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "epoch", "n_tokens", "take_tokens")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels"))
    return severity(docs.select("doc_id", "text"), model).select("doc_id", "severity", "p_toxic", "toxic")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "contaminated", F.size("items").alias("n_items"), F.get("items", F.lit(0)).alias("first_item"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


def op13_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, items, vendors = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sale_lines", "items", "vendors"))
    return leaderboard_changes(lines, items, vendors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_quality_classifier, op3_mixing, op4_line_dedup, op5_near_duplicates, op6_toxicity, op7_quality_rules, op8_license_scan, op9_token_files, op10_decontamination, op11_importance_resampling, op12_fingerprints, op13_leaderboard)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": oracles.mixing_sql(), "op5_near_duplicates": oracles.near_duplicates_sql(), "op7_quality_rules": oracles.quality_rules_sql(), "op8_license_scan": oracles.license_scan_sql(), "op10_decontamination": oracles.contamination_sql(), "op11_importance_resampling": oracles.importance_sql(), "op13_leaderboard": oracles.leaderboard_sql()}
