"""The engine's tables as views over the star schema that the queries run on, once for Spark and once as SQL.

Orders stand for runs and line items for their results; parts are positions, events the run log, conversations the attempts and chats,
suppliers the catalogue, and the words of documents the lexicon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.operators import lexicon
from tilegrid.plans.scratch import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("company_slug"))
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("queued")
    return o.join(c, "o_custkey", "left").select(
        F.col("o_orderkey").alias("id"), "company_slug", F.col("o_orderpriority").alias("model_name"), status.alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.lit(None).cast("string").alias("release_date"))


RUNS = """runs AS (SELECT o_orderkey AS id, c_mktsegment AS company_slug, o_orderpriority AS model_name,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'queued' END AS status,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at, CAST(NULL AS VARCHAR) AS release_date
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("position_id"), F.col("l_linenumber").alias("attempt_index"),
        (price * (1 - discount)).alias("move_score"), price.alias("optimal_score"), (discount == 0).cast("int").alias("is_optimal"),
        (F.col("l_returnflag") == "R").cast("int").alias("retry_used"), F.col("l_quantity").alias("total_tokens"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col("l_suppkey").alias("l_suppkey"))


RESULTS = """results AS (SELECT l_orderkey AS run_id, l_partkey AS position_id, l_linenumber AS attempt_index, l_extendedprice * (1 - l_discount) AS move_score,
  l_extendedprice AS optimal_score, CAST(l_discount = 0 AS INTEGER) AS is_optimal, CAST(l_returnflag = 'R' AS INTEGER) AS retry_used, l_quantity AS total_tokens,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS created_at, l_suppkey FROM lineitem)"""
#: Runs with their roll-up; zeros where there are no results.
ROLLED = (
    RUNS + ", " + RESULTS + """, rolled AS (SELECT run_id AS id, sum(move_score) AS raw_points, sum(optimal_score) AS optimal_raw_points, avg(total_tokens) AS avg_total_tokens,
  min(total_tokens) AS min_total_tokens, max(total_tokens) AS max_total_tokens FROM results GROUP BY run_id),
board AS (SELECT runs.*, coalesce(raw_points, 0) AS raw_points, coalesce(optimal_raw_points, 0) AS optimal_raw_points, coalesce(avg_total_tokens, 0) AS avg_total_tokens,
  coalesce(min_total_tokens, 0) AS min_total_tokens, coalesce(max_total_tokens, 0) AS max_total_tokens,
  CASE WHEN coalesce(optimal_raw_points, 0) = 0 THEN 0.0 ELSE CAST(100 AS DOUBLE) * raw_points / optimal_raw_points END AS score_pct FROM runs LEFT JOIN rolled USING (id))"""
)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, value: every run of ASCII letters of every document."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("value"))


TOKENS = "tokens AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS value FROM documents)"


def words(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    return lexicon.build(tokens(spark, sf_dir), full)


WORDS = TOKENS + ", words AS (SELECT DISTINCT upper(value) AS word FROM tokens WHERE length(value) <= 15)"
FEWER = WORDS + ", fewer AS (SELECT word FROM words WHERE length(word) BETWEEN 2 AND 8 ORDER BY word LIMIT 12000)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log: run_id, seq, type, chars, elapsed_ms (since the run's first event), position_id."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("event_type"))
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("value").alias("points"), F.col("ts").cast("timestamp").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("position_id"))


# Which event of the log each kind stands for.
KINDS = {"view": "attempt_started", "click": "reasoning_delta", "purchase": "board_result", "signup": "content_delta", "error": "attempt_invalid"}
LOG = "log AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END AS type, value AS points, ts AS moment, CAST(json_extract_string(props, '$.k') AS INTEGER) AS position_id FROM events)"
