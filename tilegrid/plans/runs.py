"""Queries over runs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilegrid.functions import texts
from tilegrid.operators import attempts, catalog, results
from tilegrid.plans import analogs as a

NUMBERS = ("raw_points", "optimal_raw_points", "avg_total_tokens", "score_pct")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in NUMBERS if c in df.columns})


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS)
BOARD = ("run_id", "company_slug", "model_name", "status", "started_at", *NUMBERS, "min_total_tokens", "max_total_tokens")


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results.leaderboard(a.runs(spark, sf_dir), a.results(spark, sf_dir)).select(*BOARD))


LEADERBOARD = f"WITH {a.ROLLED} SELECT id AS run_id, company_slug, model_name, status, started_at, {ROUNDED}, min_total_tokens, max_total_tokens FROM board ORDER BY board.score_pct DESC, started_at DESC"


def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results.roll_up(a.results(spark, sf_dir)))


ROLLUP = f"WITH {a.ROLLED} SELECT id AS run_id, {ROUNDED}, min_total_tokens, max_total_tokens FROM board WHERE id IN (SELECT run_id FROM results)"


def run_rollup_zero_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results.runs_with_results(a.runs(spark, sf_dir), a.results(spark, sf_dir)).select("id", *NUMBERS, "min_total_tokens", "max_total_tokens"))


ZERO = f"WITH {a.ROLLED} SELECT id, {ROUNDED}, min_total_tokens, max_total_tokens FROM board"


def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.active(a.runs(spark, sf_dir)).select("id", "status", "started_at")


ACTIVE = f"WITH {a.RUNS} SELECT id, status, started_at FROM runs WHERE status IN ('queued', 'running')"


def latest_active_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.latest_active(a.runs(spark, sf_dir)).select("id", "status", "started_at")


LATEST = ACTIVE + " ORDER BY started_at DESC, id DESC LIMIT 1"


def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = results.runs_with_results(a.runs(spark, sf_dir), a.results(spark, sf_dir))
    return results.summary(board).withColumn("best_score", F.round("best_score", 6))


SUMMARY = f"WITH {a.ROLLED} SELECT count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, round(max(score_pct) FILTER (status = 'completed'), 6) AS best_score FROM board"


def run_detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position_id"), F.col("p_size").alias("band_ply"), F.col("p_brand").alias("rack"))
    rows = results.run_detail(a.results(spark, sf_dir), positions, "band_ply")
    return rows.select("run_id", "position_id", "attempt_index", "band_ply", "rack", F.round("move_score", 6).alias("move_score"), "is_optimal")


DETAIL = f"WITH {a.RESULTS} SELECT run_id, position_id, attempt_index, p_size AS band_ply, p_brand AS rack, round(move_score, 6) AS move_score, is_optimal FROM results JOIN part ON p_partkey = position_id"


def export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results.export_all(results.leaderboard(a.runs(spark, sf_dir), a.results(spark, sf_dir))))


EXPORT_ALL = f"WITH {a.ROLLED} SELECT company_slug AS company, model_name AS model, {ROUNDED}, release_date, min_total_tokens, max_total_tokens FROM board"


def export_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of run 1."""
    rows = a.results(spark, sf_dir).withColumns({"id": F.col("l_suppkey"), "prompt_tokens": F.lit(0), "completion_tokens": F.lit(0), "latency_ms": F.lit(0), "validation_error": F.lit(None).cast("string")})
    return results.export_run(rows, 1).withColumns({"move_score": F.round("move_score", 6)})


EXPORT_RUN = f"WITH {a.RESULTS} SELECT position_id, round(move_score, 6) AS move_score, optimal_score, is_optimal, retry_used, 0 AS prompt_tokens, 0 AS completion_tokens, total_tokens, 0 AS latency_ms, CAST(NULL AS VARCHAR) AS validation_error FROM results WHERE run_id = 1"

STATUSES = ("completed", "running", "failed")


def run_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status changes: errors fail a run, purchases complete it, others keep it running."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("running")
    rows = a.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), status.alias("status"), F.when(kind == "error", F.col("props")).alias("error"))
    return results.current_state(rows)


STATE = """WITH e AS (SELECT user_id AS run_id, event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS done,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_type = 'error' THEN props END AS error FROM events)
SELECT run_id, arg_max(status, seq) AS status, arg_max(done, seq) FILTER (status IN ('completed', 'failed', 'cancelled')) AS finished_at, arg_max(error, seq) FILTER (error IS NOT NULL) AS error FROM e GROUP BY run_id"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored moves of a part: the price in tens is the score."""
    return a.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("position_id"), F.floor(F.col("l_quantity")).cast("long").alias("score"), F.col("l_orderkey").alias("move_id"), "l_linenumber", "l_suppkey").distinct()


MOVES = "moves AS (SELECT DISTINCT l_partkey AS position_id, CAST(floor(l_quantity) AS BIGINT) AS score, l_orderkey AS move_id, l_linenumber, l_suppkey FROM lineitem)"


def best_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.rank().over(Window.partitionBy("position_id").orderBy(F.desc("score")))
    return _moves(spark, sf_dir).withColumn("_r", rank).where("_r = 1").drop("_r")


BEST = f"WITH {a.RESULTS}, {MOVES} SELECT * FROM moves QUALIFY rank() OVER (PARTITION BY position_id ORDER BY score DESC) = 1"


def canonical_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.first_by(_moves(spark, sf_dir), ["position_id"], F.desc("score"), F.col("l_linenumber"), F.col("move_id"), F.col("l_suppkey"))


CANONICAL = f"WITH {MOVES} SELECT * FROM moves QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY score DESC, l_linenumber, move_id, l_suppkey) = 1"


def tied_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_moves(spark, sf_dir).groupBy("position_id").agg(F.max("score").alias("optimal_score"), F.count("*").alias("tied"))


TIED = f"WITH {MOVES} SELECT position_id, max(score) AS optimal_score, count(*) AS tied FROM ({BEST.replace(f'WITH {a.RESULTS}, {MOVES} ', '')}) GROUP BY position_id"

QUOTAS = {6: 34, 10: 33, 14: 33}


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "part").select(F.col("p_size").alias("band_ply"), F.col("p_partkey").alias("position_id"), "p_brand")
    quotas = F.broadcast(spark.createDataFrame([*QUOTAS.items()], "band_ply int, quota int"))  # three rows
    return results.quota(rows, quotas, "band_ply", F.col("position_id"))


QUOTA = "SELECT p_size AS band_ply, p_partkey AS position_id, p_brand FROM part JOIN (VALUES " + ", ".join(f"({k}, {v})" for k, v in QUOTAS.items()) + ") AS q(band, quota) ON band = p_size QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) <= quota"


def _repeated(spark: SparkSession, sf_dir: str, *order: Column) -> DataFrame:
    rows = a.results(spark, sf_dir).select("run_id", "position_id", "attempt_index", "created_at", "l_suppkey", F.round("move_score", 4).alias("move_score"))
    return results.first_by(rows, ["run_id", "attempt_index"], *order)


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir, F.col("created_at"), F.col("position_id"), F.col("l_suppkey"), F.col("move_score"))


def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir, F.desc("created_at"), F.desc("position_id"), F.desc("l_suppkey"), F.desc("move_score"))


def _dedupe_sql(way: str) -> str:
    return f"WITH {a.RESULTS}, r AS (SELECT run_id, position_id, attempt_index, created_at, l_suppkey, round(move_score, 4) AS move_score FROM results) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id, attempt_index ORDER BY created_at {way}, position_id {way}, l_suppkey {way}, move_score {way}) = 1"


def first_ok_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as attempts at it: a returned line is an error; of equal line numbers the last part counts."""
    rows = results.first_by(a.results(spark, sf_dir), ["run_id", "attempt_index"], F.desc("position_id"), F.desc("l_suppkey"), F.desc("created_at"), F.desc("total_tokens"))
    rows = rows.select(F.col("run_id").alias("position_id"), "attempt_index", F.lit(True).alias("answered"), F.when(F.col("retry_used") == 1, "rejected").alias("error"), F.col("total_tokens").cast("int").alias("score"), F.lit(50).alias("optimal_score"), F.col("total_tokens").cast("int").alias("total_tokens"), F.lit(0).alias("latency_ms"))
    return attempts.board_results(rows)


FIRST_OK = f"""WITH {a.RESULTS}, one AS (SELECT run_id AS position_id, attempt_index, retry_used = 1 AS bad, CAST(total_tokens AS INTEGER) AS score FROM results
  QUALIFY row_number() OVER (PARTITION BY run_id, attempt_index ORDER BY position_id DESC, l_suppkey DESC, created_at DESC, total_tokens DESC) = 1),
g AS (SELECT position_id, min(attempt_index) FILTER (NOT bad) AS ok, arg_min(score, attempt_index) FILTER (NOT bad) AS s, arg_max(score, attempt_index) AS l FROM one GROUP BY position_id)
SELECT position_id, coalesce(ok, 2) AS attempt_index, CASE WHEN ok IS NULL THEN 'rejected' END AS validation_error, CAST(coalesce(ok, 2) = 2 AS INTEGER) AS retry_used,
  coalesce(s, 0) AS move_score, 50 AS optimal_score, CAST(coalesce(s = 50, false) AS INTEGER) AS is_optimal, coalesce(s, l) AS total_tokens, 0 AS latency_ms FROM g"""


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations as two catalogues, searched for ``an``; the first catalogue leads."""
    one = a.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_name").alias("name"))
    two = a.table(spark, sf_dir, "nation").select(F.concat(F.lit("n/"), F.lower("n_name")).alias("slug"), F.col("n_name").alias("name"))
    return catalog.merged(catalog.search(one, " 1 "), catalog.search(two, "AN"))


SEARCH = "SELECT 's/' || s_suppkey AS slug, s_name AS name, 0 AS branch FROM supplier WHERE contains(lower('s/' || s_suppkey || ' ' || s_name), '1') UNION ALL SELECT 'n/' || lower(n_name), n_name, 1 FROM nation WHERE contains(lower('n/' || n_name || ' ' || n_name), 'an')"


def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twelve positions."""
    return results.page(a.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), 3, 12, F.col("p_size"), F.col("p_partkey"))


PAGE = "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size, p_partkey LIMIT 12 OFFSET 24"


def tail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events."""
    return results.tail(a.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), 20, "event_id")


TAIL = "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 20"


def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.runs_with_results(a.runs(spark, sf_dir), a.results(spark, sf_dir)).where("status = 'completed'")


def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ticks up to the most tokens of a run, counting none as one."""
    most = _completed(spark, sf_dir).agg(F.greatest(F.max(F.when(F.col("max_total_tokens") == 0, 1).otherwise(F.col("max_total_tokens"))), F.lit(1.0)).alias("m"))
    return most.select(F.posexplode(texts.ticks(F.lit(0.0), F.col("m"), 5)).alias("n", "t")).select("n", F.round("t.value", 6).alias("value"), F.round("t.ratio", 6).alias("ratio"))


TICKS = f"WITH {a.ROLLED}, m AS (SELECT greatest(max(CASE WHEN max_total_tokens = 0 THEN 1 ELSE max_total_tokens END), 1.0) AS m FROM board WHERE status = 'completed') SELECT CAST(n AS INTEGER) AS n, round(m * n / 5.0, 6) AS value, round(n / 5.0, 6) AS ratio FROM m, range(6) AS t(n)"


def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of runs in the plot of tokens against score."""
    rows = _completed(spark, sf_dir)
    most = rows.agg(F.greatest(F.max(F.when(F.col("avg_total_tokens") == 0, 1).otherwise(F.col("avg_total_tokens"))), F.lit(1.0)).alias("most"))
    return rows.crossJoin(F.broadcast(most)).select("id", F.round(80 + F.col("avg_total_tokens") / F.col("most") * 650, 4).alias("x"), F.round(280 - F.col("score_pct") / 100 * 220, 4).alias("y"), F.greatest("score_pct", F.lit(2.0)).cast("decimal(12,4)").cast("double").alias("bar"))


SCATTER = f"WITH {a.ROLLED}, c AS (SELECT *, greatest(max(CASE WHEN avg_total_tokens = 0 THEN 1 ELSE avg_total_tokens END) OVER (), 1.0) AS m FROM board WHERE status = 'completed') SELECT id, round(80 + avg_total_tokens / m * 650, 4) AS x, round(280 - score_pct / 100 * 220, 4) AS y, CAST(CAST(greatest(score_pct, 2.0) AS DECIMAL(12, 4)) AS DOUBLE) AS bar FROM c"


def timeline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of runs in the plot of time against score."""
    rows = _completed(spark, sf_dir).withColumn("t", F.unix_seconds(F.try_to_timestamp("started_at"))).where("started_at IS NOT NULL AND started_at <> ''")
    ends = rows.agg(F.min("t").alias("low"), F.greatest(F.max("t") - F.min("t"), F.lit(1)).alias("span"))
    return rows.crossJoin(F.broadcast(ends)).select("id", F.round(80 + (F.col("t") - F.col("low")) / F.col("span").cast("double") * 650, 4).alias("x"), F.round(260 - F.col("score_pct") / 100 * 190, 4).alias("y"))


TIMELINE = f"WITH {a.ROLLED}, c AS (SELECT *, epoch(CAST(started_at AS TIMESTAMP)) AS t FROM board WHERE status = 'completed'), s AS (SELECT *, min(t) OVER () AS lo, greatest(max(t) OVER () - min(t) OVER (), 1) AS span FROM c) SELECT id, round(80 + (t - lo) / span * 650, 4) AS x, round(260 - score_pct / 100 * 190, 4) AS y FROM s"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of runs: badge, model name without its company, shortened, and date."""
    rows = a.runs(spark, sf_dir)
    name = texts.without_company(F.concat("company_slug", F.lit(": "), F.col("model_name"), F.lit(" of the "), F.lower("company_slug"), F.lit(" company")))
    return rows.select("id", texts.badge(F.col("company_slug")).alias("badge"), texts.shortened(name, 40).alias("name"), texts.date_label(F.col("started_at")).alias("date"))


LABELS = f"""WITH {a.RUNS}, n AS (SELECT id, company_slug, started_at, regexp_replace(company_slug || ': ' || model_name || ' of the ' || lower(company_slug) || ' company', '^[^:]+:\\s*', '') AS name FROM runs)
SELECT id, coalesce(nullif(upper(left(company_slug, 2)), ''), '??') AS badge, CASE WHEN length(name) > 40 THEN left(name, 37) || '...' ELSE name END AS name, strftime(CAST(started_at AS TIMESTAMP), '%b %-d, %Y') AS date FROM n"""

QUERIES = {
    leaderboard: LEADERBOARD, run_rollup: ROLLUP, run_rollup_zero_default: ZERO, active_runs: ACTIVE, latest_active_run: LATEST, summary_counts: SUMMARY, run_detail_join: DETAIL,
    export_all: EXPORT_ALL, export_run: EXPORT_RUN, run_state_latest: STATE, best_moves: BEST, canonical_move: CANONICAL, tied_moves: TIED, quota_sample: QUOTA,
    dedupe_first: _dedupe_sql("ASC"), dedupe_last: _dedupe_sql("DESC"), first_ok_attempt: FIRST_OK, catalog_search: SEARCH, page_slice: PAGE, tail_events: TAIL,
    axis_ticks: TICKS, scatter_points: SCATTER, timeline_points: TIMELINE, labels: LABELS,
}
