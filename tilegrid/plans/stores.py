"""Queries over catalogues, files and streams: what is written to the shared folder and read again, each with SQL over the tables it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilegrid.functions import texts
from tilegrid.operators import catalog, events, results, traces
from tilegrid.plans import analogs as a
from tilegrid.plans.scratch import ensure_folder
from tilegrid.plans.whole import TILES, boards
from tilegrid.sources import files
from tilegrid.streaming import growing, live, rollups, stalls


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "supplier").withColumn("slug", F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")))


def model_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as models: the even ones are found by the search, those that three doesn't divide are listed, every fourth is a thinking variant."""
    s = _suppliers(spark, sf_dir)
    models = s.select(F.concat("slug", F.when(F.col("s_suppkey") % 4 == 1, ":thinking").otherwise("")).alias("model_id"))
    hits = s.where("s_suppkey % 2 = 0").select("slug", F.col("s_name").alias("name"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("author"), F.lit("2024-01-01").alias("created_at"), (F.col("s_acctbal") > 5000).alias("supports_reasoning"))
    supported = F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("x"), F.lit("reasoning"))).otherwise(F.array(F.lit("x")))
    listing = s.where("s_suppkey % 3 <> 0").select(F.col("slug").alias("id"), F.concat(F.lit("L "), "s_name").alias("name"), (F.col("s_suppkey") * 86400).alias("created"), supported.alias("supported"))
    return catalog.metadata(models, hits, listing)


METADATA = """WITH m AS (SELECT *, 's/' || s_suppkey AS slug, s_suppkey % 2 = 0 AS hit, s_suppkey % 3 <> 0 AS listed, s_suppkey % 4 = 1 AS thinks FROM supplier),
n AS (SELECT *, slug || CASE WHEN thinks THEN ':thinking' ELSE '' END AS model_id, CASE WHEN hit THEN s_name WHEN listed THEN 'L ' || s_name END AS found FROM m)
SELECT model_id, coalesce(found || CASE WHEN thinks THEN ' (thinking)' ELSE '' END, model_id) AS model_name, CASE WHEN hit THEN 'n' || s_nationkey ELSE 's' END AS company_slug,
CASE WHEN hit THEN '2024-01-01' WHEN listed THEN strftime(DATE '1970-01-01' + CAST(s_suppkey AS INTEGER), '%Y-%m-%dT00:00:00+00:00') END AS release_date,
CASE WHEN hit THEN s_acctbal > 5000 WHEN listed THEN s_suppkey % 5 = 0 ELSE false END AS supports_reasoning FROM n"""


def listed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model cache of each nation in one of three shapes, read, filtered by visibility and led by a default."""
    s = _suppliers(spark, sf_dir).withColumn("visibility", F.element_at(F.array(F.lit(None).cast("string"), F.lit("LIST"), F.lit("hide")), (F.col("s_suppkey") % 3 + 1).cast("int")))
    items = F.array_sort(F.collect_list(F.struct("slug", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("display_name"), "visibility")))
    own = s.groupBy("s_nationkey").agg(items.alias("items"))
    shape = F.col("s_nationkey") % 3
    text = F.when(shape == 0, F.to_json("items")).when(shape == 1, F.to_json(F.struct(F.col("items").alias("models")))).otherwise(F.to_json(F.struct(F.lit(1).alias("v"), F.col("items").alias("other"))))
    default = spark.createDataFrame([("s/1", "One"), ("default", "Default")], "id string, name string")
    return catalog.with_default(catalog.first_known(files.cached_models(own.select(text.alias("value")))), default).select("id", "name")


LISTED = """SELECT 's/' || s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name ELSE 's/' || s_suppkey END AS name FROM supplier WHERE s_suppkey % 3 <> 2 UNION ALL SELECT 'default', 'Default'"""


def agent_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as agents, the even ones available, with their suppliers as models."""
    agents = a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("available"))
    models = _suppliers(spark, sf_dir).select(F.col("s_nationkey").cast("string").alias("agent"), F.col("slug").alias("id"), F.col("s_name").alias("name"))
    return catalog.agent_listing(agents, models).select("id", "name", "available", F.array_join(F.transform("models", lambda m: F.concat(m["id"], F.lit("="), m["name"])), ";").alias("models"))


AGENTS = """SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_nationkey % 2 = 0 AS available, coalesce(string_agg(m.slug || '=' || s_name, ';' ORDER BY m.slug) FILTER (n_nationkey % 2 = 0), '') AS models
FROM nation LEFT JOIN (SELECT *, 's/' || s_suppkey AS slug FROM supplier) m ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name"""


def agent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as agents: names as people write them, slugs in parts, and agents as models."""
    c = a.table(spark, sf_dir, "customer").withColumn("k", (F.col("c_custkey") % 5 + 1).cast("int"))
    written = F.element_at(F.array(*map(F.lit, (" Codex CLI", "codex", "Open Code", "opencode ", "CODEX-cli"))), F.col("k"))
    effort = F.element_at(F.array(F.lit("LOW"), F.lit(None).cast("string"), F.lit(""), F.lit(" high"), F.lit("none")), F.col("k"))
    slug = F.concat(F.lit(" cli/"), F.lower("c_mktsegment"), F.when(F.col("k") > 2, F.concat(F.lit("/m/"), F.col("c_custkey").cast("string"))).otherwise(""))
    rows = c.select("c_custkey", catalog.agent_id(written).alias("id"), F.col("c_name").alias("name"), catalog.slug_parts(slug).alias("p"), effort.alias("effort"))
    return catalog.agent_metadata(rows.select("c_custkey", "id", "name", "effort", "p.*"), "c_custkey", "kind", "agent")


NAMES = """WITH c AS (SELECT c_custkey, c_name AS name, c_custkey % 5 AS k, lower(c_mktsegment) AS agent FROM customer),
m AS (SELECT *, CASE WHEN k IN (2, 3) THEN 'opencode' ELSE 'codex' END AS id, CASE WHEN k > 1 THEN 'm/' || c_custkey END AS model, CASE k WHEN 0 THEN 'low' WHEN 3 THEN 'high' WHEN 4 THEN 'none' END AS effort FROM c)
SELECT concat_ws('/', 'cli', id, model) AS model_id, name || ' (' || coalesce(model, 'default') || ')' || coalesce(' [' || effort || ']', '') AS model_name, 'cli' AS company_slug, effort IS NOT NULL AS supports_reasoning,
coalesce(effort, 'cli') AS reasoning_effort, c_custkey, 'cli' AS kind, agent FROM m"""


def thinking_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as models, a third of which the catalogue has a thinking variant of."""
    s = _suppliers(spark, sf_dir)
    models = s.select(F.concat("slug", F.when(F.col("s_suppkey") % 5 == 0, ":free").otherwise("")).alias("model_id"))
    return catalog.thinking_variant(models, s.where("s_suppkey % 3 = 0").select(F.concat("slug", F.lit(":thinking")).alias("slug")).union(s.select("slug")))


VARIANTS = "SELECT model_id, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 0 THEN model_id || ':thinking' ELSE model_id END AS effective FROM (SELECT s_suppkey, 's/' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN ':free' ELSE '' END AS model_id FROM supplier)"


def model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that looks like an agent's name: agents lead."""
    s = _suppliers(spark, sf_dir)
    agents = a.table(spark, sf_dir, "customer").select(F.concat(F.lit("cli/codex/"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"), F.lit("cli").alias("author"))
    return catalog.searched(s.select(F.concat("slug", F.lit("-codex")).alias("slug"), F.col("s_name").alias("name"), F.lit("s").alias("author")), agents, " Codex")


SEARCHED = """WITH h AS (SELECT 'cli/codex/' || c_custkey AS slug, c_name AS name, 'cli' AS author, 'cli' AS source, 0 AS branch FROM customer UNION ALL SELECT 's/' || s_suppkey || '-codex', s_name, 's', 'openrouter', 1 FROM supplier)
SELECT *, CAST(row_number() OVER (PARTITION BY branch ORDER BY slug) AS INTEGER) AS place FROM h"""


def company_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges of customers, some of companies with a theme of their own."""
    known = F.array(*map(F.lit, ("google", "xai", "z-ai", "unknown", "", "mistralai")))
    name = F.when(F.col("c_custkey") % 8 < 6, F.element_at(known, (F.col("c_custkey") % 8 + 1).cast("int"))).otherwise(F.lower("c_mktsegment"))
    rows = a.table(spark, sf_dir, "customer").select("c_custkey", texts.theme(F.when(F.col("c_custkey") % 8 < 6, name).otherwise(F.lower("c_mktsegment"))).alias("t"), texts.clamped(F.col("c_acctbal") / 100, 1, 32).alias("concurrency"), texts.whole_or_zero(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.lit("none"))).alias("tokens"), texts.progress_phase(F.lit(" at work "), F.when(F.col("c_custkey") % 3 == 0, F.repeat("c_name", 6))).alias("phase"))
    return rows.select("c_custkey", "t.*", "concurrency", "tokens", "phase")


BADGES = """WITH c AS (SELECT *, c_custkey % 8 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'GO' WHEN 1 THEN 'xAI' WHEN 2 THEN 'ZA' WHEN 3 THEN '??' WHEN 4 THEN '??' WHEN 5 THEN 'MI' ELSE upper(left(c_mktsegment, 2)) END AS label,
CASE k WHEN 0 THEN '#284c73' WHEN 1 THEN '#1f2937' WHEN 2 THEN '#213b58' WHEN 3 THEN '#334155' ELSE '#274868' END AS bg, CASE WHEN k IN (1, 3) THEN '#f8fbff' ELSE '#edf6ff' END AS fg,
CAST(least(32, greatest(1, floor(c_acctbal / 100))) AS INTEGER) AS concurrency, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS INTEGER) AS tokens,
CASE WHEN c_custkey % 3 = 0 THEN 'at work: ' || left(repeat(c_name, 6), 80) ELSE 'at work' END AS phase FROM c"""


def date_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five ticks from the first to the last order."""
    span = a.table(spark, sf_dir, "orders").agg(F.min(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("a"), F.max(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("b"))
    return span.select(F.posexplode(texts.ticks(F.col("a"), F.col("b"), 4)).alias("n", "t")).select("n", F.round("t.value", 3).alias("time"), F.round("t.ratio", 6).alias("ratio"))


DATES = "WITH s AS (SELECT epoch(min(o_orderdate)) AS a, epoch(max(o_orderdate)) AS b FROM orders) SELECT CAST(n AS INTEGER) AS n, round(a + (b - a) * n / 4.0, 3) AS time, round(n / 4.0, 6) AS ratio FROM s, range(5) AS r(n)"


def numbered_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as its boards: which of how many."""
    return results.numbered(a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct(), "l_orderkey", F.col("l_linenumber"), F.col("l_partkey"))


NUMBERED = "SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS index, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)"


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as results with their moves and traces stored as JSON, decoded."""
    rows = a.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_returnflag") != "R", F.format_string('{"placements":[{"row":7,"col":%d,"letter":"A","is_blank":false}],"score":%d,"words":["A"]}', F.col("l_linenumber"), F.col("l_partkey"))).alias("parsed_move"),
        F.format_string('[{"type":"content_delta","elapsed_ms":%d}]', F.col("l_partkey")).alias("attempt_trace"))
    read = results.decoded(rows)
    trace = traces.whole_trace(F.when(F.col("n") > 3, F.col("attempt_trace")), F.col("attempt_trace"))
    return read.select("run_id", "n", "part", "parsed_move.score", F.get("parsed_move.placements", F.lit(0))["col"].alias("col"), F.size(trace).alias("events"), F.get(trace, F.lit(0))["elapsed_ms"].alias("first_ms"))


STORED = "SELECT l_orderkey AS run_id, l_linenumber AS n, l_partkey AS part, CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey AS INTEGER) END AS score, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS col, CASE WHEN l_linenumber > 3 THEN 2 ELSE 1 END AS events, CAST(l_partkey AS INTEGER) AS first_ms FROM lineitem"


def settings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a settings file: comments, blank lines, settings with and without spaces, and others."""
    lines = F.array(F.concat(F.lit("# "), "p_name"), F.lit(" "), F.concat("p_brand", F.lit("="), "p_name"), F.concat(F.lit(" "), "p_brand", F.lit(" = "), "p_type", F.lit("=x")), F.col("p_name"))
    return files.settings(a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.element_at(lines, (F.col("p_partkey") % 5 + 1).cast("int")).alias("value")))


SETTINGS = "SELECT p_brand AS key, arg_min(CASE WHEN p_partkey % 5 = 2 THEN p_name ELSE p_type || '=x' END, p_partkey) AS value FROM part WHERE p_partkey % 5 IN (2, 3) GROUP BY p_brand"


def named_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a tool's output that name a model."""
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.lower("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.col("p_name"))
    return files.model_names(a.table(spark, sf_dir, "part").select(line.alias("value")))


NAMED = "SELECT lower(p_brand) || '/' || replace(p_name, ' ', '-') AS id FROM part WHERE p_partkey % 3 = 0"


def stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards written as a dataset and read again: the positions of a full run."""
    rows = boards(spark, sf_dir)
    cells = F.transform("board", lambda c: F.struct(c.row, c.col, c.letter, c.is_blank, F.lit(True).alias("is_existing")))
    band = F.element_at(F.array(F.lit(6), F.lit(10), F.lit(14)), (F.col("id") % 3 + 1).cast("int"))
    out = _folder(spark, "positions")
    files.write_positions(rows.select(F.concat(F.lit("pos-"), F.col("id").cast("string")).alias("id"), band.alias("band_ply"), cells.alias("board"), F.col("run").alias("rack")), out)
    return files.select_positions(files.read_positions(spark, out), "full").select("id", "band_ply", "rack", F.size("board").alias("tiles"))


POSITIONS = f"WITH {TILES} SELECT 'pos-' || id AS id, [6, 10, 14][CAST(id % 3 + 1 AS INTEGER)] AS band_ply, run AS rack, CAST(n AS INTEGER) AS tiles FROM boards ORDER BY 2, 1 LIMIT 100"


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts exported as a CSV file, line by line."""
    out = _folder(spark, "csv")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).when(F.col("p_partkey") % 3 == 1, F.col("p_name"))
    files.export_csv(a.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), "p_type", "p_size"), out)
    return spark.read.option("lineSep", "\r\n").text(out).select(F.col("value").alias("line"))


CSV = """SELECT 'p_partkey,name,p_type,p_size' AS line UNION ALL SELECT p_partkey || ',' || CASE p_partkey % 3 WHEN 0 THEN '"' || p_name || ', ""' || p_brand || repeat('"', 3) WHEN 1 THEN p_name ELSE '' END || ',' || p_type || ',' || p_size FROM part"""


def server_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as texts of a server-sent stream."""
    return files.server_events(a.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"))


SERVED = "SELECT 'data: ' || to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type, 'props': props})::VARCHAR || chr(10) || chr(10) AS value FROM events"


def delta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deltas of each user's attempts as texts of both channels."""
    e = a.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "signup"), "output_delta").otherwise("other")
    rows = e.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 7).alias("position_id"), F.lit(1).alias("attempt_index"), F.when(F.col("event_type") == "click", "reasoning").otherwise("content").alias("channel"), kind.alias("type"), F.col("event_id").alias("seq"), F.concat("props", F.lit(" ")).alias("text"))
    return live.texts(rows)


DELTAS = "SELECT user_id AS run_id, event_id % 7 AS position_id, 1 AS attempt_index, CASE event_type WHEN 'click' THEN 'reasoning' ELSE 'content' END AS channel, string_agg(props || ' ', '' ORDER BY event_id) AS text FROM events WHERE event_type IN ('click', 'signup') GROUP BY ALL"


def process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two outputs of a process for each user: purchases are errors, all others plain answers."""
    e = a.table(spark, sf_dir, "events")
    return events.replayed(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "stderr").otherwise("stdout").alias("stream"), F.concat(F.lit("said "), "event_type").alias("line")))


PROCESS = "SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'stderr: said purchase' || chr(10) ELSE 'said ' || event_type END AS text, CASE WHEN event_type = 'purchase' THEN 'reasoning' ELSE 'content' END AS channel, CASE WHEN event_type = 'purchase' THEN 'stderr' ELSE 'stdout' END AS event_type FROM events"

# Which event of a run's log each kind stands for.
_KINDS = {"view": "attempt_started", "click": "output_delta", "purchase": "board_result", "signup": "output_delta", "error": "attempt_invalid"}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log, followed as a stream of files."""
    return live.tail(spark, _log_files(spark, sf_dir))


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    """The events as lines of a log of JSON, and some that aren't. A position's score depends on run and position alone, so replays agree."""
    e, out = a.table(spark, sf_dir, "events"), _folder(spark, "log")
    kind = F.when(F.col("event_id") % 89 == 0, "run_completed")
    for name, stands in _KINDS.items():
        kind = F.when(kind.isNull() & (F.col("event_type") == name), stands).otherwise(kind)
    place = F.col("event_id") % 10
    told = F.struct(kind.alias("type"), F.col("user_id").cast("string").alias("run_id"), place.cast("string").alias("position_id"), F.lit("content").alias("channel"), F.lit("x").alias("text"), ((F.col("user_id") * 7 + place * 3) % 50).alias("move_score"), F.lit(50).alias("optimal_score"), F.col("event_id").cast("int").alias("elapsed_ms"), (F.col("event_id") % 2 + 1).cast("int").alias("attempt_index"))
    line = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(told))
    e.select(line.alias("value")).write.text(out)
    return out


_LOGGED = """l AS (SELECT event_id, CAST(user_id AS VARCHAR) AS run_id, CAST(event_id % 10 AS VARCHAR) AS position_id, CAST((user_id * 7 + event_id % 10 * 3) % 50 AS INTEGER) AS points, CASE WHEN event_id % 89 = 0 THEN 'run_completed'
  WHEN event_type = 'view' THEN 'attempt_started' WHEN event_type = 'purchase' THEN 'board_result' WHEN event_type = 'error' THEN 'attempt_invalid' ELSE 'output_delta' END AS type FROM events WHERE event_id % 97 <> 0)"""


def _landed(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    return live.landed(stream, _folder(spark, "stream"), _folder(spark, "stream-state"), mode)


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of the followed log when all of it is read."""
    return _landed(spark, live.totals(live.events(_log(spark, sf_dir))), "complete")


TOTALS = f"WITH {_LOGGED} SELECT run_id, count(*) AS boards, CAST(sum(points) AS BIGINT) AS points, CAST(50 * count(*) AS BIGINT) AS optimal FROM (SELECT DISTINCT run_id, position_id, points FROM l WHERE type = 'board_result') GROUP BY run_id"


def growing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals from the source of growing files, which reads the log by byte positions."""
    return _landed(spark, live.totals(live.events(growing.tail(spark, _log_files(spark, sf_dir)))), "complete")


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the followed log that can't be read."""
    return _landed(spark, live.dead_letters(_log(spark, sf_dir)), "append")


DEAD = "SELECT '{broken ' || event_id AS value FROM events WHERE event_id % 97 = 0"


def stream_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the followed log that end a run."""
    return _landed(spark, live.finished(live.events(_log(spark, sf_dir))), "append")


FINISHED = f"WITH {_LOGGED} SELECT run_id, type FROM l WHERE type = 'run_completed'"


def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each position of the followed log, whose lines of all kinds are folded in order."""
    with stalls.rocksdb(spark):  # states of all positions needn't fit into memory
        states = _landed(spark, live.positions(live.events(_log(spark, sf_dir)), order="elapsed_ms"), "update")
    last = states.groupBy("run_id", "position_id").agg(F.max_by(F.struct("status", "attempt_index", "move_score", "optimal_score", F.length("content").alias("chars")), "batch").alias("s"))
    return last.select("run_id", "position_id", "s.*")


STATES = f"""WITH {_LOGGED}, p AS (SELECT run_id, position_id, coalesce(max(event_id) FILTER (type = 'attempt_started'), -1) AS started, max(event_id) FILTER (type = 'board_result') AS scored,
  arg_max(type, event_id) FILTER (type IN ('attempt_started', 'board_result', 'attempt_invalid')) AS last FROM l GROUP BY ALL)
SELECT run_id, position_id, CASE last WHEN 'board_result' THEN 'done' WHEN 'attempt_invalid' THEN 'invalid' ELSE 'streaming' END AS status, CAST(coalesce(any_value(s.event_id % 2 + 1), 0) AS INTEGER) AS attempt_index,
  coalesce(any_value(r.points), 0) AS move_score, CAST(CASE WHEN scored IS NULL THEN 0 ELSE 50 END AS INTEGER) AS optimal_score, CAST(count(*) FILTER (l.type = 'output_delta' AND l.event_id > started) AS INTEGER) AS chars
FROM p JOIN l USING (run_id, position_id) LEFT JOIN l AS s ON s.event_id = started LEFT JOIN l AS r ON r.event_id = scored GROUP BY run_id, position_id, last, scored"""


def incremental_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-ups of all runs, kept up to date while their results arrive in files of a few batches."""
    folder = _folder(spark, "results")
    rows = a.results(spark, sf_dir).select("run_id", "move_score", "optimal_score", F.col("total_tokens").cast("long").alias("total_tokens"))
    files_of_batch = -(-rows.rdd.getNumPartitions() // 4)  # files grow in number with the table, not in size; by hash, since dealing in turn would sort each task's rows
    rows.repartition(4 * files_of_batch, *rows.columns).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_of_batch).parquet(folder)
    held = rollups.followed(stream, _folder(spark, "rollups"), _folder(spark, "rollups-state")).current()
    rounded = [F.round(c, 6).alias(c) for c in ("raw_points", "optimal_raw_points", "avg_total_tokens", "score_pct")]
    return held.select(F.col("run_id").cast("long").alias("run_id"), "boards", *rounded, "min_total_tokens", "max_total_tokens")


KEPT = f"""WITH {a.RESULTS} SELECT run_id, count(*) AS boards, round(sum(move_score), 6) AS raw_points, round(sum(optimal_score), 6) AS optimal_raw_points, round(avg(total_tokens), 6) AS avg_total_tokens,
round(100 * sum(move_score) / sum(optimal_score), 6) AS score_pct, CAST(min(total_tokens) AS BIGINT) AS min_total_tokens, CAST(max(total_tokens) AS BIGINT) AS max_total_tokens FROM results GROUP BY run_id"""


def stream_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of all runs as a stream tells them that reads the log in four parts, by the log's own clock: how often each began, and each that ended with its gap.

    A line comes when all of its run's lines before it have, and not before its own time. So no part has lines that are late, whatever the order of the log's numbers.
    """
    log, (aside, folder, out, state) = a.log(spark, sf_dir).select("run_id", "seq", "at"), (_folder(spark, n) for n in ("clocked", "log", "stream", "stream-state"))
    span = log.agg(F.min(F.unix_micros("at")).alias("low"), F.max(F.unix_micros("at")).alias("high")).first()
    low, step = (span.low, (span.high - span.low) // 4 + 1) if span.low is not None else (0, 1)
    lines = log.withColumn("came", F.max("at").over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    parts = lines.withColumn("part", F.floor((F.unix_micros("came") - low) / step).cast("int"))
    parts.write.partitionBy("part").parquet(aside)
    for part in range(4):
        spark.read.schema(parts.schema).parquet(aside).where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(lines.schema).parquet(folder)
        with stalls.rocksdb(spark):
            told = live.landed(stalls.silences(stream, ["run_id"], "seq", "at", came="came"), out, state, "append")
    return told.groupBy("run_id", "kind", "seq", "gap_seconds").agg(F.count("*").alias("n"))


STALLS = f"""WITH {a.LOG}, s AS (SELECT run_id, seq, CAST(floor(epoch(moment)) AS BIGINT) AS t, lead(CAST(floor(epoch(moment)) AS BIGINT)) OVER (PARTITION BY run_id ORDER BY seq) AS next, lead(seq) OVER (PARTITION BY run_id ORDER BY seq) AS ended FROM log),
told AS (SELECT * FROM s WHERE next - t > 60 OR (next IS NULL AND t * 1000 + 60001 <= (SELECT epoch_ms(max(moment)) - 60000 FROM log)))
SELECT run_id, 'stalled' AS kind, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS gap_seconds, count(*) AS n FROM told GROUP BY run_id UNION ALL SELECT run_id, 'revived', ended, next - t, 1 FROM told WHERE next IS NOT NULL"""


QUERIES = {
    model_metadata: METADATA, listed_models: LISTED, agent_models: AGENTS, agent_names: NAMES, thinking_variants: VARIANTS, model_search: SEARCHED, company_badges: BADGES, date_ticks: DATES, numbered_boards: NUMBERED,
    stored_results: STORED, settings_lines: SETTINGS, named_models: NAMED, stored_positions: POSITIONS, csv_lines: CSV, server_lines: SERVED, delta_texts: DELTAS, process_lines: PROCESS,
    stream_totals: TOTALS, stream_dead_letters: DEAD, stream_finished: FINISHED, stream_positions: STATES, stream_stalls: STALLS, growing_totals: TOTALS, incremental_rollup: KEPT,
}
