"""Queries over messages and replies of every shape, and over tables of two versions, each made of the events or orders and with SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.functions import payload
from tilegrid.operators import events
from tilegrid.plans import analogs as a
from tilegrid.plans import evaluate as judged
from tilegrid.plans.scratch import ensure_folder
from tilegrid.plans.whole import TILES, boards
from tilegrid.sources import files

_LONG = "c" * 130
# Lines of an agent, with N for a number, and the text, channel and type that they stand for.
LINES = (
    ('{"type":"thread.started","n":N}', "thread started", "reasoning", "thread.started"),
    ('{"type":"turn.started","n":N}', "turn started", "reasoning", "turn.started"),
    ('{"type":"turn.completed","n":N}', "turn completed", "reasoning", "turn.completed"),
    ('{"type":"turn.failed","n":N}', "turn failed", "reasoning", "turn.failed"),
    ('{"type":"item.started","item":{"type":"command_execution","command":" ls N ","status":"in_progress"}}', "command in_progress: ls N", "reasoning", "command_execution"),
    ('{"type":"item.updated","item":{"type":"command_execution","command":"ls N"}}', "command updated: ls N", "reasoning", "command_execution"),
    ('{"type":"item.updated","item":{"type":"command_execution","n":N}}', "command updated", "reasoning", "command_execution"),
    ('{"type":"item.completed","item":{"type":"command_execution","command":"' + _LONG + 'N"}}', "command completed: " + "c" * 117 + "...", "reasoning", "command_execution"),
    ('{"type":"item.completed","item":{"type":"file_change","path":"a/N.txt","status":"done"}}', "file change (done): a/N.txt", "reasoning", "file_change"),
    ('{"type":"item.updated","item":{"type":"file_change","file":"b/N"}}', "file change (updated): b/N", "reasoning", "file_change"),
    ('{"type":"item.updated","item":{"type":"file_change","n":N}}', "file change (updated)", "reasoning", "file_change"),
    ('{"type":"item.updated","item":{"type":"todo_list","n":N}}', "todo list updated", "reasoning", "todo_list"),
    ('{"type":"item.completed","item":{"type":"web_search","n":N}}', "web_search completed", "reasoning", "web_search"),
    ('{"item":{"type":"web_search","n":N}}', "web_search item", "reasoning", "web_search"),
    ('{"type":"item.completed","item":{"type":"reasoning","text":"thought N"}}', "thought N", "reasoning", "reasoning"),
    ('{"type":"item.completed","item":{"type":"deep_thinking","content":"deep N"}}', "deep N", "reasoning", "deep_thinking"),
    ('{"type":"item.completed","item":{"type":"reasoning","n":N}}', "reasoning completed", "reasoning", "reasoning"),
    ('{"type":"item.completed","item":{"type":"agent_message","content":"answer N"}}', "answer N", "content", "agent_message"),
    ('{"type":"item.completed","item":{"type":"assistant_message","text":"","message":"said N"}}', "said N", "content", "assistant_message"),
    ('{"type":"item.completed","item":{"type":"message","n":N}}', "", "reasoning", "message"),
    ('{"type":"item.started","item":{"type":"message","n":N}}', "item started", "reasoning", "message"),
    ('{"type":"agent_message","message":"old N"}', "old N", "content", "agent_message"),
    ('{"type":"message","message":"","text":"text N"}', "text N", "content", "message"),
    ('{"type":"error","message":"Reconnecting... N"}', "", "reasoning", "error"),
    ('{"type":"error","message":"boom N"}', "boom N", "reasoning", "error"),
    ('{"type":"error","n":N}', "error", "reasoning", "error"),
    ('{"type":"turn.completed","last_agent_message":"fin N"}', "fin N", "content", "last_agent_message"),
    ("  plain N ", "plain N", "content", "stdout"), ("[N]", "", "content", "stdout"), ('"N"', "", "content", "stdout"), ("{broken N", "{broken N", "content", "stdout"),
    ('{"type":"some.event","n":N}', "some event", "reasoning", "some.event"), ('{"message":"bare N"}', "bare N", "content", "message"), ('{"text":"bare text N"}', "bare text N", "content", "message"), ('{"n":N}', "", "reasoning", ""),
)
# Values that hold text in one way or another, with N for a number, and that text.
VALUES = (
    ('"plain N"', "plain N"), ('["a N","b"]', "a Nb"), ('[{"text":"t N"},{"content":"c"},{"summary":"s"},"x",7,null,["no"]]', "t Ncsx"), ('{"text":"T N","content":"no"}', "T N"), ('{"text":5,"content":"C N"}', "C N"),
    ('{"summary":"S N"}', "S N"), ('{"other":"N"}', ""), ("N", ""), ("true", ""), ("[]", ""), ('[{"text":null,"summary":"late N"}]', "late N"), ('""', ""),
)
# Lists of reasoning details, with N for a number, and their lines.
DETAILS = (
    ('[{"summary":"one N"},{"summary":"two"}]', "one N\ntwo"), ('[{"summary":["a N",{"text":"b"},{"content":""},4]},{"summary":""},"no",{"text":"no"}]', "a N\nb"), ('{"summary":"no N"}', ""), ('"N"', ""), ("[]", ""),
    ('[{"summary":{"text":"no N"}},{"summary":[["no"],["deep N"]]}]', "no\ndeep N"),
)


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def _filled(templates: list[str], number: Column, k: Column) -> Column:
    """The template of a number, with ``k`` for N."""
    return F.replace(F.element_at(F.array(*map(F.lit, templates)), (number % len(templates) + 1).cast("int")), F.lit("N"), k)


def _sql_filled(templates: list[str], number: str) -> str:
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in templates)
    return f"replace([{quoted}][CAST({number} % {len(templates)} + 1 AS INTEGER)], 'N', k)"


_E = "e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)"


def agent_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an agent's output for each event, of all the shapes that its items, crumbs and messages have."""
    line = _filled([x[0] for x in LINES], F.col("event_id"), F.col("k"))
    return _shaped(spark, sf_dir).select("event_id", events.agent_event(line).alias("e")).select("event_id", "e.*")


AGENT_SHAPES = f"WITH {_E} SELECT event_id, " + ", ".join(f"{_sql_filled([x[i] for x in LINES], 'event_id')} AS {name}" for i, name in ((1, "text"), (2, "channel"), (3, "event_type"))) + " FROM e"


def polymorphic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a JSON value of any shape, and of a list of reasoning details, for each event."""
    value = lambda rows: F.try_parse_json(_filled([x[0] for x in rows], F.col("event_id"), F.col("k")))
    rows = _shaped(spark, sf_dir).select("event_id", value(VALUES).alias("v"), value(DETAILS).alias("d"))
    return rows.select("event_id", payload.text_of(F.col("v")).alias("text"), payload.details_text(F.col("d")).alias("details"))


POLYMORPHIC = f"WITH {_E} SELECT event_id, {_sql_filled([x[1] for x in VALUES], 'event_id')} AS text, {_sql_filled([x[1] for x in DETAILS], 'event_id')} AS details FROM e"

# What a model does in its first and second attempt, by the board's number modulo 8; None: there is no such attempt.
ATTEMPTS = (("good", None), ("prose", "good"), ("clash", "outside"), ("down", "good"), ("wrong", "down"), ("tool", "good"), ("down", "down"), ("fenced", "clash"))


def evaluate_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every board played with two attempts: legal moves, fenced or not, prose, another tool, refused moves and failed calls; and a third attempt that doesn't count."""
    rows = boards(spark, sf_dir)
    after = (F.lit(4) + F.col("n")).cast("string")
    call = lambda row, col, letter: F.concat(F.lit('{"tool":"play_move","arguments":{"placements":[{"row":' + row + ',"col":'), col, F.lit(',"letter":"' + letter + '"}]}}'))
    good = call("7", after, "s")
    said = {"good": good, "fenced": F.concat(F.lit("```json\n"), good, F.lit("\n```")), "prose": F.lit("I pass."), "tool": F.lit('{"tool":"pass"}'), "clash": call("7", F.lit("4"), "?"), "outside": call("15", F.lit("0"), "S"), "wrong": call("7", after, "E")}
    attempts = None
    for turn in (1, 2, 3):
        way = F.element_at(F.array(*(F.lit(x[turn - 1] if turn < 3 else "good") for x in ATTEMPTS)), (F.col("id") % 8 + 1).cast("int"))
        reply = F.lit(None).cast("string")
        for name, text in said.items():
            reply = F.when(F.col("way") == name, text).otherwise(reply)
        failure = F.when(F.col("way") == "down", F.lit("Provider is down."))
        own = rows.withColumn("way", way).where("way IS NOT NULL").select(F.col("id").alias("position_id"), F.lit(turn).alias("attempt_index"), reply.alias("reply"), failure.alias("failure"), F.lit(10 * turn).alias("total_tokens"), F.lit(100 * turn).alias("latency_ms"))
        attempts = own if attempts is None else attempts.union(own)
    positions = rows.select("id", F.lit("SE").alias("rack"), "board", F.lit(9).alias("optimal_score"))
    return judged.evaluate(positions, attempts, rows.select(F.concat("run", F.lit("S")).alias("word")).distinct())


_WAYS = lambda turn: "[" + ", ".join("NULL" if x[turn] is None else f"'{x[turn]}'" for x in ATTEMPTS) + "][CAST(id % 8 + 1 AS INTEGER)]"
EVALUATED = f"""WITH {TILES}, known AS (SELECT DISTINCT run || 'S' AS word FROM boards),
b AS (SELECT id, {_WAYS(0)} AS one, {_WAYS(1)} AS two, run || 'E' AS wrong, run || 'E' IN (SELECT word FROM known) AS lucky, CASE n WHEN 3 THEN 2 * (points + 1) WHEN 7 THEN points + 2 ELSE points + 1 END AS total FROM boards),
t AS (SELECT *, CASE WHEN one IN ('good', 'fenced') OR (one = 'wrong' AND lucky) THEN 1 WHEN two = 'good' THEN 2 END AS won FROM b)
SELECT id AS position_id, coalesce(won, 2) AS attempt_index, CASE WHEN won IS NULL THEN CASE two WHEN 'outside' THEN 'Placement out of bounds: (15, 0)' ELSE 'Provider is down.' END END AS validation_error,
CAST(won IS DISTINCT FROM 1 AS INTEGER) AS retry_used, CAST(CASE WHEN won IS NULL THEN 0 ELSE total END AS INTEGER) AS move_score, 9 AS optimal_score, CAST(won IS NOT NULL AND total = 9 AS INTEGER) AS is_optimal,
CAST(CASE WHEN won IS NOT NULL THEN 10 * won WHEN two = 'outside' THEN 20 WHEN one = 'wrong' THEN 10 ELSE 0 END AS INTEGER) AS total_tokens, CAST(CASE WHEN won IS NOT NULL THEN 100 * won WHEN two = 'outside' THEN 200 WHEN one = 'wrong' THEN 100 ELSE 0 END AS INTEGER) AS latency_ms FROM t"""


def gateway_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as the lines of a gateway's stream, an hour of them as a second: what each comes to, and how long its trace is."""
    e = a.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    first = e.groupBy("user_id").agg(F.min("s").alias("first"))
    said = lambda delta, more="": F.concat(F.lit('data: {"choices":[{"delta":' + delta.split("K")[0]), F.col("k"), F.lit(delta.split("K")[1] + "}]" + more + "}"))
    kind = lambda name: F.col("event_type") == name
    line = (
        F.when(F.col("event_id") % 101 == 0, F.lit('data: {"error":{"message":"busy"}}')).when(F.col("event_id") % 211 == 0, F.lit("data: {broken"))
        .when(kind("view"), F.lit(": ping")).when(kind("click"), said('{"reasoning_content":"rK"}')).when(kind("purchase"), said('{"content":"cK","reasoning":"why"}'))
        .when(kind("signup"), said('{"content":[{"text":"tK"},"!"]}', ',"usage":{"total_tokens":7}')).otherwise("data: [DONE]")
    )
    lines = e.join(first, "user_id").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), line.alias("line"), F.floor((F.col("s") - F.col("first")) * 1000 / 3600).cast("int").alias("at_ms"))
    told = events.streamed_answers(lines)
    total = lambda c: F.aggregate("events", F.lit(0), lambda n, x: n + F.coalesce(x[c], F.lit(0))).alias(c)
    return told.select("key", "outcome", "content", "reasoning", "total_tokens", F.size("events").alias("n_events"), total("delta_ms"), total("chars"), F.element_at("events", -1)["type"].alias("last"))


GATEWAY = """WITH e AS (SELECT user_id AS key, event_id AS seq, event_type AS kind, json_extract_string(props, '$.k') AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id % 101 = 0 OR event_id % 211 = 0 AS wrong FROM events),
l AS (SELECT *, CAST(floor((s - min(s) OVER (PARTITION BY key)) * 1000 / 3600.0::DOUBLE) AS INTEGER) AS t,
  CASE WHEN NOT wrong AND kind = 'purchase' THEN 'c' || k WHEN NOT wrong AND kind = 'signup' THEN 't' || k || '!' END AS content, CASE WHEN NOT wrong AND kind = 'click' THEN 'r' || k WHEN NOT wrong AND kind = 'purchase' THEN 'why' END AS reasoning FROM e),
p AS (SELECT *, max(CASE WHEN content IS NOT NULL OR reasoning IS NOT NULL THEN t END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, first(t) OVER (PARTITION BY key ORDER BY seq) AS opened FROM l),
b AS (SELECT *, t - coalesce(last, opened) > 60000 AS stalled FROM p), c AS (SELECT *, min(CASE WHEN wrong OR stalled THEN seq END) OVER (PARTITION BY key) AS stop FROM b),
g AS (SELECT key, any_value(stop) AS stop, coalesce(bool_or(stalled) FILTER (seq = stop), false) AS stalled, coalesce(string_agg(content, '' ORDER BY seq) FILTER (stop IS NULL OR seq < stop), '') AS content, coalesce(string_agg(reasoning, '' ORDER BY seq) FILTER (stop IS NULL OR seq < stop), '') AS reasoning,
  max(CASE WHEN kind = 'signup' AND NOT wrong AND (stop IS NULL OR seq < stop) THEN 7 END) AS total_tokens, count(content) FILTER (stop IS NULL OR seq < stop) + count(reasoning) FILTER (stop IS NULL OR seq < stop) AS n,
  coalesce(sum(t - coalesce(last, 0)) FILTER ((stop IS NULL OR seq < stop) AND (content IS NOT NULL OR reasoning IS NOT NULL)), 0) AS waited, arg_max(CASE WHEN reasoning IS NOT NULL THEN 'reasoning_delta' WHEN content IS NOT NULL THEN 'content_delta' END, seq)
    FILTER ((stop IS NULL OR seq < stop) AND (content IS NOT NULL OR reasoning IS NOT NULL)) AS kind FROM c GROUP BY key)
SELECT key, CASE WHEN stop IS NULL THEN 'streamed' WHEN stalled OR content || reasoning = '' THEN 'fallback' ELSE 'failed' END AS outcome, content, reasoning, CAST(total_tokens AS INTEGER) AS total_tokens,
CAST(3 + n + CASE WHEN stop IS NULL THEN 1 ELSE 0 END AS INTEGER) AS n_events, CAST(waited AS INTEGER) AS delta_ms, CAST(length(content) + length(reasoning) AS INTEGER) AS chars, CASE WHEN stop IS NULL THEN 'stream_done' ELSE coalesce(kind, 'first_stream_bytes') END AS last FROM g"""


def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written in an older version, without an effort or an error, and in a newer one, and read as one table."""
    rows, folder = a.runs(spark, sf_dir).select("id", "company_slug", "status"), f"{ensure_folder(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    files.write_version(rows.where("id % 2 = 0"), folder, 1)
    newer = rows.where("id % 2 = 1").withColumns({"reasoning_effort": F.when(F.col("id") % 3 == 0, "low"), "error": F.when(F.col("id") % 5 == 0, "down"), "board_count": (F.col("id") % 7).cast("int")})
    files.write_version(newer, folder, 2)
    schema = "id long, company_slug string, status string, reasoning_effort string, error string, board_count long, finished_at string"
    return files.read_versions(spark, folder, schema, {1: {"reasoning_effort": "high", "board_count": 100}})


VERSIONS = f"""WITH {a.RUNS} SELECT id, company_slug, status, CASE WHEN id % 2 = 0 THEN 'high' WHEN id % 3 = 0 THEN 'low' END AS reasoning_effort, CASE WHEN id % 2 = 1 AND id % 5 = 0 THEN 'down' END AS error,
CAST(CASE WHEN id % 2 = 0 THEN 100 ELSE id % 7 END AS BIGINT) AS board_count, CAST(NULL AS VARCHAR) AS finished_at FROM runs"""


QUERIES = {agent_shapes: AGENT_SHAPES, polymorphic_texts: POLYMORPHIC, evaluate_replies: EVALUATED, table_versions: VERSIONS, gateway_streams: GATEWAY}
