"""Queries over replies, traces and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.functions import payload, texts
from tilegrid.operators import attempts, events, traces
from tilegrid.plans import analogs as a
from tilegrid.streaming import live

# Replies, and what they parse to, worked out by hand: error, number of placements, display text.
BAD = "(could not parse placements from previous response)"
REPLIES = (
    ('```json\n{"tool":"play_move","arguments":{"placements":[{"row":7,"col":"8","letter":"a"}]}}\n```', None, 1, "(7,8)=A"),
    ('I think.\nSo: {"tool":"play_move","arguments":{"placements":[]}}', None, 0, "(none)"),
    ("no json here", payload.NO_JSON, None, BAD), ('{"tool":"pass"}', payload.NO_TOOL, None, BAD), ('{"tool":"play_move"}', payload.NO_LIST, None, BAD),
    ('{"tool":"play_move","arguments":{"placements":[{"row":7,"col":7,"letter":"Q"},{"row":7,"col":8,"letter":"I"}]}} thanks', None, 2, "(7,7)=Q, (7,8)=I"), ("", payload.NO_JSON, None, BAD),
)
LINES = (
    ('{"type":"thread.started","thread_id":"t1"}', "thread started", "reasoning", "thread.started"), ('{"type":"turn.started"}', "turn started", "reasoning", "turn.started"),
    ('{"type":"item.completed","item":{"type":"command_execution","command":"ls","status":"completed"}}', "command completed: ls", "reasoning", "command_execution"),
    ('{"type":"item.completed","item":{"type":"reasoning","text":"considering the rack"}}', "considering the rack", "reasoning", "reasoning"),
    ('{"type":"item.completed","item":{"type":"agent_message","text":"hello stream world"}}', "hello stream world", "content", "agent_message"),
    ('{"type":"turn.completed","last_agent_message":"final answer"}', "final answer", "content", "last_agent_message"), ("plain text", "plain text", "content", "stdout"), ("[1, 2]", "", "content", "stdout"),
    ('{"type":"error","message":"Reconnecting... 1/5"}', "", "reasoning", "error"), ('{"type":"error","message":"boom"}', "boom", "reasoning", "error"),
    ('{"type":"item.updated","item":{"type":"file_change","path":"a/b"}}', "file change (updated): a/b", "reasoning", "file_change"), ('{"message":"m"}', "m", "content", "message"),
)
ERRORS = ("Rack cannot supply letter 'S'.", "Placement collides with existing tile at (7, 7)", "No new tiles were provided.", "Main word is invalid: XX", "Move does not connect to the existing board.", "other")


def _values(rows) -> str:
    sql = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)


def parse_tool_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "id int, reply string")
    call = rows.select("id", payload.tool_call(F.col("reply")).alias("c"), payload.placements_text(F.col("reply")).alias("shown"))
    return call.select("id", "c.error", F.when(F.col("c.error").isNull(), F.size("c.placements")).alias("n"), "shown")


PAYLOAD = f"SELECT id, error, CAST(n AS INTEGER) AS n, shown FROM (VALUES {_values((i, *r[1:]) for i, r in enumerate(REPLIES))}) AS t(id, error, n, shown)"


def retry_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e,) for e in ERRORS], "error string").select("error", texts.hint(F.col("error")).alias("hint"))


HINT = "SELECT error, CASE " + " ".join(f"WHEN contains(error, '{k}') THEN '{v}'" for k, v in texts.HINTS) + f" ELSE '{texts.OTHER_HINT}' END AS hint FROM (VALUES {_values((e,) for e in ERRORS)}) AS t(error)"


def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each part, with its brand as the rack."""
    rows = a.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("rack"), F.array().cast("array<struct<row:int,col:int,letter:string,is_blank:boolean,is_existing:boolean>>").alias("board"))
    return rows.select("p_partkey", F.posexplode(attempts.prompt(F.col("rack"), F.col("board"))).alias("turn", "m")).select("p_partkey", "turn", "m.role", F.md5("m.content").alias("digest"), F.length("m.content").alias("chars"))


# The texts of the prompt.
_SYSTEM = "\n".join(attempts.SYSTEM)
_USER = f"""json_object('benchmark', 'highest-immediate-score-only', 'board_size', 15, 'rack', to_json(string_split(p_brand, '')), 'board', json_array(), 'instruction', '{attempts.INSTRUCTION}',
'example', json_object('board_has_existing_word', 'AERIE', 'desired_full_word', 'AERIED', 'correct_response', json_object('tool', 'play_move', 'arguments', json_object('placements', json_array(json_object('row', 6, 'col', 13, 'letter', 'D'))))))::VARCHAR"""
PROMPTS = f"""WITH m AS (SELECT p_partkey, 0 AS turn, 'system' AS role, '{_SYSTEM.replace("'", "''")}' AS content FROM part UNION ALL SELECT p_partkey, 1, 'user', {_USER} FROM part)
SELECT p_partkey, turn, role, md5(content) AS digest, CAST(length(content) AS INTEGER) AS chars FROM m"""


def event_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(LINES)], "id int, line string")
    return rows.select("id", events.agent_event(F.col("line")).alias("e")).select("id", "e.text", "e.channel", "e.event_type")


NORMAL = f"SELECT * FROM (VALUES {_values((i, *r[1:]) for i, r in enumerate(LINES))}) AS t(id, text, channel, event_type)"


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a trace: value is the time, the event's number its order."""
    e = F.struct(F.col("seq"), F.col("type"), F.floor("points").cast("int").alias("elapsed_ms"), F.lit(1).alias("delta_ms"), F.length("type").alias("chars"), F.lit(None).cast("string").alias("source"))
    rows = a.log(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(e)).alias("events"), F.count("*").cast("int").alias("latency"))
    rows = rows.withColumn("events", F.transform("events", lambda x: F.struct(*(x[c].alias(c) for c in ("type", "elapsed_ms", "delta_ms", "chars", "source")))))
    return rows.select("run_id", traces.summary(F.col("events"), F.col("latency")).alias("s")).select("run_id", "s.*")


def _channel(name: str) -> str:
    f = f"FILTER (type = '{name}_delta')"
    return f"CAST(count(*) {f} AS INTEGER) AS {name}_events, CAST(coalesce(sum(length(type)) {f}, 0) AS INTEGER) AS {name}_chars, CAST(arg_min(floor(points), seq) {f} AS INTEGER) AS first_{name}_ms, CAST(arg_max(floor(points), seq) {f} AS INTEGER) AS last_{name}_ms, CAST(count(*) {f} AS INTEGER) AS wait_before_{name}_ms"


TRACE = f"WITH {a.LOG} SELECT run_id, CAST(count(*) AS INTEGER) AS latency_ms, {_channel('reasoning')}, {_channel('content')} FROM log GROUP BY run_id"


def delta_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.log(spark, sf_dir).withColumn("elapsed", F.unix_seconds("at") % 86400)
    return traces.deltas(rows, "run_id", "seq", "elapsed").select("run_id", "seq", "elapsed", "delta_ms")


DELTA = f"WITH {a.LOG}, e AS (SELECT run_id, seq, CAST(floor(epoch(moment)) AS BIGINT) % 86400 AS elapsed FROM log) SELECT run_id, seq, elapsed, greatest(0, elapsed - coalesce(lag(elapsed) OVER (PARTITION BY run_id ORDER BY seq), 0)) AS delta_ms FROM e"


def stall_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.stalls(a.log(spark, sf_dir), "run_id", F.col("at"), ["seq"]).select("run_id", "seq", "gap_seconds")


STALL = f"WITH {a.LOG}, g AS (SELECT run_id, seq, CAST(floor(epoch(moment)) AS BIGINT) - CAST(floor(epoch(lag(moment) OVER (PARTITION BY run_id ORDER BY seq))) AS BIGINT) AS gap_seconds FROM log) SELECT * FROM g WHERE gap_seconds > 60"


def text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each speaker of each conversation, in order."""
    return traces.joined_text(a.table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text")


CONCAT = "SELECT conv_id, role, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id, role"


def flat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one prompt."""
    return attempts.flat_prompt(a.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content"), ["conv_id"])


FLAT = "SELECT conv_id, string_agg(upper(role) || ':' || chr(10) || text, chr(10) ORDER BY turn, upper(role) || ':' || chr(10) || text) AS prompt FROM conversations GROUP BY conv_id"


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(texts.chunks(F.col("text"))).alias("n", "chunk"))


CHUNKS = "WITH p AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE length(text) > 0), u AS (SELECT conv_id, turn, unnest(w) AS x, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS n, len(w) AS k FROM p) SELECT conv_id, turn, n, CASE WHEN n < k - 1 THEN x || ' ' ELSE x END AS chunk FROM u"


def live_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each run of the log is: the batch twin of the stream."""
    return live.progress(a.log(spark, sf_dir)).withColumn("points", F.round("points", 6))


LIVE = f"""WITH {a.LOG}, s AS (SELECT run_id, position_id, arg_max(type, seq) AS last, arg_min(points, seq) FILTER (type = 'board_result') AS points FROM log WHERE type IN ('attempt_started', 'board_result', 'attempt_invalid') GROUP BY run_id, position_id)
SELECT run_id, count(*) AS boards, count(*) FILTER (last = 'board_result') AS done, count(*) FILTER (last = 'attempt_invalid') AS invalid, round(coalesce(sum(points), 0), 6) AS points FROM s GROUP BY run_id"""

QUERIES = {
    parse_tool_payload: PAYLOAD, retry_hint: HINT, prompt_messages: PROMPTS, event_normalise: NORMAL, trace_summary: TRACE, delta_lag: DELTA, stall_gaps: STALL,
    text_concat: CONCAT, flat_prompt: FLAT, word_chunks: CHUNKS, live_progress: LIVE,
}
