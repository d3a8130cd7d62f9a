"""Queries that run the engine's operators over whole tables, each with SQL that doesn't share its constants or its way.

Orders stand for boards: the lines of an order, by number, lay a run of tiles across row 7 from column 4 on, each the letter of its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.functions import payload, texts
from tilegrid.operators import attempts, board, events, score, traces
from tilegrid.plans import analogs as a
from tilegrid.plans import evaluate as judged

BOARD = "array<struct<row:int,col:int,letter:string,is_blank:boolean>>"


def _letter(n: Column) -> Column:
    return F.char((65 + n % 26).cast("long"))


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n, run, first, board of every order with lines; parts whose number ends in 0 are blanks."""
    lines = a.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))).alias("l"))
    tile = lambda x, i: F.struct(F.lit(7).alias("row"), (F.lit(4) + i).alias("col"), _letter(x.p).alias("letter"), (x.p % 10 == 0).alias("is_blank"))
    rows = rows.withColumn("board", F.transform("l", tile).cast(BOARD))
    run = F.array_join(F.transform("board", lambda c: c.letter), "")
    return rows.select("id", F.size("board").alias("n"), run.alias("run"), F.left(run, F.lit(1)).alias("first"), "board")


# Points of the letters from A to Z.
_POINTS = "[1,3,3,2,1,4,2,4,1,8,5,1,3,1,1,3,10,1,1,1,1,4,4,8,4,10]"
TILES = """tiles AS (SELECT l_orderkey AS id, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
cells AS (SELECT id, CAST(3 + row_number() OVER (PARTITION BY id ORDER BY l_linenumber) AS INTEGER) AS col, chr(CAST(65 + p % 26 AS INTEGER)) AS letter, p % 10 = 0 AS is_blank,
  CASE WHEN p % 10 = 0 THEN 0 ELSE """ + _POINTS + """[CAST(1 + p % 26 AS INTEGER)] END AS points FROM tiles),
boards AS (SELECT id, count(*) AS n, string_agg(letter, '' ORDER BY col) AS run, min_by(letter, col) AS first, sum(points) AS points, min_by(points, col) AS first_points FROM cells GROUP BY id)"""  # fmt: skip


def board_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of every board in long form, by way of its text."""
    return board.cell_rows(boards(spark, sf_dir))


CELLS = f"WITH {TILES} SELECT id, 7 AS row, col, letter, is_blank FROM cells"


def board_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row 7 of every board as text; blanks are in lower case."""
    rows = boards(spark, sf_dir)
    return rows.select("id", F.get(board.rendered(board.grid_of(F.col("board"))), F.lit(7)).alias("line"))


LINES = f"""WITH {TILES}, squares AS (SELECT boards.id, CAST(k AS INTEGER) AS col FROM boards, range(15) AS r(k))
SELECT id, '07 ' || string_agg(CASE WHEN letter IS NULL THEN '.' WHEN is_blank THEN lower(letter) ELSE letter END, ' ' ORDER BY col) AS line FROM squares LEFT JOIN cells USING (id, col) GROUP BY id"""


def board_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many squares of each board a move could start from, and the sums of their places."""
    return board.anchors(boards(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


ANCHORS = f"WITH {TILES} SELECT id, 2 * n + 2 AS n, 14 * n + 14 AS rows, CAST(2 * sum(col) + 3 + 4 + n AS BIGINT) AS cols FROM boards JOIN cells USING (id) GROUP BY id, n"


def board_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each square of all boards shows which text, with a mark below the first tile."""
    rows = boards(spark, sf_dir)
    marks = rows.select("id", F.lit(8).alias("row"), F.lit(4).alias("col"), F.lit("#").alias("letter"))
    return board.overlay_view(rows, marks).groupBy("row", "col", "text").agg(F.count("*").alias("n"))


OVERLAYS = f"""WITH {TILES}, half AS (SELECT CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col, least(r, 14 - r) AS x, least(k, 14 - k) AS y FROM range(15) AS i(r), range(15) AS j(k)),
squares AS (SELECT row, col, CASE WHEN (x, y) IN ((0, 0), (0, 7), (7, 0)) THEN 'TW' WHEN (x, y) IN ((1, 1), (2, 2), (3, 3), (4, 4), (7, 7)) THEN 'DW'
  WHEN (x, y) IN ((1, 5), (5, 1), (5, 5)) THEN 'TL' WHEN (x, y) IN ((0, 3), (3, 0), (2, 6), (6, 2), (3, 7), (7, 3), (6, 6)) THEN 'DL' ELSE '' END AS label FROM half),
shown AS (SELECT squares.row, squares.col, CASE WHEN squares.row = 8 AND squares.col = 4 THEN '#' ELSE coalesce(letter, label) END AS text
  FROM boards CROSS JOIN squares LEFT JOIN cells ON cells.id = boards.id AND squares.row = 7 AND cells.col = squares.col)
SELECT row, col, text, count(*) AS n FROM shown GROUP BY ALL"""


def position_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of each position with its own run as the rack, whatever the order of its cells."""
    return boards(spark, sf_dir).select("id", board.position_key(F.reverse("board"), F.col("run")).alias("key"))


KEYS = f"""WITH {TILES} SELECT id, to_json({{'cells': list({{'row': 7, 'col': col, 'letter': letter, 'is_blank': is_blank}} ORDER BY col), 'rack': any_value(run)}})::VARCHAR AS key
FROM boards JOIN cells USING (id) GROUP BY id"""


def board_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move for each board, of eight kinds by the order's number, judged and scored: id, score, error, words."""
    rows = boards(spark, sf_dir)
    place = lambda row, col, letter: F.struct(F.lit(row).cast("string").alias("row"), (col if isinstance(col, Column) else F.lit(col)).cast("string").alias("col"), F.lit(letter).alias("letter"))
    after = F.lit(4) + F.col("n")
    kind, raw = F.col("id") % 8, F.array(place(7, after, "S"))
    for k, tiles in {0: [(7, 4, "A")], 1: [(15, 0, "A")], 2: [(0, 0, "Q")], 3: [(7, after, "Z")], 4: [(8, 4, "E")], 6: [(7, after, "S"), (7, after + 1, "E")], 7: [(0, 0, "A"), (1, 1, "B")]}.items():
        raw = F.when(kind == k, F.array(*(place(*t) for t in tiles))).otherwise(raw)
    rack = F.element_at(F.array(*(F.lit(x) for x in ("A", "A", "QQ", "ABC", "EE", "SSS", "S?", "AB"))), (kind + 1).cast("int"))
    moves = rows.select(F.col("id").alias("move_id"), rack.alias("rack"), "board", raw.alias("raw"))
    known = rows.where("id % 16 = 5").select(F.concat("run", F.lit("S")).alias("word"))
    known = known.union(rows.where("id % 16 = 6").select(F.concat("run", F.lit("SE")))).union(rows.where("first < 'N'").select(F.concat("first", F.lit("E")))).distinct()
    return score.score_moves(moves, known).select(F.col("move_id").alias("id"), "score", "error", F.array_join("words", ",").alias("words"))


MOVES = f"""WITH {TILES}, known AS (SELECT run || 'S' AS word FROM boards WHERE id % 16 = 5 UNION SELECT run || 'SE' FROM boards WHERE id % 16 = 6 UNION SELECT first || 'E' FROM boards WHERE first < 'N'),
formed AS (SELECT *, CASE id % 8 WHEN 4 THEN first || 'E' WHEN 5 THEN run || 'S' WHEN 6 THEN run || 'SE' END AS word,
  CASE id % 8 WHEN 4 THEN first_points + 1 WHEN 5 THEN CASE n WHEN 3 THEN 2 * (points + 1) WHEN 7 THEN points + 2 ELSE points + 1 END
    WHEN 6 THEN CASE WHEN n IN (2, 3) THEN 2 * (points + 1) WHEN n = 7 THEN points + 2 ELSE points + 1 END END AS total FROM boards),
told AS (SELECT id, word, total, CASE WHEN id % 8 = 0 AND first = 'A' THEN 'No new tiles were provided.' WHEN id % 8 = 0 THEN 'Placement collides with existing tile at (7, 4)'
  WHEN id % 8 = 1 THEN 'Placement out of bounds: (15, 0)' WHEN id % 8 = 2 THEN 'Single-tile move does not connect to any word.' WHEN id % 8 = 3 THEN 'Rack cannot supply letter ''Z''.'
  WHEN id % 8 = 7 THEN 'Placements must all be on the same row or column.' WHEN word IN (SELECT word FROM known) THEN NULL
  WHEN id % 8 = 6 THEN 'Main word is invalid: ' || word ELSE 'Word is invalid: ' || word END AS error FROM formed)
SELECT id, CASE WHEN error IS NULL THEN CAST(total AS INTEGER) END AS score, error, CASE WHEN error IS NULL THEN word END AS words FROM told"""


def evaluate_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider that always lays an A on the centre, on every board: replies parsed, judged and reduced to a result for each."""
    rows = boards(spark, sf_dir)
    positions = rows.select("id", F.lit("A").alias("rack"), "board", F.lit(10).alias("optimal_score"))
    known = rows.where("id % 2 = 0").select(F.concat("run", F.lit("A")).alias("word")).distinct()
    return judged.evaluate(positions, judged.mock_replies(positions), known)


EVALUATED = f"""WITH {TILES}, known AS (SELECT DISTINCT run || 'A' AS word FROM boards WHERE id % 2 = 0),
told AS (SELECT id, 2 * (points + 1) AS total, CASE WHEN n < 3 THEN 'Single-tile move does not connect to any word.' WHEN n = 3 AND run || 'A' IN (SELECT word FROM known) THEN NULL WHEN n = 3 THEN 'Word is invalid: ' || run || 'A'
  WHEN substr(run, 4, 1) = 'A' THEN 'No new tiles were provided.' ELSE 'Placement collides with existing tile at (7, 7)' END AS error FROM boards)
SELECT id AS position_id, CASE WHEN error IS NULL THEN 1 ELSE 2 END AS attempt_index, error AS validation_error, CAST(error IS NOT NULL AS INTEGER) AS retry_used,
  CAST(CASE WHEN error IS NULL THEN total ELSE 0 END AS INTEGER) AS move_score, 10 AS optimal_score, CAST(error IS NULL AND total = 10 AS INTEGER) AS is_optimal, 29 AS total_tokens, 0 AS latency_ms FROM told"""


def _k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type and the number in its properties as text."""
    return a.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


def _of(kinds: dict[str, tuple]) -> Column:
    """A text by the event's type; None in a text's parts stands for the number."""
    out = F.lit(None).cast("string")
    for kind, parts in kinds.items():
        out = F.when(F.col("event_type") == kind, F.concat(*(F.col("k") if p is None else F.lit(p) for p in parts))).otherwise(out)
    return out


_E = "e AS (SELECT event_id, user_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events)"
_REPLIES = {
    "view": ('```json\n{"tool":"play_move","arguments":{"placements":[{"row":7,"col":"', None, '","letter":"a"}]}}\n```'), "click": ('So: {"tool":"play_move","arguments":{"placements":[]}} thanks ', None),
    "purchase": ('{"tool":"pass","k":', None, "}"), "signup": ('{"tool":"play_move","arguments":{"k":', None, "}}"), "error": ("no json ", None),
}


def reply_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies, fenced, amid prose, of other tools, without a list and without JSON, one for each event."""
    rows = _k(spark, sf_dir).withColumn("reply", _of(_REPLIES))
    told = lambda c: F.struct(c.error.alias("error"), F.when(c.error.isNull(), F.size(c.placements)).alias("n"), payload.call_text(c).alias("shown"))
    return rows.select("event_id", board.let(payload.tool_call(F.col("reply")), told).alias("t")).select("event_id", "t.*")


PAYLOADS = f"""WITH {_E} SELECT event_id, CASE kind WHEN 'purchase' THEN 'Response did not use the play_move tool envelope.' WHEN 'signup' THEN 'Tool payload is missing arguments.placements.' WHEN 'error' THEN 'Response did not contain JSON.' END AS error,
CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS n, CASE kind WHEN 'view' THEN '(7,' || k || ')=A' WHEN 'click' THEN '(none)' ELSE '(could not parse placements from previous response)' END AS shown FROM e"""

_LINES = {
    "view": ('{"type":"item.completed","item":{"type":"command_execution","command":"ls ', None, '","status":"completed"}}'), "click": ('{"type":"item.completed","item":{"type":"reasoning","text":"thought ', None, '"}}'),
    "purchase": ('{"type":"item.completed","item":{"type":"agent_message","text":"answer ', None, '"}}'), "signup": ("plain ", None), "error": ('{"type":"error","message":"boom ', None, '"}'),
}


def agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an agent's output for each event, told as text, channel and type."""
    return _k(spark, sf_dir).select("event_id", events.agent_event(_of(_LINES)).alias("e")).select("event_id", "e.*")


AGENT_LINES = f"""WITH {_E} SELECT event_id, CASE kind WHEN 'view' THEN 'command completed: ls ' WHEN 'click' THEN 'thought ' WHEN 'purchase' THEN 'answer ' WHEN 'signup' THEN 'plain ' ELSE 'boom ' END || k AS text,
CASE WHEN kind IN ('purchase', 'signup') THEN 'content' ELSE 'reasoning' END AS channel,
CASE kind WHEN 'view' THEN 'command_execution' WHEN 'click' THEN 'reasoning' WHEN 'purchase' THEN 'agent_message' WHEN 'signup' THEN 'stdout' ELSE 'error' END AS event_type FROM e"""

_PARTS = {
    "view": ('{"type":"text","part":{"text":"p', None, '"}}'), "click": ('{"type":"reasoning","text":"t', None, '"}'), "purchase": ('{"type":"x","content":"c', None, '"}'),
    "signup": ("raw ", None), "error": ('{"type":"step","k":', None, "}"),
}


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with its text in a part, in ``text``, in ``content`` or nowhere, for each event."""
    return _k(spark, sf_dir).select("event_id", events.part_event(_of(_PARTS)).alias("e")).select("event_id", "e.*")


PART_LINES = f"""WITH {_E} SELECT event_id, CASE kind WHEN 'view' THEN 'p' || k WHEN 'click' THEN 't' || k WHEN 'purchase' THEN 'c' || k WHEN 'signup' THEN 'raw ' || k ELSE '' END AS text,
CASE kind WHEN 'click' THEN 'reasoning' ELSE 'content' END AS channel, CASE kind WHEN 'view' THEN 'text' WHEN 'click' THEN 'reasoning' WHEN 'purchase' THEN 'x' WHEN 'signup' THEN 'stdout' ELSE 'step' END AS event_type FROM e"""


def provider_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of a provider: what the user says as reasoning, the rest as content, with the turn as the tokens used."""
    told = a.table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    delta = F.struct(F.when(~user, F.col("text")).alias("content"), F.when(user, F.col("text")).alias("reasoning"))
    body = F.to_json(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices"), F.when(~user, F.struct(F.col("turn").alias("total_tokens"))).alias("usage"), F.col("role").alias("provider")))
    lines = told.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), body).alias("line"))
    noise = told.select(F.col("conv_id").alias("key"), F.lit(-1).cast("long").alias("seq"), F.lit(": ping").alias("line")).distinct()
    return events.provider_answer(events.provider_chunks(lines.union(noise))).withColumn("seen", F.length(F.coalesce("error", F.lit("")))).drop("error")


ANSWERS = """SELECT conv_id AS key, coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role <> 'user'), '') AS content, coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'user'), '') AS reasoning,
CAST(max(turn) FILTER (role <> 'user') AS INTEGER) AS total_tokens, arg_max(role, turn) AS provider, 0 AS seen FROM conversations GROUP BY conv_id"""


def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each conversation; its very last turn, if it is an answer, is a closing repetition."""
    told = a.table(spark, sf_dir, "conversations")
    last = told.groupBy("conv_id").agg(F.max("turn").alias("last"))
    kind = F.when(F.col("turn") == F.col("last"), "last_agent_message").otherwise("agent_message")
    rows = told.join(last, "conv_id").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), "text", F.when(F.col("role") == "user", "reasoning").otherwise("content").alias("channel"), kind.alias("event_type"))
    return events.final_answer(rows)


FINAL = """WITH c AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS closing FROM conversations), s AS (SELECT * FROM c WHERE role <> 'user' AND text <> '')
SELECT conv_id AS key, coalesce(arg_max(text, turn) FILTER (NOT closing), arg_max(text, turn)) AS text FROM s GROUP BY conv_id"""


def agent_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole output of an agent for each user: text parts together, or else the last other text, or else the lines themselves."""
    line = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('{"type":"text","part":{"text":"'), F.col("k"), F.lit(',"}}'))).when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"content":" '), F.col("k"), F.lit(' "}'))).otherwise(F.concat(F.lit("raw "), F.col("k")))
    return events.output_text(_k(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), line.alias("line")))


OUTPUTS = f"""WITH {_E} SELECT user_id AS key, CASE user_id % 3 WHEN 0 THEN string_agg(k || ',', '' ORDER BY event_id) WHEN 1 THEN arg_max(k, event_id) ELSE string_agg('raw ' || k, chr(10) ORDER BY event_id) END AS text FROM e GROUP BY user_id"""


def synthetic_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as an answer that came at once: its events, with the turn as the time."""
    user = F.col("role") == "user"
    content, reasoning = F.when(user, F.lit("")).otherwise(F.col("text")), F.when(user, F.col("text"))
    made = events.synthetic_events(content, reasoning, F.col("turn"))
    return a.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(made).alias("n", "e")).select("conv_id", "turn", "n", "e.*")


SYNTHETIC = """WITH c AS (SELECT conv_id, turn, CAST(turn AS INTEGER) AS t, role, CAST(length(text) AS INTEGER) AS size FROM conversations)
SELECT conv_id, turn, 0 AS n, 'request_sent' AS type, 0 AS elapsed_ms, CAST(NULL AS INTEGER) AS delta_ms, CAST(NULL AS INTEGER) AS chars FROM c UNION ALL SELECT conv_id, turn, 1, 'non_stream_response', t, NULL, NULL FROM c
UNION ALL SELECT conv_id, turn, 2, CASE WHEN role = 'user' THEN 'reasoning_delta' ELSE 'content_delta' END, t, t, size FROM c WHERE size > 0"""

_ERRORS = (
    "Rack cannot supply letter 'S'.", "Placement collides with existing tile at (7, 7)", "No new tiles were provided.", "Placements must all be on the same row or column.", "Move has a gap in its main word.",
    "Main word is invalid: XX", "Cross word is invalid: XX", "Word is invalid: XX", "Move does not connect to the existing board.", "The provider is down.",
)


def _error(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _ERRORS)), (number % len(_ERRORS) + 1).cast("int"))


def retry_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a rejected move: which hint how many of them get."""
    return a.table(spark, sf_dir, "lineitem").select(texts.hint(_error(F.col("l_partkey"))).alias("hint")).groupBy("hint").agg(F.count("*").alias("n"))


# The hints for the errors above, by number.
_HINTS = """CASE WHEN {0} = 0 THEN 'Use only letters available in the rack. If you need a missing letter, you must consume a ? blank.'
WHEN {0} = 1 THEN 'Do not place on top of an occupied square unless the letter already matches there. Return only newly placed tiles.'
WHEN {0} = 2 THEN 'Return at least one newly placed tile. Do not answer with only existing board letters.'
WHEN {0} IN (3, 4) THEN 'All new placements must lie on one line and form one contiguous word with no gaps.'
WHEN {0} IN (5, 6, 7) THEN 'Check the full word formed on the board after your placement, including all touched existing letters.'
WHEN {0} = 8 THEN 'Your move must connect to the existing board through adjacency or overlap with matching existing letters.'
ELSE 'Return a legal move using only newly placed tiles and only letters from the rack.' END"""
HINTS = f"SELECT {_HINTS.format('l_partkey % 10')} AS hint, count(*) AS n FROM lineitem GROUP BY 1"


def retry_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback on a rejected reply for each event, whose number names the error."""
    rows = _k(spark, sf_dir).withColumn("reply", _of(_REPLIES))
    return rows.select("event_id", attempts.feedback(F.lit("AB?"), F.col("reply"), _error(F.col("event_id"))).alias("feedback"))


_REASONS = "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in _ERRORS) + "]"
MESSAGES = f"""WITH {_E} SELECT event_id, json_object('tool_result', json_object('tool', 'play_move', 'status', 'rejected', 'reason', {_REASONS}[CAST(event_id % 10 + 1 AS INTEGER)],
'attempted_placements', CASE kind WHEN 'view' THEN '(7,' || k || ')=A' WHEN 'click' THEN '(none)' ELSE '(could not parse placements from previous response)' END, 'rack', json_array('A', 'B', '?'),
'hint', {_HINTS.format('event_id % 10')}, 'reminder', json_array('Return only newly placed tiles.', 'Do not re-emit crossing letters already on the board.', 'Do not invent letters outside the rack.',
'Reply with one raw JSON object and nothing else.')))::VARCHAR AS feedback FROM e"""


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timing of each user's events as one line."""
    e = F.struct(F.col("seq"), F.col("type"), F.floor("points").cast("int").alias("elapsed_ms"), F.lit(1).alias("delta_ms"), F.length("type").alias("chars"), F.lit(None).cast("string").alias("source"))
    rows = a.log(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(e)).alias("events"), (F.count("*") * 20).cast("int").alias("latency"))
    rows = rows.withColumn("events", F.transform("events", lambda x: F.struct(*(x[c].alias(c) for c in ("type", "elapsed_ms", "delta_ms", "chars", "source")))))
    effort = F.when(F.col("run_id") % 2 == 0, "high")
    return rows.select("run_id", traces.summary(F.col("events"), F.col("latency")).alias("s")).select("run_id", texts.trace_line(F.col("s"), effort).alias("line"))


def _ms(sql: str) -> str:
    return f"(CASE WHEN {sql} IS NULL THEN 'n/a' WHEN {sql} >= 1000 THEN printf('%.1f', {sql} / 1000.0) || 's' ELSE ({sql})::VARCHAR || 'ms' END)"


TRACE_LINES = f"""WITH {a.LOG}, s AS (SELECT run_id, count(*) * 20 AS latency, CAST(arg_min(floor(points), seq) FILTER (type = 'reasoning_delta') AS INTEGER) AS fr, CAST(arg_min(floor(points), seq) FILTER (type = 'content_delta') AS INTEGER) AS fc,
  count(*) FILTER (type = 'reasoning_delta') AS nr, count(*) FILTER (type = 'content_delta') AS nc FROM log GROUP BY run_id)
SELECT run_id, concat_ws(' · ', 'requested ' || CASE WHEN run_id % 2 = 0 THEN 'high reasoning' ELSE 'reasoning' END, 'latency ' || {_ms('latency')}, 'first reasoning ' || {_ms('fr')}, 'first content ' || {_ms('fc')},
  'reasoning chars ' || (nr * 15)::VARCHAR, 'content chars ' || (nc * 13)::VARCHAR, 'wait before reasoning ' || {_ms('nr')}, 'wait before content ' || {_ms('nc')}) AS line FROM s"""


def model_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time between the events of each user that are output of the model."""
    rows = a.log(spark, sf_dir).withColumn("elapsed", F.unix_seconds("at") % 86400)
    return traces.model_deltas(rows, "run_id", "seq", "elapsed", "type").select("run_id", "seq", "delta_ms")


GAPS = f"""WITH {a.LOG}, e AS (SELECT run_id, seq, CAST(floor(epoch(moment)) AS BIGINT) % 86400 AS t FROM log WHERE type IN ('reasoning_delta', 'content_delta'))
SELECT run_id, seq, greatest(0, t - coalesce(lag(t) OVER (PARTITION BY run_id ORDER BY seq), 0)) AS delta_ms FROM e"""


def number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of orders as percentages, thousands, times and dates, with exact halves to the even digit, as the SQL has them."""
    o = a.table(spark, sf_dir, "orders")
    late = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") * 7)
    return o.select(
        F.col("o_orderkey").alias("id"), texts.percent_label(F.col("o_totalprice") / 7919.0, even=True).alias("percent"), texts.compact(F.col("o_totalprice"), even=True).alias("large"), texts.compact(F.col("o_custkey") / 8.0, even=True).alias("small"),
        texts.milliseconds(late, even=True).alias("late"), texts.iso_time(F.col("o_orderkey") * 100003).alias("iso"))


_SMALL = "rtrim(rtrim(printf('%.3f', o_custkey / 8.0), '0'), '.')"
NUMBERS = f"""SELECT o_orderkey AS id, printf('%.1f', o_totalprice / 7919.0) || '%' AS percent, CASE WHEN o_totalprice >= 10000 THEN printf('%.0f', o_totalprice / 1000) || ' K' WHEN o_totalprice >= 1000 THEN printf('%.1f', o_totalprice / 1000) || ' K' ELSE rtrim(rtrim(printf('%.3f', o_totalprice), '0'), '.') END AS large,
CASE WHEN o_custkey / 8.0 >= 1000 THEN printf('%.1f', o_custkey / 8000.0) || ' K' ELSE {_SMALL} END AS small, {_ms("CASE WHEN o_custkey % 10 <> 0 THEN o_custkey * 7 END")} AS late, strftime(to_timestamp(o_orderkey * 100003) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM orders"""


def effort_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning efforts as runs ask for them, and the settings they stand for; and statuses as phases."""
    asked = F.element_at(F.array(F.lit(" HIGH "), F.lit(None).cast("string"), F.lit("none"), F.lit("Minimal"), F.lit("xhigh")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    told = F.element_at(F.array(F.lit("running now"), F.lit("POST /x"), F.lit("stream opened (200)"), F.lit("first stream bytes"), F.lit("retrying without streaming"), F.lit("else")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), texts.effort(asked).alias("effort"), texts.reasoning_config(asked).alias("c"), texts.phase(told).alias("phase"), events.status_text(told, F.col("o_orderpriority")).alias("line"))
    return rows.select("id", "effort", "c.enabled", "c.exclude", F.col("c.effort").alias("sent"), "phase", "line")


EFFORTS = """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS f, o_orderkey % 6 AS s, o_orderpriority AS p FROM orders), t AS (SELECT *, ['high', 'medium', 'none', 'minimal', 'xhigh'][CAST(f + 1 AS INTEGER)] AS effort,
['running now', 'POST /x', 'stream opened (200)', 'first stream bytes', 'retrying without streaming', 'else'][CAST(s + 1 AS INTEGER)] AS status FROM o)
SELECT id, effort, CASE WHEN f <> 2 THEN true END AS enabled, CASE WHEN f <> 2 THEN false END AS exclude, CASE WHEN f <> 2 THEN effort END AS sent,
CASE s WHEN 1 THEN 'contacting API' WHEN 2 THEN 'stream opened' WHEN 3 THEN 'waiting for model output' WHEN 4 THEN 'waiting for model output' ELSE status END AS phase, status || ': ' || p || chr(10) AS line FROM t"""


QUERIES = {
    board_cells: CELLS, board_lines: LINES, board_anchors: ANCHORS, board_overlays: OVERLAYS, position_keys: KEYS, board_moves: MOVES, evaluate_boards: EVALUATED, reply_payloads: PAYLOADS, agent_lines: AGENT_LINES,
    part_lines: PART_LINES, provider_answers: ANSWERS, final_answers: FINAL, agent_outputs: OUTPUTS, synthetic_traces: SYNTHETIC, retry_hints: HINTS, retry_messages: MESSAGES, trace_lines: TRACE_LINES,
    model_gaps: GAPS, number_labels: NUMBERS, effort_settings: EFFORTS,
}
