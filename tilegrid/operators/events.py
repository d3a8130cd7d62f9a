"""Lines of agents and providers as (text, channel, event_type), from one ordered choice per line and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilegrid.functions.payload import text_of
from tilegrid.functions.texts import shortened
from tilegrid.operators.board import let
from tilegrid.operators.traces import STALL_SECONDS

# Kinds of items that hold an answer, and that hold reasoning.
ANSWERS, THOUGHTS = ("agent_message", "assistant_message", "message"), ("reasoning", "thought", "thinking")
# Events with a text of their own.
LIFECYCLE = {"thread.started": "thread started", "turn.started": "turn started", "turn.completed": "turn completed", "turn.failed": "turn failed"}


def _string(v: Column, path: str) -> Column:
    """A field that is a non-empty string, else null."""
    return F.nullif(F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")), F.lit(""))


def _scalar(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _thinks(kind: Column) -> Column:
    return F.contains(kind, F.lit("reason")) | F.contains(kind, F.lit("think"))


def _crumb(event: Column, has_item: Column, v: Column) -> Column:
    """A short account of an event without text."""
    kind, status = _scalar(v, "$.item.type"), _scalar(v, "$.item.status")
    plain = F.replace(event, F.lit("."), F.lit(" "))
    step = F.coalesce(F.nullif(F.replace(F.replace(event, F.lit("item."), F.lit("")), F.lit("."), F.lit(" ")), F.lit("")), F.lit("item"))
    label = F.coalesce(F.nullif(status, F.lit("")), step)
    command, path = F.trim(_scalar(v, "$.item.command")), F.coalesce(F.nullif(_scalar(v, "$.item.path"), F.lit("")), _scalar(v, "$.item.file"))
    item = (
        F.when(kind == "command_execution", F.concat(F.lit("command "), label, F.when(command != "", F.concat(F.lit(": "), shortened(command, 120))).otherwise("")))
        .when(kind == "file_change", F.concat(F.lit("file change ("), label, F.lit(")"), F.when(path != "", F.concat(F.lit(": "), path)).otherwise("")))
        .when(kind == "todo_list", F.concat(F.lit("todo list "), step))
        .when((kind != "") & ~kind.isin(*ANSWERS), F.trim(F.concat(kind, F.lit(" "), step)))
        .when((event != "") & ~event.isin("item.completed", "agent_message", "message"), plain)
        .otherwise("")
    )
    out = F.when(has_item, item).otherwise(plain)
    for name, text in LIFECYCLE.items():
        out = F.when(event == name, text).otherwise(out)
    return out


def agent_event(line: Column) -> Column:
    """(text, channel, event_type) of an agent's line; lines that aren't JSON are content."""
    return let(F.try_parse_json(line), lambda v: _agent_event(line, v))


def _agent_event(line: Column, v: Column) -> Column:
    shape = F.schema_of_variant(v)
    event, kind = _scalar(v, "$.type"), _scalar(v, "$.item.type")
    has_item = F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.item", "variant")), F.lit("")), F.lit("OBJECT"))
    item_text = F.coalesce(_string(v, "$.item.text"), _string(v, "$.item.content"), _string(v, "$.item.message"))
    message, text, last = _string(v, "$.message"), _string(v, "$.text"), _string(v, "$.last_agent_message")
    crumb = F.nullif(_crumb(event, has_item, v), F.lit(""))
    named = F.coalesce(F.nullif(kind, F.lit("")), event)
    made = lambda words, channel, name: F.struct(F.coalesce(words, F.lit("")).alias("text"), (channel if isinstance(channel, Column) else F.lit(channel)).alias("channel"), (name if isinstance(name, Column) else F.lit(name)).alias("event_type"))
    side = F.when(_thinks(event), "reasoning").otherwise("content")
    other = F.coalesce(F.nullif(event, F.lit("")), F.lit("message"))
    return (
        F.when(v.isNull(), made(F.trim(line), "content", "stdout"))
        .when(~F.startswith(shape, F.lit("OBJECT")), made(F.lit(""), "content", "stdout"))
        .when(last.isNotNull(), made(last, "content", "last_agent_message"))
        .when(has_item & kind.isin(*ANSWERS) & item_text.isNotNull(), made(item_text, "content", named))
        .when(has_item & (kind.isin(*THOUGHTS) | _thinks(kind)) & item_text.isNotNull(), made(item_text, "reasoning", named))
        .when(has_item, made(crumb, "reasoning", named))
        .when(event.isin(*ANSWERS) & F.coalesce(message, text).isNotNull(), made(F.coalesce(message, text), "content", event))
        .when((event == "error") & message.isNotNull(), made(F.when(~F.startswith(F.lower(message), F.lit("reconnecting")), message), "reasoning", event))
        .when(crumb.isNotNull(), made(crumb, "reasoning", F.coalesce(F.nullif(event, F.lit("")), F.lit("status"))))
        .when(message.isNotNull(), made(message, side, other))
        .when(text.isNotNull(), made(text, side, other))
        .otherwise(made(F.lit(""), "reasoning", event))
    )


def part_event(line: Column) -> Column:
    """(text, channel, event_type) of a line whose text is in a part, in ``text`` or in ``content``."""
    v = F.try_parse_json(line)
    event = _scalar(v, "$.type")
    text = F.coalesce(_string(v, "$.part.text"), _string(v, "$.text"), _string(v, "$.content"), F.lit(""))
    read = F.struct(text.alias("text"), F.when(_thinks(event), "reasoning").otherwise("content").alias("channel"), event.alias("event_type"))
    return F.when(v.isNull(), F.struct(line.alias("text"), F.lit("content").alias("channel"), F.lit("stdout").alias("event_type"))).otherwise(read)


def provider_chunks(lines: DataFrame) -> DataFrame:
    """key, seq, content, reasoning, usage, provider, error of the ``data:`` lines of a provider's stream. ``lines``: key, seq, line."""
    data = F.trim(F.substring("line", 6, 1 << 30))
    rows = lines.where(F.startswith("line", F.lit("data:"))).select("key", "seq", data.alias("data")).where("data <> '' AND data <> '[DONE]'").withColumn("v", F.try_parse_json("data"))
    get = lambda path: F.try_variant_get("v", path, "variant")
    said = F.nullif(text_of(get("$.choices[0].delta.content")), F.lit(""))
    thought = F.coalesce(F.nullif(text_of(get("$.choices[0].delta.reasoning")), F.lit("")), F.nullif(text_of(get("$.choices[0].delta.reasoning_content")), F.lit("")))
    return rows.select(
        "key", "seq", said.alias("content"), thought.alias("reasoning"), F.try_variant_get("v", "$.usage.total_tokens", "int").alias("total_tokens"),
        F.try_variant_get("v", "$.provider", "string").alias("provider"),
        F.when(get("$.error").isNotNull(), F.coalesce(F.try_variant_get("v", "$.error.message", "string"), F.lit("Streaming error from the provider."))).alias("error"))


def provider_answer(chunks: DataFrame) -> DataFrame:
    """key, content, reasoning, total_tokens (the last given), provider (the last given), error (the first) of each stream."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c]), "")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return chunks.groupBy("key").agg(text("content").alias("content"), text("reasoning").alias("reasoning"), last("total_tokens").alias("total_tokens"), last("provider").alias("provider"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"))


def streamed_answers(lines: DataFrame, stall_ms: int = 1000 * STALL_SECONDS) -> DataFrame:
    """What a gateway's stream comes to, line by line as it was received. ``lines``: key, seq, line, at_ms (since the request).

    key, outcome, content, reasoning, total_tokens (the last given), events: the trace. A stream ends with its last line (``streamed``), with the first line that tells an error or can't be
    read, or with the first line that comes more than ``stall_ms`` after the last output of the model (at first, after the first line). A stall, and an error before any output, ask for the
    answer to be fetched at once instead (``fallback``); an error after some output is a failure (``failed``). What came before is kept.
    """
    order = Window.partitionBy("key").orderBy("seq")
    data = F.when(F.startswith("line", F.lit("data:")), F.nullif(F.trim(F.substring("line", 6, 1 << 30)), F.lit("")))
    rows = lines.select("key", "seq", "at_ms", F.nullif(data, F.lit("[DONE]")).alias("data")).withColumn("v", F.try_parse_json("data"))
    get = lambda path: F.try_variant_get("v", path, "variant")
    said = F.nullif(text_of(get("$.choices[0].delta.content")), F.lit(""))
    thought = F.coalesce(*(F.nullif(text_of(get(f"$.choices[0].delta.{c}")), F.lit("")) for c in ("reasoning", "reasoning_content")))
    wrong = F.col("data").isNotNull() & (F.col("v").isNull() | get("$.error").isNotNull())
    rows = rows.select("key", "seq", "at_ms", said.alias("content"), thought.alias("reasoning"), F.try_variant_get("v", "$.usage.total_tokens", "int").alias("total_tokens"), wrong.alias("wrong"))
    spoke = F.coalesce("content", "reasoning").isNotNull()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"last": F.last(F.when(spoke, F.col("at_ms")), ignorenulls=True).over(before), "opened": F.first("at_ms").over(order)})
    rows = rows.withColumn("stalled", F.col("at_ms") - F.coalesce("last", "opened") > stall_ms)
    rows = rows.withColumn("broken", F.max(F.col("stalled") | F.col("wrong")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept, first = ~F.col("broken"), F.col("broken") & ~F.coalesce(F.lag("broken").over(order), F.lit(False))
    event = lambda kind, at, delta=None, chars=None: F.struct(F.lit(kind).alias("type"), at.cast("int").alias("elapsed_ms"), *((F.lit(None) if x is None else x).cast("int").alias(n) for x, n in ((delta, "delta_ms"), (chars, "chars"))))
    delta = lambda c, since: F.when(F.col(c).isNotNull(), event(f"{c}_delta", F.col("at_ms"), since, F.length(c)))
    since = F.col("at_ms") - F.coalesce("last", F.lit(0))
    told = F.filter(F.array(delta("content", since), delta("reasoning", F.when(F.col("content").isNull(), since).otherwise(0))), lambda e: e.isNotNull())
    rows = rows.withColumns({"told": F.when(kept, told), "end": F.when(first, F.when(F.col("stalled"), "stalled").otherwise("wrong"))})
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept & F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c]), "")
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("seq", "told")))), lambda x: x.told))
    out = rows.groupBy("key").agg(
        F.max("end").alias("end"), text("content").alias("content"), text("reasoning").alias("reasoning"), F.max_by("total_tokens", F.when(kept & F.col("total_tokens").isNotNull(), F.col("seq"))).alias("total_tokens"),
        listed.alias("told"), F.min("opened").alias("opened"), F.max("at_ms").alias("closed"))
    nothing = (F.col("content") == "") & (F.col("reasoning") == "")
    outcome = F.when(F.col("end").isNull(), "streamed").when((F.col("end") == "stalled") | nothing, "fallback").otherwise("failed")
    head = F.array(event("request_sent", F.lit(0)), event("stream_opened", F.col("opened")), event("first_stream_bytes", F.col("opened")))
    tail = F.when(F.col("end").isNull(), F.array(event("stream_done", F.col("closed")))).otherwise(F.array().cast("array<struct<type:string,elapsed_ms:int,delta_ms:int,chars:int>>"))
    return out.select("key", outcome.alias("outcome"), "content", "reasoning", "total_tokens", F.concat(head, "told", tail).alias("events"))


def final_answer(events: DataFrame) -> DataFrame:
    """key, text: the last complete answer of each key; a closing repetition counts only if nothing came before. ``events``: key, seq, text, channel, event_type."""
    said = events.where((F.col("channel") == "content") & (F.col("text") != ""))
    closing = F.col("event_type") == "last_agent_message"
    return said.groupBy("key").agg(F.coalesce(F.max_by("text", F.when(~closing, F.col("seq"))), F.max_by("text", "seq")).alias("text"))


def synthetic_events(content: Column, reasoning: Column, latency: Column) -> Column:
    """The events that stand for an answer that came at once."""
    event = lambda kind, at, chars: F.struct(F.lit(kind).alias("type"), at.cast("int").alias("elapsed_ms"), F.when(chars.isNotNull(), at).cast("int").alias("delta_ms"), chars.cast("int").alias("chars"))
    none = F.lit(None).cast("int")
    told = F.array(event("request_sent", F.lit(0), none), event("non_stream_response", latency, none), F.when(F.length(reasoning) > 0, event("reasoning_delta", latency, F.length(reasoning))), F.when(F.length(content) > 0, event("content_delta", latency, F.length(content))))
    return F.filter(told, lambda e: e.isNotNull())


def output_text(lines: DataFrame) -> DataFrame:
    """key, text of an agent's whole output: its text parts together, else the last other text, else the output itself. ``lines``: key, seq, line."""
    v = F.try_parse_json("line")
    part = F.when(_scalar(v, "$.type") == "text", _string(v, "$.part.text"))
    other = F.coalesce(*(F.nullif(F.trim(_string(v, path)), F.lit("")) for path in ("$.message.content", "$.content", "$.text")))
    rows = lines.select("key", "seq", "line", part.alias("part"), other.alias("other"))
    joined = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c]), by)
    out = rows.groupBy("key").agg(F.nullif(F.trim(joined("part", "")), F.lit("")).alias("parts"), F.max_by("other", F.when(F.col("other").isNotNull(), F.col("seq"))).alias("other"), F.trim(joined("line", "\n")).alias("all"))
    return out.select("key", F.coalesce("parts", "other", "all").alias("text"))


def status_text(status: Column, detail: Column) -> Column:
    """A status as a line of the reasoning channel."""
    told = F.when(F.coalesce(detail, F.lit("")) == "", status).otherwise(F.concat(status, F.lit(": "), shortened(detail, 240)))
    return F.when(F.endswith(told, F.lit("\n")), told).otherwise(F.concat(told, F.lit("\n")))


def replayed(lines: DataFrame) -> DataFrame:
    """key, seq, text, channel, event_type of a process's two outputs in the order they came: answers and thoughts from ``stdout``, and ``stderr`` as status lines
    of the reasoning. ``lines``: key, seq, stream, line."""
    told = F.struct(status_text(F.lit("stderr"), F.trim("line")).alias("text"), F.lit("reasoning").alias("channel"), F.lit("stderr").alias("event_type"))
    event = F.when(F.col("stream") == "stderr", told).otherwise(agent_event(F.col("line")))
    return lines.select("key", "seq", event.alias("e")).select("key", "seq", "e.text", "e.channel", "e.event_type")
