"""JSON from model replies: finding it, reading it, and checking its envelope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilegrid.operators.board import let
from tilegrid.schemas import RAW_PLACEMENT

NO_JSON, NO_TOOL, NO_LIST = "Response did not contain JSON.", "Response did not use the play_move tool envelope.", "Tool payload is missing arguments.placements."


def unfenced(text: Column) -> Column:
    """A reply without the code fence around it."""
    text = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    bare = F.regexp_replace(text, "^`+|`+$", "")
    bare = F.when(F.startswith(bare, F.lit("json")), F.regexp_replace(F.substring(bare, 5, 1 << 30), r"^\s+|\s+$", "")).otherwise(bare)
    return F.when(F.startswith(text, F.lit("```")), bare).otherwise(text)


def _whole(text: Column) -> Column:
    """``text`` if all of it is one JSON value, else null: the parser itself would accept text after the value."""
    closed = F.regexp_replace(text, r"\s+$", "")
    fits = F.when(F.startswith(F.ltrim(text), F.lit("{")), F.endswith(closed, F.lit("}"))).when(F.startswith(F.ltrim(text), F.lit("[")), F.endswith(closed, F.lit("]"))).otherwise(True)
    return F.when(fits & F.try_parse_json(text).isNotNull(), text)


def json_in(text: Column) -> Column:
    """The reply's JSON: all of it, or else from its first opening to its last closing brace; null if neither can be read."""
    return let(unfenced(text), _json_in)


def _json_in(bare: Column) -> Column:
    start, end = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    inner = F.when((start > 0) & (F.instr(bare, "}") > 0) & (end > start), F.substr(bare, start, end - start + 1))
    return F.coalesce(_whole(bare), F.when(F.try_parse_json(inner).isNotNull(), inner))


def tool_call(text: Column) -> Column:
    """(error, placements): the placements of a play_move reply, or what is wrong with it."""
    return let(F.try_parse_json(json_in(text)), _tool_call)


def _tool_call(parsed: Column) -> Column:
    tool = F.try_variant_get(parsed, "$.tool", "string")
    listed = F.try_variant_get(parsed, "$.arguments.placements", f"array<{RAW_PLACEMENT}>")
    is_list = F.startswith(F.schema_of_variant(F.try_variant_get(parsed, "$.arguments.placements", "variant")), F.lit("ARRAY"))
    error = F.when(parsed.isNull(), NO_JSON).when(~F.coalesce(tool == "play_move", F.lit(False)), NO_TOOL).when(~F.coalesce(is_list, F.lit(False)), NO_LIST)
    return F.struct(error.alias("error"), F.when(error.isNull(), listed).alias("placements"))


def text_of(value: Column) -> Column:
    """The text of a JSON value: a string, the texts of a list, or the text, content or summary of an object."""
    field = lambda v: F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in ("text", "content", "summary")))
    kind = F.schema_of_variant(value)
    each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), field(v), F.lit("")))
    return F.coalesce(F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), F.array_join(each, "")).otherwise(field(value)), F.lit(""))


def placements_text(text: Column) -> Column:
    """The placements of a reply, for display."""
    return let(tool_call(text), call_text)


def call_text(call: Column) -> Column:
    """The placements of a ``tool_call``, for display."""
    one = lambda p: F.concat(F.lit("("), p.row, F.lit(","), p.col, F.lit(")="), F.upper(p.letter))
    listed = F.array_join(F.transform(F.filter(call.placements, lambda p: p.isNotNull()), one), ", ")
    return F.when(call.error.isNotNull() | call.placements.isNull(), "(could not parse placements from previous response)").when(F.size(call.placements) == 0, "(none)").otherwise(listed)


def details_text(value: Column) -> Column:
    """The summaries of a list of reasoning details, a line each; a summary is a string or a list of texts."""

    def one(v: Column) -> Column:
        summary = F.try_variant_get(v, "$.summary", "variant")
        kind = F.coalesce(F.schema_of_variant(summary), F.lit(""))
        parts = F.filter(F.transform(F.try_variant_get(summary, "$", "array<variant>"), text_of), lambda x: x != "")
        return F.when(kind == "STRING", F.array(F.try_variant_get(summary, "$", "string"))).when(F.startswith(kind, F.lit("ARRAY")), parts).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.array_join(F.filter(F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), one)), lambda x: x != ""), "\n"), F.lit(""))
