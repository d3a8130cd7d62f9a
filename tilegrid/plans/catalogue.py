"""All queries of the engine by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PARTS = ("runs", "words", "logs", "evaluate", "whole", "stores", "shapes")


def _all() -> dict[Callable, str | None]:
    found = {}
    for part in PARTS:
        found |= import_module(f"tilegrid.plans.{part}").QUERIES
    return found


#: Queries whose input is a few rows of their own: the tests run them, but they are not registered. Each has a twin over whole tables.
FIXED = ("anchors", "board_overlay", "board_render", "evaluate_mock", "event_normalise", "move_words", "parse_tool_payload", "premium_grid", "retry_hint", "score_moves")


def fixed() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """The queries of fixed rows, each with its SQL."""
    return {f.__name__: (f, sql) for f, sql in _all().items() if f.__name__ in FIXED}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _all() if f.__name__ not in FIXED}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _all().items() if sql is not None and f.__name__ not in FIXED}
