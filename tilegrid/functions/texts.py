"""Scalar expressions over text: labels, hints, truncation, chunks and number formats."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What an error text contains, and the hint that goes with it; the first that fits counts.
HINTS = (
    ("Rack cannot supply letter", "Use only letters available in the rack. If you need a missing letter, you must consume a ? blank."),
    ("collides with existing tile", "Do not place on top of an occupied square unless the letter already matches there. Return only newly placed tiles."),
    ("No new tiles were provided", "Return at least one newly placed tile. Do not answer with only existing board letters."),
    ("same row or column", "All new placements must lie on one line and form one contiguous word with no gaps."),
    ("gap in its main word", "All new placements must lie on one line and form one contiguous word with no gaps."),
    ("Main word is invalid", "Check the full word formed on the board after your placement, including all touched existing letters."),
    ("Cross word is invalid", "Check the full word formed on the board after your placement, including all touched existing letters."),
    ("Word is invalid", "Check the full word formed on the board after your placement, including all touched existing letters."),
    ("does not connect to the existing board", "Your move must connect to the existing board through adjacency or overlap with matching existing letters."),
)
OTHER_HINT = "Return a legal move using only newly placed tiles and only letters from the rack."
# How a status text begins, and the phase it stands for; null keeps the text.
PHASES = (
    ("running ", None), ("POST ", "contacting API"), ("stream opened", "stream opened"), ("first stream bytes", "waiting for model output"),
    ("retrying without streaming", "waiting for model output"),
)
# Label, background and text colour of companies with a theme of their own, and of all others, whose label is the start of their name.
THEMES = {
    "openai": ("OA", "#17324d", "#edf6ff"), "anthropic": ("AN", "#25405d", "#edf6ff"), "google": ("GO", "#284c73", "#edf6ff"), "meta": ("ME", "#355b87", "#edf6ff"), "qwen": ("QW", "#1f3f69", "#edf6ff"),
    "mistralai": ("MI", "#274868", "#edf6ff"), "microsoft": ("MS", "#1b3654", "#edf6ff"), "deepseek": ("DS", "#0f2b46", "#edf6ff"), "xai": ("xAI", "#1f2937", "#f8fbff"), "z-ai": ("ZA", "#213b58", "#edf6ff"),
    "googlefree": ("GO", "#284c73", "#edf6ff"), "minimax": ("MM", "#24476a", "#edf6ff"), "moonshotai": ("KM", "#24476a", "#edf6ff"), "nvidia": ("NV", "#24476a", "#edf6ff"), "xiaomi": ("XM", "#24476a", "#edf6ff"),
    "unknown": ("??", "#334155", "#f8fbff"),
}
OTHER_THEME = ("#274868", "#edf6ff")
EFFORTS = ("none", "minimal", "low", "medium", "high", "xhigh")


def hint(error: Column) -> Column:
    out = F.lit(OTHER_HINT)
    for part, text in reversed(HINTS):
        out = F.when(F.contains(error, F.lit(part)), text).otherwise(out)
    return out


def phase(status: Column) -> Column:
    out = status
    for start, name in reversed(PHASES):
        out = F.when(F.startswith(status, F.lit(start)), status if name is None else F.lit(name)).otherwise(out)
    return out


def shortened(text: Column, most: int) -> Column:
    """``text``, or its first ``most - 3`` characters and three dots."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def without_company(name: Column) -> Column:
    return F.regexp_replace(name, r"^[^:]+:\s*", "")


def badge(company: Column) -> Column:
    """Label of a company without a theme of its own."""
    return F.coalesce(F.nullif(F.upper(F.left(company, F.lit(2))), F.lit("")), F.lit("??"))


def theme(company: Column) -> Column:
    """(label, bg, fg) of a company's badge."""
    made = lambda label, bg, fg: F.struct(label.alias("label"), F.lit(bg).alias("bg"), F.lit(fg).alias("fg"))
    out = made(badge(company), *OTHER_THEME)
    for name, (label, *colours) in THEMES.items():
        out = F.when(company == name, made(F.lit(label), *colours)).otherwise(out)
    return out


def progress_phase(status: Column, detail: Column) -> Column:
    """What a status event shows as the phase; a detail is cut to 80 characters."""
    own = F.trim(F.coalesce(status, F.lit("")))
    told = F.when(F.coalesce(detail, F.lit("")) == "", own).otherwise(F.concat(own, F.lit(": "), F.left(detail, F.lit(80))))
    return F.when(own != "", told)


def clamped(value: Column, low: int, high: int) -> Column:
    """``value``, rounded down, within bounds; ``low`` for null."""
    return F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), F.floor(value))).cast("int"), F.lit(low))


def whole_or_zero(value: Column) -> Column:
    """A count given as text or number; 0 where there is none."""
    return F.coalesce(value.cast("string").try_cast("int"), F.lit(0))


def chunks(text: Column) -> Column:
    """Words with the space after them; an empty text has none."""
    parts = F.split(text, " ", -1)
    return F.when(F.length(text) > 0, F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit(" "))).otherwise(x))).otherwise(F.array().cast("array<string>"))


def effort(value: Column) -> Column:
    """A reasoning effort in lower case, medium by default; others are an error."""
    out = F.lower(F.trim(F.coalesce(value, F.lit("medium"))))
    return F.when(out.isin(*EFFORTS), out).otherwise(F.raise_error(F.concat(F.lit("Unknown reasoning effort: "), out)))


def reasoning_config(value: Column) -> Column:
    """Null for no reasoning, else (enabled, exclude, effort)."""
    own = effort(value)
    return F.when(own != "none", F.struct(F.lit(True).alias("enabled"), F.lit(False).alias("exclude"), own.alias("effort")))


def date_label(text: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "MMM d, yyyy"), F.lit("Unknown"))


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO time in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


@F.pandas_udf(StringType())
def fixed(values: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A number with so many digits after the point, rounding the exact binary value, which no built-in format does; exact halves go up, or to the even digit."""
    for numbers, digits, even in values:
        rounds = [ROUND_HALF_EVEN if e else ROUND_HALF_UP for e in even]
        yield pd.Series([None if pd.isna(x) else str(Decimal(float(x)).quantize(Decimal(1).scaleb(-int(d)), r)) for x, d, r in zip(numbers, digits, rounds, strict=True)], dtype=object)


def percent_label(value: Column, even: bool = False) -> Column:
    return F.concat(fixed(value, F.lit(1), F.lit(even)), F.lit("%"))


def compact(value: Column, even: bool = False) -> Column:
    """Thousands as ``1.2 K`` or ``12 K``, smaller numbers with grouping and at most three digits. ``even``: exact halves go to the even digit, as in C and SQL, not up, as in the browser."""
    thousands = value / 1000
    digits = F.when(F.abs(thousands) >= 10, 0).otherwise(1)
    return F.when(F.abs(value) >= 1000, F.concat(fixed(thousands, digits, F.lit(even)), F.lit(" K"))).otherwise(F.call_function("format_number", value, F.lit("#,##0.###")))


def milliseconds(value: Column, even: bool = False) -> Column:
    return F.when(value.isNull(), "n/a").when(value >= 1000, F.concat(fixed(value / 1000, F.lit(1), F.lit(even)), F.lit("s"))).otherwise(F.concat(value.cast("string"), F.lit("ms")))


def trace_line(summary: Column, requested: Column) -> Column:
    """The one-line account of an attempt's timing; ``summary`` as ``traces.summary`` makes it."""
    ms = lambda name: milliseconds(summary[name])
    count = lambda name: F.coalesce(summary[name], F.lit(0)).cast("string")
    parts = [
        F.concat(F.lit("requested "), F.coalesce(F.concat(F.nullif(requested, F.lit("")), F.lit(" reasoning")), F.lit("reasoning"))),
        *(F.concat(F.lit(f"{label} "), made) for label, made in (
            ("latency", ms("latency_ms")), ("first reasoning", ms("first_reasoning_ms")), ("first content", ms("first_content_ms")), ("reasoning chars", count("reasoning_chars")),
            ("content chars", count("content_chars")), ("wait before reasoning", ms("wait_before_reasoning_ms")), ("wait before content", ms("wait_before_content_ms")))),
    ]
    return F.when(summary.isNull(), "No timing trace.").otherwise(F.concat_ws(" · ", *parts))


def ticks(low: Column, high: Column, n: int) -> Column:
    """``n + 1`` evenly spaced values from ``low`` to ``high``, with their share of the way."""
    step = lambda i: (low + (high - low) * i / n).alias("value")
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(step(i), F.when(high > low, i / F.lit(float(n))).otherwise(0.0).alias("ratio")))
