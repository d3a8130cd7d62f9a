"""Operator 7: quality rules with thresholds that follow each language and source.

Fixed cutoffs are replaced by upper fences, ``q75 + reach * max(q75 - q25, least)``, read from KLL quantile sketches of each
measure per (lang, source). Sketches merge: a source with few rows takes its language's fence, a language with few rows that of
the whole corpus, both merged from the leaves' sketches without reading a row again. All of it is native: no Python runs on
executors.

Defined cases: null or empty text has no words, so it fails the base rules; null ``lang`` or ``source`` counts as a language or
source of its own; repeated rows are judged each by itself; an empty table gives an empty result; further columns are ignored. A text of any
length is judged whole, its words and windows as arrays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilegrid.llm.shared import SPACE, let, small, words, written

#: Words in a window whose repetition counts.
WINDOW = 5
#: Pairs (lang, source) up to which their fences are broadcast (60 bytes each); beyond, the join shuffles.
MOST_FENCES = 100_000
#: Rows that a (lang, source) or a language needs for fences of its own.
ENOUGH = 200
#: Size parameter of the sketches: rank errors of about 0.3 %; up to so many values a sketch is exact.
SKETCH_K = 1024
#: How many spreads above the upper quartile a measure may lie.
REACH = 3.0
#: Measure: its least spread, so that a group of equal values doesn't reject all others.
MEASURES = {"symbol_share": 0.02, "dup_line_share": 0.1, "repeat_share": 0.05, "mean_word": 1.0}


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more."""
    windows = F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))))

    def covered(all_windows: Column) -> Column:
        order = F.array_sort(F.transform(all_windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(order, lambda o: F.transform(F.filter(F.transform(o, lambda s, k: F.when((s.x == F.get(o, k - 1).x) | (s.x == F.get(o, k + 1).x), s.i)), lambda i: i.isNotNull()), lambda i: i))
        gaps = let(F.array_sort(twice), lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    return F.coalesce(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)), F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with its text replaced by the counts that the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    body = let(words(text), lambda w: F.struct(
        F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
        let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("n_repeat_words")))
    row = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                      body.alias("b"), lines.alias("l"), (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).alias("n_symbols"))
    count = {"n_words": F.col("b.n_words"), "word_chars": F.col("b.word_chars"), "n_symbols": F.col("n_symbols"), "n_dup_lines": F.col("l.n") - F.col("l.d"), "n_repeat_words": F.col("b.n_repeat_words"), "n_lines": F.col("l.n")}
    return row.select("doc_id", "lang", "source", *(c.cast("long").alias(name) for name, c in count.items()))


def with_shares(rows: DataFrame) -> DataFrame:
    """Counts as shares of a text's size, and whether the base rules reject it."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words"),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})


def fences(rows: DataFrame, enough: int = ENOUGH, k: int = SKETCH_K, reach: float = REACH) -> DataFrame:
    """Upper fences per (lang, source), from the rows that pass the base rules; one row for each pair that occurs."""
    sketches = [F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in MEASURES]
    merged = [F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in MEASURES]
    leaf = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"), *sketches)
    lang = leaf.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    whole = lang.agg(F.sum("n").alias("n"), *merged)

    def read(df: DataFrame, level: str) -> DataFrame:
        def fence(m: str) -> Column:
            q = lambda r: F.kll_sketch_get_quantile_double(F.col(m), F.lit(r))
            return q(0.75) + reach * F.greatest(q(0.75) - q(0.25), F.lit(MEASURES[m]))

        keys = [c for c in ("lang", "source") if c in df.columns]
        return df.where(F.col("n") > 0).select(*keys, F.struct(F.col("n"), *(fence(m).alias(m) for m in MEASURES)).alias(level))

    pairs = rows.groupBy("lang", "source").agg(F.count("*").alias("n_rows"))
    out = pairs.join(read(leaf, "leaf"), ["lang", "source"], "left").join(read(lang, "by_lang"), "lang", "left").join(read(whole, "whole"), F.lit(True), "left")
    best = F.when(F.col("leaf.n") >= enough, F.col("leaf")).when(F.col("by_lang.n") >= enough, F.col("by_lang")).otherwise(F.col("whole"))
    return out.select("lang", "source", best.alias("fence"))


def quality_rules(docs: DataFrame, enough: int = ENOUGH, k: int = SKETCH_K, reach: float = REACH) -> DataFrame:
    """Counts and verdict of every row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``kept`` is false where the base rules fail (under 10 words, or more than a fifth of the words in repeated windows) or a
    measure lies above its fence.
    """
    rows = with_shares(written(measures(docs), "rules"))
    limits = small(written(fences(rows, enough, k, reach), "rule-fences"), MOST_FENCES)
    judged = rows.join(limits, ["lang", "source"], "left")
    above = [F.coalesce(F.col(m) > F.col(f"fence.{m}"), F.lit(False)) for m in MEASURES]
    verdict = ~F.col("base_failed")
    for x in above:
        verdict = verdict & ~x
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"))
