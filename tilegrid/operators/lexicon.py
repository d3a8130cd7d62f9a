"""Word lists: reading, filtering, membership, and words that a rack can spell."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tilegrid.operators import walk
from tilegrid.operators.automaton import Graph, broadcast_graph

#: Word lists in the order in which they are looked for.
CANDIDATES = ("data/lexicon/NWL23.txt", "data/lexicon/ENABLE.txt", "/usr/share/dict/american-english", "/usr/share/dict/words")
#: Lists that are taken whole; of others the first ``TRUNCATED`` words of 2 to 8 letters.
FULL_LISTS, TRUNCATED = ("NWL23.txt", "ENABLE.txt"), 12_000

#: A lexicon of at most so many rows is broadcast to the words that are looked up; how many tasks else share a word's rows.
MOST_HELD, SLICES = 1_000_000, 32


def build(lines: DataFrame, full: bool) -> DataFrame:
    """word of each line of text that is one, in upper case, once. ``lines``: value."""
    word = F.upper(F.trim("value"))
    words = lines.select(word.alias("word")).where(F.col("word").rlike("^[A-Z]+$") & (F.length("word") <= 15)).distinct()
    return words if full else words.where(F.length("word").between(2, 8)).orderBy("word").limit(TRUNCATED)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The word list at ``path``; a list without a word is an error."""
    words = build(spark.read.text(path), Path(path).name in FULL_LISTS)
    if words.isEmpty():
        raise ValueError(f"Lexicon at {path} did not yield any usable words.")
    return words


def first_existing(candidates: list[str] | tuple[str, ...] = CANDIDATES) -> str:
    """The first path that exists."""
    for path in candidates:
        if Path(path).exists():
            return path
    raise FileNotFoundError("no word list among: " + ", ".join(candidates))


def valid(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows whose ``word``, in upper case, is in the lexicon."""
    return _looked_up(words, lexicon, "left_semi")


def invalid(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows whose ``word``, in upper case, isn't in the lexicon."""
    return _looked_up(words, lexicon, "left_anti")


def _looked_up(words: DataFrame, lexicon: DataFrame, how: str) -> DataFrame:
    """Words stay where they are if the lexicon is small. Else they are dealt by word and, as few words make up most of a text, each word's rows over ``SLICES`` tasks."""
    keyed, known = words.withColumn("_word", F.upper("word")), lexicon.select(F.col("word").alias("_word"))
    if known.limit(MOST_HELD + 1).count() <= MOST_HELD:
        return keyed.join(F.broadcast(known), "_word", how).drop("_word")
    sliced = keyed.withColumn("_slice", F.pmod(F.xxhash64(*(F.col(c) for c in words.columns)), F.lit(SLICES)).cast("int"))
    every = known.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    return sliced.join(every, ["_word", "_slice"], how).drop("_word", "_slice")


def letter_counts(text: Column) -> Column:
    """Array of (letter, n) of a rack or word, by letter; ``?`` comes first."""
    letters = F.array_sort(F.filter(F.split(F.upper(text), ""), lambda x: x != ""))
    return F.transform(F.array_distinct(letters), lambda x: F.struct(x.alias("letter"), F.size(F.filter(letters, lambda y: y == x)).alias("n")))


def sorted_rack(rack: Column) -> Column:
    return F.array_join(F.array_sort(F.split(rack, "")), "")


def blanks_needed(word: Column, rack: Column) -> Column:
    """How many letters of ``word`` ``rack`` lacks."""
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, letter, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(word, "")), F.lit(0), lambda n, x: n + F.greatest(F.lit(0), count(word, x) - count(rack, x)))


def _subsets(text: Column) -> Column:
    """All sub-multisets of a sorted text, as sorted texts."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    return F.aggregate(letters, F.array(F.lit("")), lambda sets, x: F.array_distinct(F.concat(sets, F.transform(sets, lambda s: F.concat(s, x)))))


def _without(text: Column, n: Column) -> Column:
    """What ``text`` can become by leaving out ``n`` of its letters."""
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.overlay(s, F.lit(""), i, F.lit(1)))
    shorter = F.aggregate(F.sequence(F.lit(1), n), F.array(text), lambda sets, _: F.array_distinct(F.flatten(F.transform(sets, cut))))
    return F.when(n == 0, F.array(text)).otherwise(shorter)


def feasible(racks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """rack_id, word of the words that each rack, of any size, can spell, blanks standing for any letter. Racks walk the word graph; a lexicon too large for one is joined."""
    sent = broadcast_graph(lexicon)
    if sent is None:
        return joined_feasible(racks, lexicon)
    rows = racks.select("rack_id", F.upper(F.coalesce("rack", F.lit(""))).alias("rack"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(sent.value)
        for batch in batches:
            for i, rack in enumerate(batch.column("rack").to_pylist()):
                words = walk.spelled(graph, rack)
                yield pa.RecordBatch.from_arrays([batch.column("rack_id").take(pa.array([i] * len(words), pa.int64())), pa.array(words, pa.string())], ["rack_id", "word"])

    schema = StructType([StructField("rack_id", rows.schema["rack_id"].dataType), StructField("word", StringType())])
    return rows.mapInArrow(run, schema).distinct()


def joined_feasible(racks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """As ``feasible``, for lexicons of any size and racks of up to about 15 different tiles.

    Racks are joined with words by sorted subsets of their tiles, as many as 2 to the power of their different tiles, so no rack meets a word that it
    can't spell: a word is looked up with as many letters left out as blanks could stand for. The longest rack and the most blanks, one row,
    bound the words and what is left out.
    """
    real = F.replace(sorted_rack(F.upper("rack")), F.lit("?"), F.lit(""))
    blanks = F.length("rack") - F.length(F.replace("rack", F.lit("?"), F.lit("")))
    own = racks.select("rack_id", blanks.alias("blanks"), F.explode(_subsets(real)).alias("part"))
    limits = racks.agg(F.max(F.length("rack")).alias("longest"), F.max(blanks).alias("most"))
    words = lexicon.where("word <> ''").select("word", sorted_rack(F.col("word")).alias("letters")).join(F.broadcast(limits), F.length("word") <= F.col("longest"))  # one row
    lacking = words.select("word", "letters", F.explode(F.sequence(F.lit(0), F.least("most", F.length("letters")))).alias("lacking"))
    lacking = lacking.select("word", "lacking", F.explode(_without(F.col("letters"), F.col("lacking"))).alias("part"))
    return own.join(lacking, "part").where(F.col("lacking") <= F.col("blanks")).select("rack_id", "word").distinct()


def cross_checks(gaps: DataFrame, lexicon: DataFrame) -> DataFrame:
    """gap_id, letters: which letters make words between ``before`` and ``after``; all 26 if both are empty."""
    letters = F.explode(F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")).alias("letter")
    tried = gaps.select("gap_id", "before", "after", letters).where("letter <> ''").withColumn("word", F.concat("before", "letter", "after"))
    free = tried.where((F.length("before") == 0) & (F.length("after") == 0)).select("gap_id", "letter")
    held = tried.where((F.length("before") > 0) | (F.length("after") > 0)).join(lexicon.select("word"), "word", "left_semi").select("gap_id", "letter")
    found = free.union(held).groupBy("gap_id").agg(F.array_join(F.array_sort(F.collect_set("letter")), "").alias("letters"))
    return gaps.select("gap_id").join(found, "gap_id", "left").select("gap_id", F.coalesce("letters", F.lit("")).alias("letters"))
