"""Operator 10: benchmark passages in documents, found by spaced seeds.

Fixed masks read five of eight consecutive words and ignore the others. A mask's hash of every second document position meets
the hashes of every benchmark position; around each meeting the two texts are compared word by word, so substituted words
don't hide a passage. A document is contaminated if, at one alignment with an item, at least ``NEED`` of ``REGION`` consecutive
words are equal, or, of an item with fewer words, all of them. The masks and the stride guarantee a meeting in every such region (each way
to choose the substituted words was enumerated; the tests do so again), so nothing is lost against comparing all positions. Native
throughout.

Defined cases: null or empty text is clean; benchmark items under ``LEAST`` words, which a document may well have by chance, or null, are
no evidence; repeated rows and items are judged alike, and equal texts share one verdict; rows with a null doc_id are judged too; further columns
stay. A text of any length is searched whole, its words as an array in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilegrid.llm.shared import ascii_lower, let, packed, unpacked, words, written

REGION, NEED = 13, 11
#: Offsets of the words that a mask reads.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 2, 6, 7))
SPAN = 8
#: Document positions that are hashed: every second.
STRIDE = 2
#: Words of an item, so that some document position that is hashed begins a span within it.
LEAST = SPAN + STRIDE - 1
#: Rows of benchmark seeds (about 60 bytes each) and bytes of benchmark texts up to which they are broadcast; beyond, the join shuffles.
MOST_SEEDS, MOST_BYTES = 1_000_000, 32 << 20


def tokens(text: Column) -> Column:
    return words(ascii_lower(text))


def _seeds(hashes: Column, stride: int) -> Column:
    """Array of (at, seed) for all masks at every ``stride``-th position."""
    at = F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(0), F.size(hashes) - SPAN, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    each = lambda i: F.array(*(F.struct(i.alias("at"), F.xxhash64(F.lit(n), *(F.get(hashes, i + x) for x in mask)).alias("seed")) for n, mask in enumerate(MASKS)))
    return F.flatten(F.transform(at, each))


def seeds(df: DataFrame, keys: list[Column], stride: int) -> DataFrame:
    """``keys``, the text's words, and a row for each seed.

    The words stay a column of the exploded rows: explode and a broadcast join run in one generated loop, so they are copied only where
    a seed is known.
    """
    made = let(tokens(F.col("text")), lambda w: F.struct(w.alias("words"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _seeds(h, stride)).alias("seeds")))
    rows = df.select(*keys, made.alias("m")).select("*", "m.words", "m.seeds").drop("m")
    return rows.select("*", F.explode("seeds").alias("s")).select("*", "s.at", "s.seed").drop("s", "seeds")


def _aligned(words: str) -> Column:
    """The words of a document against the words of an item, at a shift."""
    return F.slice(words, F.greatest(F.lit(0), F.col("shift")) + 1, F.col("length"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, most_seeds: int = MOST_SEEDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, items): md5 of each contaminated text, and the sorted ids of the items in it."""
    items = benchmark.where(F.size(words(F.col("text"))) >= LEAST).select("item_id", "text")
    known = seeds(items, [F.col("item_id"), F.md5("text").alias("item_key")], 1).select("item_id", "item_key", F.col("at").alias("item_at"), "seed").distinct()
    item_words = items.select("item_id", F.md5("text").alias("item_key"), tokens(F.col("text")).alias("item_words")).distinct()
    rows = docs.where(F.length("text") > 0).select("text")
    shift = {"shift": F.col("at") - F.col("item_at")}
    length = {"length": F.least(F.size("item_words"), F.size("words") - F.col("shift")) - F.greatest(F.lit(0), -F.col("shift"))}
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= most_bytes and known.limit(most_seeds + 1).count() <= most_seeds:
        found = seeds(rows, [F.md5("text").alias("key")], STRIDE).join(F.broadcast(known), "seed").withColumns(shift).join(F.broadcast(item_words), ["item_id", "item_key"]).withColumns(length)
    else:  # seeds alone are shuffled; then the words come in for the texts that have hits
        seen = seeds(rows, [F.md5("text").alias("key")], STRIDE).select("key", "at", "seed")
        hits = written(seen.join(known, "seed").withColumns(shift).select("key", "item_id", "item_key", "shift").distinct(), "decontam-hits")
        texts = rows.withColumn("key", F.md5("text")).join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        found = hits.join(item_words, ["item_id", "item_key"]).join(texts.select("key", tokens(F.col("text")).alias("words")), "key").withColumns(length)
    item_part = F.slice("item_words", F.greatest(F.lit(0), -F.col("shift")) + 1, F.col("length"))
    n = F.size("item_words")
    possible = F.when(n < REGION, F.col("length") == n).otherwise(F.col("length") >= NEED)
    near = found.where(possible).select("key", "item_id", "item_key", "shift", n.alias("n"), item_part.alias("item_part"), _aligned("words").alias("part"))
    near = near.groupBy("key", "item_id", "item_key", "shift").agg(F.first("n").alias("n"), F.first("item_part").alias("item_part"), F.first("part").alias("part"))
    same = F.zip_with("item_part", "part", lambda a, b: (a == b).cast("int"))
    region = lambda m: F.exists(F.sequence(F.lit(1), F.size(m)), lambda i: F.aggregate(F.slice(m, i, REGION), F.lit(0), lambda n, x: n + x) >= NEED)
    enough = lambda m: F.when(F.aggregate(m, F.lit(0), lambda n, x: n + x) >= NEED, region(m)).otherwise(False)
    alike = F.when(F.col("n") < REGION, F.col("item_part") == F.col("part")).otherwise(let(same, enough))
    return near.where(alike).groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, most_seeds: int = MOST_SEEDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``items`` (benchmark ids found in its text, sorted) and ``contaminated``."""
    found = written(contaminated_texts(docs, benchmark, most_seeds, most_bytes), "decontam").withColumnRenamed("items", "found")
    judged = packed(docs, key=F.md5("text")).join(found, "key", "left")
    none = F.array().cast(dict(found.dtypes)["found"])
    return judged.select(*unpacked(docs, ("items", "contaminated")), F.coalesce("found", none).alias("items"), F.col("found").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns."""
    found = written(contaminated_texts(docs, benchmark), "decontam")
    return packed(docs, key=F.md5("text")).join(found, "key", "left_anti").select(*unpacked(docs))
