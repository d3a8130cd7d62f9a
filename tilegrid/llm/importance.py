"""Operator 11: resampling documents towards a target by importance weights of hashed n-grams.

Features are all runs of 1 to ``LONGEST`` words; a feature's bucket is its CRC-32 modulo ``BUCKETS``. Only words are ever hashed:
CRCs of longer runs are composed from theirs (``crc``), so no n-gram is built as a string. Buckets are counted over all documents and
over all texts of the target, each task handing on one row a bucket; the logarithms of the ratios of the smoothed shares are the
buckets' gains, a table of ``BUCKETS`` rows. A document's weight is the mean of its features' gains. Gumbel noise, a hash of the id,
turns the highest scores into a sample without replacement in proportion to the weights' exponentials.

Ranks are found without a global sort: scores are whole numbers, so the documents ahead of a score are a sum over the table of scores,
and only documents of one score are sorted with each other. Noise spreads scores: at most about one document in 2,700 has any one score.

Defined cases: null, empty and wordless texts have no features, weight 0, and can't be drawn if ``LEAST_WORDS`` is 1 or more; an empty target has the
same share in every bucket; a null doc_id has the noise of an empty one and comes last among ties; repeated rows are each scored and may each be drawn,
in any order among themselves; an empty table gives no rows; further columns are ignored. Texts over 2 MB go through in pieces of 1 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilegrid.llm.crc import run_crcs
from tilegrid.llm.kernels import tidied
from tilegrid.llm.shared import bound_batches, small, written

#: Buckets of features; words of the longest run; words that a document needs to be drawn; percent of those that are drawn; seed of the noise.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Different scores up to which their table is broadcast (16 bytes each).
MOST_SCORES = 500_000


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of ``texts`` (text) each bucket has; empty ones are left out."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for crcs, _, _ in run_crcs(batch.column("text"), longest):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    made = texts.select("text").mapInArrow(lambda batches: tidied(run(batches)), "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of all buckets: 1000 times the logarithm of the target's smoothed share over the source's, floored."""
    total = lambda counts, name: counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = both.crossJoin(F.broadcast(total(source, "s_all"))).crossJoin(F.broadcast(total(target, "t_all")))  # a row each
    ratio = (F.col("t") + 1) * (F.col("s_all") + buckets) / ((F.col("s") + 1) * (F.col("t_all") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighted(docs: DataFrame, gains: list[int], longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row. ``gains``: of each bucket."""
    bound_batches(docs.sparkSession)
    table = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            words, features, sums = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for crcs, whose, of_words in run_crcs(batch.column("text"), longest):
                words += np.bincount(of_words, minlength=rows)
                features += np.bincount(whose, minlength=rows)
                sums += np.bincount(whose, table[crcs % np.uint32(len(table))], rows).astype(np.int64)  # whole numbers far below 2**53
            mean = sums // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(mean)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: tidied(run(batches)), "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) of every row of ``docs`` (doc_id, text). ``target``: text."""
    gains = written(bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets), "importance-gains")
    table = [r.gain for r in gains.orderBy("bucket").collect()]  # as many rows as buckets
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    scores = weighted(docs, table, longest).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share))))
    scores = written(scores.withColumn("fit", F.col("n_words") >= least_words), "importance-scores")
    counts = written(scores.where("fit").groupBy("score").agg(F.count("*").alias("n")), "importance-counts")
    drawn = (counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    ahead = counts.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("ahead"), F.lit(True).alias("fit"))  # a row for each score
    places = F.row_number().over(Window.partitionBy("fit", "score").orderBy(F.asc_nulls_last("doc_id"), "n_features"))
    ranked = scores.join(small(ahead.where(F.col("ahead") < drawn), MOST_SCORES), ["score", "fit"], "left")
    rank = F.when(F.col("ahead").isNotNull(), F.col("ahead") + F.when(F.col("ahead").isNotNull(), places))
    return ranked.withColumn("rank", rank).select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
