"""Operator 8: license texts, by canonical digest.

A text is normalised (case, punctuation, white space, copyright lines, equivalent spellings) and the md5 of the whole result is
hash-joined with the digests of known licence texts, normalised alike. The same lookup is made for each single line, which finds
notices such as ``Released under the MIT License.`` inside a document. Texts and lines whose normalised length no known text has
can't match and skip the join. Native throughout.

Defined cases: null and empty texts have the digest of the empty text and match nothing; repeated rows get a row each; rows with a
null doc_id are looked up too; further columns are ignored. A text of any length is normalised whole, its lines as an array in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.llm.license_texts import KNOWN, SPELLINGS
from tilegrid.llm.shared import ascii_lower, let, small, written

#: Lines that a copyright holder fills in; they are dropped before comparing.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9©(<\n]*(copyright[ \t]*(\(c\)|©|[0-9<])|\(c\)[ \t]*[0-9]|©|all[ \t]+rights[ \t]+reserved)[^\n]*"
#: All ASCII characters but letters, digits and the line end.
NO_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


#: Known texts up to which they are broadcast (a digest and a name each), and different sizes of theirs up to which sizes are looked at first.
MOST_BROADCAST, MOST_SIZES = 200_000, 10_000


def canonical_lines(text: Column) -> Column:
    """The normalised lines of a text that have a word.

    Each word stands between two spaces of its own while spellings are replaced, so that neighbours are replaced alike.
    """
    out = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    out = F.concat(F.lit(" "), F.replace(F.regexp_replace(out, NO_WORD, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} ".replace(" ", "  ")[1:-1]))
    return F.filter(F.transform(F.split(F.replace(out, F.lit("  "), F.lit(" ")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license_id, digest, size) of the known texts, (license_id, text) pairs or a table of them; texts that are normalised alike have one row."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame([*known], "license_id string, text string")
    whole = F.array_join(canonical_lines(F.col("text")), " ")
    return rows.select("license_id", whole.alias("w")).where("w != ''").groupBy(F.md5("w").alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("w")).alias("size"))


def license_scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, digest (of the whole normalised text), license_id (null if none), n_license_lines, line_licenses (sorted, comma-separated)."""
    digests = written(known_digests(docs.sparkSession, known), "license-digests")
    sizes = [r["size"] for r in digests.select("size").distinct().limit(MOST_SIZES + 1).collect()]
    fits = lambda n: F.lit(True) if len(sizes) > MOST_SIZES else n.isin(sizes) if sizes else F.lit(False)
    facts = let(canonical_lines(F.col("text")), lambda lines: let(F.array_join(lines, " "), lambda whole: F.struct(
        F.md5(whole).alias("digest"), F.length(whole).alias("size"),
        F.transform(F.filter(lines, lambda x: fits(F.length(x))), lambda x: F.md5(x)).alias("lines"))))
    rows = docs.select("doc_id", facts.alias("f")).select("doc_id", "f.*").withColumn("key", F.when(F.size("lines") > 0, F.md5(F.array_join("lines", ""))))
    rows = written(rows, "licenses")
    table = small(digests.select("digest", "license_id"), MOST_BROADCAST)
    # Rows whose lines and text no known text can equal, most of them, join nothing.
    notices = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("lines").alias("lines")).select("key", F.explode("lines").alias("digest"))
    notices = notices.join(table, "digest").groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("names"))
    likely = F.col("key").isNotNull() | fits(F.col("size"))
    found = rows.where(likely).join(table, "digest", "left").join(notices, "key", "left").select("doc_id", "digest", "license_id", "n", "names")
    none = F.lit(None)
    whole = found.union(rows.where(~likely).select("doc_id", "digest", none.cast("string"), none.cast("long"), none.cast("string")))
    return whole.select("doc_id", "digest", "license_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses"))
