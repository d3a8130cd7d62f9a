"""Operator 3: mixing sources to target weights by hierarchical budgets.

A budget of tokens flows down the tree domain - language - source. At each node it is divided among the children by weight, but
none gets more than it can supply (its tokens times the epochs allowed): what a child can't use goes to its siblings by weight,
and only what all siblings together can't use goes to the node's own siblings. All arithmetic is in whole tokens and exact, and
shares add up to the budget.

A leaf then takes the first tokens, up to its budget, of its documents in a seeded order, epoch after epoch, each epoch in an order of
its own. Whole epochs need no order. In the last, documents are counted by the first hex digits of their hash, more of them in larger
leaves, so that only the documents of one bucket of each leaf, without their texts, are ever sorted. The last document may be taken in
part; where it has equal rows (doc_id and text), these alone are numbered, in one task a leaf.

Defined cases: documents without words are never taken; null lang or source counts as an empty name; equal rows are in the order
next to each other; an empty table gives an empty result; columns of ``docs`` stay, but for clashes with those added. A text of any length
is one row, whose words are counted in the JVM as an array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilegrid.llm.shared import packed, small, unpacked, words, written

#: Hex digits of the hash that number a bucket, at least, and documents of a bucket, about, that larger leaves take more digits for.
DIGITS, BUCKET = 3, 100_000
#: Leaves up to which their budgets are broadcast (100 bytes each); beyond, the join shuffles.
MOST_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")
ADDED = ("domain", "epoch", "n_tokens", "take_tokens")


@dataclass(frozen=True)
class Mix:
    """Whole-number weights by name (others weigh ``other``), percent of the corpus's tokens to take, epochs allowed, and seed."""

    domain: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1
    percent: int = 80
    epochs: int = 2
    seed: int = 20240501

    def weight(self, level: str) -> Column:
        out = F.lit(self.other)
        for name, w in getattr(self, level).items():
            out = F.when(F.col(level) == name, w).otherwise(out)
        return out.cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4, or ``other`` without a number."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (F.when(number != "", number).cast("int") % 4).cast("string")))


def with_leaf(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``doc``, with doc_id, the leaf's ``domain``, ``lang`` and ``source``, ``n`` (the tokens, that is words, of the text) and ``t``, a hash of the text."""
    source = F.coalesce("source", F.lit(""))
    return packed(docs, doc_id=F.col("doc_id"), domain=domain_of(source), lang=F.coalesce("lang", F.lit("")), source=source, n=F.size(words(F.col("text"))).cast("long"), t=F.xxhash64("text"))


def _divided(children: DataFrame, parent: list[str], name: str, mix: Mix) -> DataFrame:
    """``children`` (parent's keys, ``name``, cap, parent_budget) with the ``budget`` of each."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rows = children.withColumn("w", mix.weight(name)).withColumn("fills_at", F.col("cap") / F.col("w"))
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy("fills_at", name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_after": F.sum("w").over(after)})
    rows = rows.withColumn("full", big("cap") * big("w_after") <= (F.col("parent_budget") - F.col("cap_before")).cast("decimal(19,0)") * big("w"))
    rest = rows.withColumns({"left": F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group), "w_open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(group)})
    upto = F.coalesce(F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rest = rest.withColumn("w_upto", upto)
    part = "CAST(left AS DECIMAL(19,0)) * CAST({} AS DECIMAL(18,0)) div w_open"
    share = F.expr(part.format("w_upto")) - F.expr(part.format("(w_upto - w)"))
    return rest.withColumn("budget", F.when(F.col("full"), F.col("cap")).when(F.col("w_open") > 0, share).otherwise(0).cast("long")).select(*parent, name, "cap", "budget")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {mix.percent} div 100")).first()[0]
    tops = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"))
    out = _divided(tops.withColumn("parent_budget", F.lit(total).cast("long")), [], "domain", mix)
    for depth in (2, 3):
        parent, keys = list(LEVELS[: depth - 1]), LEVELS[:depth]
        below = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        out = _divided(below.join(out.select(*parent, F.col("budget").alias("parent_budget")), parent), parent, keys[-1], mix)
    return out.join(leaves.select(*LEVELS, "tokens"), list(LEVELS)).select(*LEVELS, "tokens", "budget")


def _hash(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mixed(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows taken: the columns of ``docs`` with domain, epoch (from 0), n_tokens and take_tokens (the leading tokens taken)."""
    mix, keys = mix or Mix(), [*LEVELS]
    rows = with_leaf(docs).where("n > 0")
    lean = written(rows.drop("doc"), "mix-rows")
    leaves = written(lean.groupBy(*keys).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    leaf = budgets(leaves.drop("docs"), mix).join(leaves.select(*keys, "docs"), keys)
    digits = F.greatest(F.lit(DIGITS), F.ceil(F.log(16.0, F.col("docs") / BUCKET))).cast("int")
    leaf = written(leaf.select(*keys, digits.alias("digits"), F.expr("cast(budget div tokens as int)").alias("whole"), F.expr("budget % tokens").alias("rest")), "mix-budgets")
    leaf = small(leaf, MOST_LEAVES)

    def hashed(df: DataFrame) -> DataFrame:
        return df.join(leaf, keys).withColumn("h", _hash(F.col("whole"), F.col("doc_id"), mix.seed)).withColumn("bucket", F.substr("h", F.lit(1), F.col("digits")))

    # The bucket in which each leaf's budget ends, and the tokens before it.
    told = hashed(lean)
    counts = told.groupBy(*keys, "rest", "bucket").agg(F.sum("n").alias("inside"))
    running = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = counts.withColumn("ahead", F.coalesce(F.sum("inside").over(running), F.lit(0))).where((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("inside") >= F.col("rest")))
    edge = small(written(edge.select(*keys, F.col("bucket").alias("edge"), "ahead"), "mix-edges"), MOST_LEAVES)
    # Within it, documents in their order; equal rows are one entry that begins at ``start``.
    entries = told.join(edge, keys).where(F.col("bucket") == F.col("edge")).groupBy(*keys, "ahead", "h", "doc_id", "t", "n").agg(F.count("*").alias("copies"))
    order = Window.partitionBy(*keys).orderBy("h", "doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("start", F.col("ahead") + F.coalesce(F.sum(F.col("n") * F.col("copies")).over(order), F.lit(0)))
    last = written(entries.select(*keys, "h", "t", "start", "copies"), "mix-last")
    wide = hashed(rows).join(edge.select(*keys, "edge"), keys, "left").join(last, [*keys, "h", "t"], "left")
    # All copies of an entry are taken whole, or none, but in the one entry of a leaf in which its budget ends: its copies, if it has several, are numbered.
    ends = F.coalesce((F.col("copies") > 1) & (F.col("rest") > F.col("start")) & (F.col("rest") < F.col("start") + F.col("n") * F.col("copies")), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(*keys, "h", "t").orderBy("h")) - 1
    several = wide.where(ends).withColumn("nth", nth)
    wide = wide.where(~ends).withColumn("nth", F.lit(0)).unionByName(several)
    inside = F.least(F.col("n"), F.greatest(F.lit(0), F.col("rest") - F.col("start") - F.col("nth") * F.col("n")))
    part = F.when(F.col("bucket") < F.col("edge"), F.col("n")).when(F.col("bucket") == F.col("edge"), inside).otherwise(0)
    wide = wide.withColumn("part", part)
    turns = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("whole"), F.col("n")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("take_tokens")))
    out = wide.select("doc", F.col("domain").alias("of"), "n", F.explode(turns).alias("turn")).where("turn.take_tokens > 0")
    return out.select(*unpacked(docs, ADDED), F.col("of").alias("domain"), "turn.epoch", F.col("n").alias("n_tokens"), "turn.take_tokens")


def mixed_documents(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, whole and in each epoch that takes them, with their columns."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), "doc_id", "text", "lang", "source")
    return mixed(own, mix).select(*(F.col(f"kept.`{c}`") for c in docs.columns))
