"""Model catalogues: search, merging, and what is known of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilegrid.operators.results import numbered_by_range

# Names of agents, and the id each stands for.
AGENT_NAMES = {"claude-code": "claude", "claude": "claude", "opencode": "opencode", "open-code": "opencode", "codex-cli": "codex", "codex": "codex"}
#: Values of ``visibility`` that list a model.
LISTED = ("list", "default", "visible", "true")
SUFFIX = ":thinking"


def agent_id(name: Column) -> Column:
    """The id of an agent's name; unknown names are an error."""
    own = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("-"))
    out = F.raise_error(F.concat(F.lit("Unknown agent: "), name))
    for alias, target in AGENT_NAMES.items():
        out = F.when(own == alias, target).otherwise(out)
    return out


def search(rows: DataFrame, needle: str) -> DataFrame:
    """Rows (slug, name, author, source) that hold the needle; hits in the slug first. An empty needle finds nothing."""
    text = needle.strip().lower()
    hit = F.contains(F.lower(F.concat_ws(" ", "slug", "name")), F.lit(text))
    found = rows.where((hit if text else F.lit(False)) & (F.coalesce("slug", F.lit("")) != ""))
    return found.orderBy(F.when(F.contains(F.lower("slug"), F.lit(text)), 0).otherwise(1), "slug")


def tagged(rows: DataFrame, source: str) -> DataFrame:
    """Hits with a slug, and where they come from."""
    return rows.where(F.coalesce("slug", F.lit("")) != "").withColumn("source", F.lit(source))


def searched(models: DataFrame, agents: DataFrame, needle: str) -> DataFrame:
    """Hits of both catalogues (slug, name, author), those of the agents first if the needle looks like one of them; ``branch`` and ``place`` give the order."""
    text = needle.strip().lower()
    like_agent = text.startswith("cli") or any(name in text for name in ("codex", "opencode", "cli2api"))
    ways = [("openrouter", models), ("cli", agents)]
    both = merged(*(tagged(search(rows, needle), source) for source, rows in (ways[::-1] if like_agent else ways)))
    lead = F.when(F.contains(F.lower("slug"), F.lit(text)), 0).otherwise(1)
    return numbered_by_range(both, "branch", "place", lead, F.col("slug")).orderBy("branch", "place")


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both with ``branch`` (0 or 1); which branch leads is the caller's choice."""
    return first.withColumn("branch", F.lit(0)).unionByName(second.withColumn("branch", F.lit(1)), allowMissingColumns=True)


def first_known(items: DataFrame) -> DataFrame:
    """Catalogue items (seq, slug, id, name, display_name, visibility) as listed models (id, name): the first of each id."""
    slug = F.coalesce(F.nullif("slug", F.lit("")), F.nullif("id", F.lit("")))
    own = items.where(F.col("visibility").isNull() | F.lower("visibility").isin(*LISTED)).withColumn("_id", slug).where("_id IS NOT NULL")
    name = F.coalesce(F.nullif("display_name", F.lit("")), F.nullif("name", F.lit("")), F.col("_id"))
    return own.groupBy("_id").agg(F.min_by(name, "seq").alias("name"), F.min("seq").alias("seq")).select(F.col("_id").alias("id"), "name", "seq")


def with_default(models: DataFrame, default: DataFrame) -> DataFrame:
    """``models`` and the rows of ``default`` whose id isn't among them."""
    return default.join(models.select("id"), "id", "left_anti").unionByName(models, allowMissingColumns=True)


def thinking_variant(models: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``models`` (model_id) with ``effective``: the thinking variant where the catalogue (slug) has one and none is named yet."""
    variants = catalogue.where(F.endswith("slug", F.lit(SUFFIX))).select(F.regexp_replace("slug", SUFFIX + "$", "").alias("model_id"), F.col("slug").alias("_variant")).distinct()
    return models.join(variants, "model_id", "left").withColumn("effective", F.when(F.contains("model_id", F.lit(":")), F.col("model_id")).otherwise(F.coalesce("_variant", "model_id"))).drop("_variant")


def metadata(models: DataFrame, hits: DataFrame, listing: DataFrame) -> DataFrame:
    """model_id, model_name, company_slug, release_date, supports_reasoning: from search hits, else from the full listing, else from the id.

    ``hits``: slug, name, author, created_at, supports_reasoning; ``listing``: id, name, created (seconds), supported (array).
    """
    base = models.withColumn("slug", F.substring_index("model_id", ":", 1))
    one = hits.dropDuplicates(["slug"]).select("slug", F.struct("name", "author", "created_at", "supports_reasoning").alias("h"))
    two = listing.dropDuplicates(["id"]).select(F.col("id").alias("slug"), F.struct("name", F.col("created"), "supported").alias("l"))
    rows = base.join(one, "slug", "left").join(two, "slug", "left")
    found = F.coalesce("h.name", "l.name")
    thinking = F.endswith("model_id", F.lit(SUFFIX)) & ~F.endswith(found, F.lit("(thinking)"))
    reasons = F.coalesce("h.supports_reasoning", F.arrays_overlap("l.supported", F.array(F.lit("reasoning"), F.lit("include_reasoning"))), F.lit(False))
    time = F.date_format(F.timestamp_seconds("l.created"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    company = F.when(F.col("h").isNotNull(), F.coalesce("h.author", F.lit("unknown"))).when(F.contains("slug", F.lit("/")), F.substring_index("slug", "/", 1)).otherwise("unknown")
    return rows.select("model_id", F.coalesce(F.when(thinking, F.concat(found, F.lit(" (thinking)"))).otherwise(found), "model_id").alias("model_name"), company.alias("company_slug"), F.when(F.col("h").isNotNull(), F.col("h.created_at")).otherwise(time).alias("release_date"), reasons.alias("supports_reasoning"))


def agent_listing(agents: DataFrame, models: DataFrame) -> DataFrame:
    """id, name, available, models (array of id and name; empty if the agent isn't available). ``models``: agent, id, name."""
    own = models.groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("_models"))
    none = F.array().cast("array<struct<id:string,name:string>>")
    return agents.join(own, agents["id"] == own["agent"], "left").select(agents["id"], agents["name"], "available", F.when(F.col("available"), F.coalesce("_models", none)).otherwise(none).alias("models"))


def slug_parts(slug: Column) -> Column:
    """(kind, agent, model) of ``kind/agent/model``; the model may hold slashes."""
    parts = F.split(F.trim(slug), "/", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("agent"), F.nullif(F.trim(F.get(parts, F.lit(2))), F.lit("")).alias("model"))


def agent_metadata(agents: DataFrame, *more: str) -> DataFrame:
    """model_id, model_name, company_slug, supports_reasoning, reasoning_effort of agents (id, name, model, effort) as models, and ``more`` of their columns."""
    model, effort = F.nullif(F.trim("model"), F.lit("")), F.nullif(F.lower(F.trim("effort")), F.lit(""))
    name = F.concat("name", F.lit(" ("), F.coalesce(model, F.lit("default")), F.lit(")"), F.coalesce(F.concat(F.lit(" ["), effort, F.lit("]")), F.lit("")))
    return agents.select(F.concat_ws("/", F.lit("cli"), "id", model).alias("model_id"), name.alias("model_name"), F.lit("cli").alias("company_slug"), effort.isNotNull().alias("supports_reasoning"), F.coalesce(effort, F.lit("cli")).alias("reasoning_effort"), *more)
