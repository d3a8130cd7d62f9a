"""Reading and writing the engine's files: positions, settings, model lists, tables, exports and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.operators.results import first_by
from tilegrid.schemas import POSITION


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions from a JSON array, over one line or many, or from JSON lines; a missing file has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], POSITION)
    first = spark.read.text(path).where("trim(value) <> ''").first()
    array = first is not None and first.value.lstrip().startswith("[")
    return spark.read.schema(POSITION).option("multiLine", array).json(path)


def select_positions(positions: DataFrame, mode: str, boards: int | None = None) -> DataFrame:
    """The first positions in the stored order (by band, then by id as text): as many as asked for, or as the mode has."""
    n = boards if boards is not None else {"smoke": 5, "full": 100}.get(mode)
    ordered = positions.orderBy("band_ply", "id")
    return ordered if n is None else ordered.limit(n)


def write_positions(positions: DataFrame, path: str) -> None:
    """One JSON object a line, in the stored order."""
    positions.orderBy("band_ply", "id").write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table; a missing one is empty, columns that older files lack are null."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def write_version(rows: DataFrame, folder: str, version: int) -> None:
    """Append rows to a version of a table; each version has columns of its own."""
    rows.write.mode("append").parquet(f"{folder}/version={version}")


def read_versions(spark: SparkSession, folder: str, schema: str, defaults: dict[int, dict[str, object]]) -> DataFrame:
    """All versions of a table as one of ``schema``: the files' own schemas are merged, columns that no version has are null, and ``defaults`` has the values that a
    version's rows get where they have none. Nulls of other versions stay."""
    wanted = spark.createDataFrame([], schema).schema
    if not _exists(spark, folder):
        return spark.createDataFrame([], wanted)
    rows = spark.read.option("mergeSchema", True).option("basePath", folder).parquet(f"{folder}/version=*")

    def column(field) -> Column:
        own = F.col(field.name) if field.name in rows.columns else F.lit(None)
        own = own.cast(field.dataType)
        for version, values in defaults.items():
            if field.name in values:
                own = F.when(F.col("version") == version, F.coalesce(own, F.lit(values[field.name]).cast(field.dataType))).otherwise(own)
        return own.alias(field.name)

    return rows.select(*map(column, wanted.fields))


def with_effort(runs: DataFrame) -> DataFrame:
    """``runs`` with a reasoning effort: ``high`` where an older table has none."""
    own = F.coalesce("reasoning_effort", F.lit("high")) if "reasoning_effort" in runs.columns else F.lit("high")
    return runs.withColumn("reasoning_effort", own)


def settings(lines: DataFrame) -> DataFrame:
    """key, value of KEY=VALUE lines (seq, value): blank lines, comments and lines without ``=`` are skipped, and the first of a key counts."""
    text = F.trim("value")
    own = lines.where((text != "") & ~F.startswith(text, F.lit("#")) & F.contains(text, F.lit("=")))
    parts = F.split(text, "=", 2)
    return first_by(own.select("seq", F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value")), ["key"], F.col("seq")).drop("seq")


def model_names(lines: DataFrame) -> DataFrame:
    """id of the lines that name a model, that is, hold a slash."""
    return lines.select(F.trim("value").alias("id")).where(F.contains("id", F.lit("/")))


def cached_models(texts: DataFrame) -> DataFrame:
    """seq, slug, id, name, display_name, visibility of the items in a model cache (value): a list, an object's ``models`` or ``data``, or its first list whose items have a slug."""
    v = F.try_parse_json("value")
    listed = lambda path: F.try_variant_get(v, path, "array<variant>")
    filled = lambda x: F.when(F.size(x) > 0, x)
    lists = F.transform(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.try_variant_get(x, "$", "array<variant>"))
    slugged = F.filter(lists, lambda x: F.try_variant_get(F.get(x, F.lit(0)), "$.slug", "string").isNotNull())
    items = F.coalesce(listed("$"), filled(listed("$.models")), filled(listed("$.data")), F.get(slugged, F.lit(0)))
    rows = texts.select(F.posexplode(items).alias("seq", "item"))
    return rows.select("seq", *(F.try_variant_get("item", f"$.{c}", "string").alias(c) for c in ("slug", "id", "name", "display_name", "visibility")))


def export_csv(rows: DataFrame, folder: str) -> None:
    """One CSV file with a header, CRLF line ends, minimal quoting and empty fields for nulls. For reports: all rows go to one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").option("escape", '"').csv(folder)


def append_log(events: DataFrame, folder: str) -> None:
    """Events as JSON lines in new files of a log folder."""
    events.write.mode("append").json(folder)


def server_events(events: DataFrame) -> DataFrame:
    """Rows as texts of a server-sent event stream."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("value"))
