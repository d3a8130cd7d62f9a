"""python -m tilegrid COMMAND: the engine's tables from the command line, as JSON lines or CSV.

A store is a folder of parquet tables ``runs``, ``run_status`` and ``board_results``, and positions in ``positions.json``. Models and agents that can be
searched are tables ``models`` and ``agents`` in it (parquet). Replies of a model are JSON lines (position_id, attempt_index, reply, failure, total_tokens,
latency_ms); live providers are out of scope.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilegrid.functions.texts import EFFORTS
from tilegrid.operators import catalog, lexicon, results, selfplay
from tilegrid.plans.scratch import ensure_folder
from tilegrid.sources import files, store

REPLY = "position_id string, attempt_index int, reply string, failure string, total_tokens int, latency_ms int"
MODEL = "slug string, name string, author string, created_at string"
AGENT = "id string, name string, available boolean"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tilegrid")
    out.add_argument("--store", default=".")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("leaderboard", "runs", "active-run", "cli-agents"):
        sub.add_parser(name)
    for name in ("run", "cancel-run"):
        sub.add_parser(name).add_argument("run_id")
    sub.add_parser("search-models").add_argument("query")
    dataset = sub.add_parser("dataset")
    for command in (dataset, sub.add_parser("prepare-run"), sub.add_parser("play")):
        command.add_argument("--mode", default="full" if command is dataset else "smoke")
        command.add_argument("--boards", type=int)
        command.add_argument("--lexicon")
        if command is not dataset:
            command.add_argument("--model", required=True)
            command.add_argument("--effort", default="medium", choices=EFFORTS)
            command.add_argument("--run-id")
            command.add_argument("--replies")
    export = sub.add_parser("export")
    export.add_argument("--kind", choices=("all", "run"), required=True)
    export.add_argument("--run-id")
    export.add_argument("--out")
    made = sub.add_parser("generate-dataset")
    made.add_argument("--lexicon")
    made.add_argument("--games", type=int, default=40)
    made.add_argument("--quota", type=int, help="positions a ply; by default those of the full dataset")
    return out


def export_folder(folder: str, kind: str, run_id: str | None) -> str:
    """Where an export goes that names no place."""
    if kind == "all":
        return f"{folder}/exports/benchmark_results.csv"
    if run_id:
        return f"{folder}/exports/run_{run_id}.csv"
    raise ValueError("Unknown export kind")


def words(spark: SparkSession, path: str | None) -> DataFrame:
    return lexicon.read(spark, path or lexicon.first_existing())


def positions(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The positions of a mode; a dataset that isn't there is generated first."""
    path = f"{args.store}/positions.json"
    if files.read_positions(spark, path).isEmpty():
        generate(spark, args.store, args.lexicon)
    return files.select_positions(files.read_positions(spark, path), args.mode, args.boards)


def generate(spark: SparkSession, folder: str, path: str | None, games: int = 40, each: int | None = None) -> None:
    ensure_folder(spark)
    quotas = selfplay.QUOTAS if each is None else dict.fromkeys(selfplay.QUOTAS, each)
    files.write_positions(selfplay.dataset(spark, words(spark, path), quotas, games), f"{folder}/positions.json")


def model(spark: SparkSession, folder: str, slug: str) -> DataFrame:
    """The one model of a run, with what the store's catalogue knows of it."""
    hits = files.read_table(spark, f"{folder}/models", MODEL).withColumn("supports_reasoning", F.lit(None).cast("boolean"))
    listing = spark.createDataFrame([], "id string, name string, created long, supported array<string>")
    return catalog.metadata(spark.createDataFrame([(slug,)], "model_id string"), hits, listing)


def prepare(spark: SparkSession, args: argparse.Namespace) -> tuple[str, DataFrame]:
    own = positions(spark, args)
    return args.run_id or store.create_run(spark, args.store, model(spark, args.store, args.model), args.effort, args.mode, own.count()), own


def shown(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    """The rows that a command prints; None if it writes files."""
    runs, played = store.runs(spark, args.store), store.played(spark, args.store)
    answer = lambda **told: spark.createDataFrame([tuple(told.values())], [*told])
    if args.command == "leaderboard":
        return results.leaderboard(runs, played)
    if args.command == "runs":
        return runs.orderBy(F.desc("started_at"))
    if args.command == "active-run":
        return results.latest_active(runs)
    if args.command == "run":
        results.known(runs, args.run_id)
        return results.decoded(played.where(F.col("run_id") == args.run_id)).orderBy("id")
    if args.command == "cancel-run":
        results.known(runs, args.run_id)
        store.set_status(spark, args.store, args.run_id, "cancelled")
        return answer(ok=True, run_id=args.run_id)
    if args.command == "cli-agents":
        return files.read_table(spark, f"{args.store}/agents", AGENT).orderBy("id")
    if args.command == "search-models":
        agents = files.read_table(spark, f"{args.store}/agents", AGENT).select(F.concat(F.lit("cli/"), "id").alias("slug"), "name", F.lit("cli").alias("author"))
        return catalog.searched(files.read_table(spark, f"{args.store}/models", MODEL).select("slug", "name", "author"), agents, args.query)
    if args.command == "dataset":
        return positions(spark, args)
    if args.command == "prepare-run":
        return answer(id=prepare(spark, args)[0])
    if args.command == "play":
        run_id, own = prepare(spark, args)
        replies = spark.read.schema(REPLY).json(args.replies) if args.replies else None
        store.run(spark, args.store, run_id, own, words(spark, args.lexicon), replies)
        return results.leaderboard(store.runs(spark, args.store), store.played(spark, args.store)).where(F.col("run_id") == run_id)
    if args.command == "export":
        if args.kind == "run":
            results.known(runs, args.run_id)
        own = results.export_all(results.leaderboard(runs, played)) if args.kind == "all" else results.export_run(played, args.run_id)
        files.export_csv(own, args.out or export_folder(args.store, args.kind, args.run_id))
        return None
    generate(spark, args.store, args.lexicon, args.games, args.quota)
    return None


def main() -> None:
    spark = SparkSession.builder.appName("tilegrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = shown(spark, parser().parse_args())
    if rows is not None:
        for row in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
            print(row.line)


if __name__ == "__main__":
    main()
