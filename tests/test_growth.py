"""Queries over large tables: what they deal to other tasks, and what one task holds."""

import json
import random

import duckdb
from pyspark.sql import functions as F

from tilegrid.operators import automaton, board, lexicon, movegen, score
from tilegrid.operators.automaton import Graph, broadcast_graph
from tilegrid.plans import catalogue, stores
from tilegrid.streaming import live

BOARD = "array<struct<row:int,col:int,letter:string,is_blank:boolean>>"


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


def test_squares_of_overlays_stay_where_they_are(spark):
    """Squares are made in the position's own task; marks beside the board and a second mark of a square add none."""
    positions = spark.createDataFrame([("a", [(7, 7, "H", False), (7, 8, "i", True)]), ("b", [])], f"id string, board {BOARD}")
    marks = spark.createDataFrame([("a", 7, 8, "z"), ("a", 7, 8, "##"), ("a", 15, 0, "x"), ("b", 0, -1, "x"), ("b", 0, 0, "m"), ("none", 1, 1, "x")], "id string, row int, col int, letter string")
    shown = board.overlay_view(positions, marks)
    assert not [line for line in plan(shown).splitlines() if "hashpartitioning(id" in line and "row" in line]
    got = {(r.id, r.row, r.col): r.text for r in shown.collect()}
    assert shown.count() == len(got) == 450
    assert (got["a", 7, 7], got["a", 7, 8], got["a", 0, 0], got["b", 0, 0], got["b", 7, 7], got["b", 1, 2]) == ("H", "##", "TW", "m", "DW", "")


def test_word_graph_of_millions_of_words(spark):
    """Cross-checks need no bound on the lexicon: a graph is made in parts. Words of up to two letters are cut between the parts."""
    digit = lambda k: F.char((65 + F.floor(F.col("id") / 26**k) % 26).cast("long"))
    words = spark.range(2_100_000).select(F.concat(*(digit(k) for k in (4, 3, 2, 1, 0))).alias("word")).union(spark.createDataFrame([("A",), ("AB",), ("B",), ("QX",)], "word string"))
    positions = spark.createDataFrame([("b", [(7, 7, "B", False)]), ("aaaa", [(7, 4 + i, x, False) for i, x in enumerate("EODK")])], f"id string, board {BOARD}")
    got = {(r.id, r.row, r.col, r.across): r.letters for r in movegen.cross_checks(positions, words).collect()}
    assert got["b", 6, 7, True] == "A" and got["b", 8, 7, True] == "" and got["aaaa", 7, 8, False] == "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    assert sum(1 for _ in Graph(broadcast_graph(words.where("length(word) < 3 OR word LIKE 'AA%'")).value).words()) == 4 + 26**3


def test_best_of_all_moves_is_told_without_the_others(spark, monkeypatch):
    """One row a board leaves the kernel, and it is what all moves come to."""
    rng = random.Random(5)
    words = spark.createDataFrame([(w,) for w in {"".join(rng.choices("AEIRST", k=rng.choice((1, 2, 2, 3, 3, 4, 5)))) for _ in range(300)}], "word string")
    boards = [(i, rack, [(7, 4 + k, x, rng.random() < 0.2) for k, x in enumerate(run)]) for i, (rack, run) in enumerate((("AE?", "RAT"), ("STAR", ""), ("", "A"), ("??", "TEA"), ("ZZ", "QQQ"), ("TIRES", "SEA")))]
    positions = spark.createDataFrame(boards, f"id int, rack string, board {BOARD}")
    want = {}
    for m in movegen.generate_moves(positions, words).collect():
        want.setdefault(m.id, []).append((-m.score, len(m.placements), [tuple(p) for p in m.placements], m.words))
    want = {k: (len(v), sum(x[0] == min(v)[0] for x in v), min(v)) for k, v in want.items()}
    told = movegen.best_totals(positions, words)
    got = lambda table: {r.id: (r.n, r.tied, (-r.score, len(r.placements), [tuple(p) for p in r.placements], r.words)) for r in table.collect()}
    assert "Aggregate" not in plan(told) and got(told) == want and len(want) == 4
    monkeypatch.setattr(automaton, "MOST_WORDS", 5)
    assert got(movegen.best_totals(positions, words)) == want


def test_halves_of_labels_are_those_of_the_sql(spark, tmp_path):
    """Exact halves: 1250 and 198500 to the even digit."""
    orders = [(1, 10_000, 198_500.0), (2, 10_000, 1_250.0), (3, 30_000, 1_350.0), (4, 225, 7919 * 0.25), (5, 7, 7919 * 2.75)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    made = catalogue.queries()["number_labels"](spark, str(tmp_path))
    assert {tuple(r) for r in made.collect()} == {*db.execute(f"SELECT {', '.join(made.columns)} FROM ({catalogue.oracle_sql()['number_labels']})").fetchall()}


def test_tiles_and_anchors_are_found_in_their_own_rows(spark):
    cells = [(7, 7, "a", False), (7, 8, "B", True), (7, 7, "C", False), (0, 0, "D", None), (14, 14, "E", False)]
    positions = spark.createDataFrame([(1, cells), (2, []), (3, None), (4, [(7, 7, None, False)])], f"id int, board {BOARD}")
    tiles, near = board.cell_rows(positions), board.anchors(positions)
    assert "Exchange" not in plan(tiles) + plan(near)
    assert {tuple(r) for r in tiles.collect()} == {(1, 7, 7, "C", False), (1, 7, 8, "B", True), (1, 0, 0, "D", False), (1, 14, 14, "E", False)}
    around = {(6, 7), (6, 8), (8, 7), (8, 8), (7, 6), (7, 9), (0, 1), (1, 0), (14, 13), (13, 14)}
    assert sorted(tuple(r) for r in near.collect()) == sorted([*((1, *x) for x in around), (2, 7, 7), (3, 7, 7), (4, 7, 7)])


def test_moves_without_words_are_dealt_evenly(spark, monkeypatch):
    """With a lexicon that isn't broadcast, moves that form no word don't meet in the task of null."""
    moves = [(i, "A", [(7, 7, "B", False)], [("7", "8", "A")] if i % 10 == 0 else [("0", "0", "A")]) for i in range(200)]
    moves = spark.createDataFrame(moves, f"move_id int, rack string, board {BOARD}, raw array<struct<row:string,col:string,letter:string>>")
    words = spark.createDataFrame([("BA",)], "word string")
    want = {tuple(map(str, r)) for r in score.score_moves(moves, words).collect()}
    monkeypatch.setattr(score, "MOST_WORDS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        scored = score.score_moves(moves, words)
        assert "hashpartitioning(key" in plan(scored) and "hashpartitioning(text" not in plan(scored).split("Join")[-1].split("HashAggregate")[0]
        assert {tuple(map(str, r)) for r in scored.collect()} == want and len(want) == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frequent_words_are_looked_up_in_many_tasks(spark, monkeypatch):
    words = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, "rare").when(F.col("id") % 7 == 0, None).otherwise("the").alias("word"))
    held = spark.createDataFrame([("THE",), ("OTHER",)], "word string")
    want = {way: sorted(r.doc_id for r in way(words, held).collect()) for way in (lexicon.valid, lexicon.invalid)}
    monkeypatch.setattr(lexicon, "MOST_HELD", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for way, ids in want.items():
            assert "_slice" in plan(way(words, held)) and sorted(r.doc_id for r in way(words, held).collect()) == ids and len(ids) > 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_of_roll_ups_grow_in_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(stores, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        assert stores.incremental_rollup(spark, "/root/testdata/sf0.01").count() == 14_743
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len([*(tmp_path / "results").glob("part-*")]) > 8 and len([*(tmp_path / "rollups" / "parts").iterdir()]) == 4


def test_positions_in_order_take_no_python(spark, tmp_path):
    """Spark aggregates the states of ordered lines: as a fold of all lines in order, though each batch of files has lines of all times."""
    rng, folder = random.Random(8), tmp_path / "log"
    folder.mkdir()
    kinds = ["attempt_started", *["output_delta"] * 5, "board_result", "attempt_invalid", "run_started"]
    log = [{"type": rng.choice(kinds), "run_id": rng.choice(["r", "s", None]), "position_id": rng.choice("pqt"), "elapsed_ms": i, "attempt_index": rng.choice([None, i]), "move_score": i, "optimal_score": 2 * i,
            "channel": rng.choice(["content", "reasoning", None]), "text": rng.choice([f"{i} ", None])} for i in range(150)]
    want = {}
    for e in log:
        own = want.setdefault((e["run_id"], e["position_id"]), {"status": "streaming", "attempt": 0, "score": 0, "optimum": 0, "content": "", "reasoning": ""})
        if e["type"] == "attempt_started":
            own.update(status="streaming", attempt=e["attempt_index"] or 0, content="", reasoning="")
        elif e["type"] == "output_delta":
            own["content" if e["channel"] == "content" else "reasoning"] += e["text"] or ""
        elif e["type"] in ("board_result", "attempt_invalid"):
            own.update({"status": "done", "score": e["move_score"], "optimum": e["optimal_score"]} if e["type"] == "board_result" else {"status": "invalid"})
    # A line of the same moment as an attempt's start comes after it.
    log += [{"type": kind, "run_id": "z", "position_id": "p", "elapsed_ms": 5, "attempt_index": 4, "channel": "content", "text": "said", "move_score": 1, "optimal_score": 3} for kind in ("output_delta", "board_result", "attempt_started")]
    want["z", "p"] = {"status": "done", "attempt": 4, "score": 1, "optimum": 3, "content": "said", "reasoning": ""}
    rng.shuffle(log)
    for n in range(3):
        (folder / f"{n}.jsonl").write_text("\n".join(map(json.dumps, log[n::3])))
    states = live.positions(live.events(live.tail(spark, str(folder), 1)), order="elapsed_ms")
    assert "Pandas" not in states._jdf.queryExecution().analyzed().toString()
    rows = live.landed(states, f"file://{tmp_path}/out", f"file://{tmp_path}/state", "update").orderBy("batch").collect()
    assert {r.batch for r in rows} == {0, 1, 2}
    assert {(r.run_id, r.position_id): (r.status, r.attempt_index, r.move_score, r.optimal_score, r.content, r.reasoning) for r in rows} == {k: tuple(v.values()) for k, v in want.items()}
