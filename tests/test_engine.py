"""The engine: golden boards, errors, generation against brute force, events, files and streams."""

import itertools
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oracle import database, rows_of_spark, rows_of_sql
from tilegrid.functions import payload, texts
from tilegrid.functions.tiles import LABELS, LETTER_DIGITS, POINTS, TILES, WORD_DIGITS
from tilegrid.operators import attempts, board, catalog, events, lexicon, results, selfplay, traces
from tilegrid.operators.movegen import canonical_moves, generate_moves
from tilegrid.operators.score import score_moves
from tilegrid.plans import analogs, catalogue
from tilegrid.plans.words import FIXTURE_WORDS
from tilegrid.sources import files
from tilegrid.streaming import live

SMALL = "/root/testdata/sf0.001"
BOARD = "array<struct<row:int,col:int,letter:string,is_blank:boolean>>"
RAW = "array<struct<row:string,col:string,letter:string>>"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert rows_of_spark(catalogue.queries()[name](spark, SMALL)) == rows_of_sql(database(SMALL), catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalogue.fixed()))
def test_queries_of_fixed_rows(spark, name):
    query, sql = catalogue.fixed()[name]
    assert rows_of_spark(query(spark, SMALL)) == rows_of_sql(database(SMALL), sql)


def test_tiles():
    assert sum(TILES.values()) == 100 and len(POINTS) == 27
    assert [sum(x == k for x in LABELS.values()) for k in ("TW", "DW", "TL", "DL")] == [8, 17, 12, 24]
    assert all(LETTER_DIGITS[r * 15 + c] == LETTER_DIGITS[c * 15 + 14 - r] and WORD_DIGITS[r * 15 + c] == WORD_DIGITS[c * 15 + 14 - r] for r in range(15) for c in range(15))


def word(text, row, col, across):
    return [(row + (0 if across else i), col + (i if across else 0), x) for i, x in enumerate(text)]


def moves(spark, rows):
    own = [(m, rack, [(r, c, x.upper(), x.islower()) for r, c, x in cells], [(str(r), str(c), x) for r, c, x in raw]) for m, rack, cells, raw in rows]
    return spark.createDataFrame(own, f"move_id string, rack string, board {BOARD}, raw {RAW}")


def words(spark, *own):
    return spark.createDataFrame([(w,) for w in own], "word string")


def test_golden_boards(spark):
    lex = words(spark, "A", "AT", "HAT", "AX", "AXE", "AXONE", "AXONES", "ABCDEFG")
    rows = [
        ("g1", "A", [], [(0, 0, "A")]), ("g2", "H", word("AT", 7, 7, True), [(7, 6, "H"), (7, 7, "A")]), ("g3", "E", word("AX", 7, 7, True), [(7, 9, "E")]),
        ("g4", "S", word("AXONE", 3, 7, False), [(8, 7, "S")]), ("bingo", "ABCDEFG", [], word("ABCDEFG", 7, 5, True)), ("late", "T?", [], [(7.9, " 7 ", "a"), (7, 8, "T")]),
    ]
    got = {r.move_id: r for r in score_moves(moves(spark, rows), lex).collect()}
    assert got["g1"].error == "The opening move must cover the center square."
    assert [(got[g].score, got[g].words) for g in ("g2", "g3", "g4")] == [(6, ["HAT"]), (10, ["AXE"]), (13, ["AXONES"])]
    assert got["bingo"].score == 2 * (1 + 3 + 3 + 2 + 1 + 4 + 2 + 2) + 50  # G lies on a double letter
    assert got["late"].error is None and [p.is_blank for p in got["late"].placements] == [True, False]


def test_first_error_is_told(spark):
    at = word("AT", 7, 7, True)
    rows = [
        ("Placement lacks a whole row, a column or a letter.", "A", at, [("x", 7, "A"), (99, 0, "A")]), ("Placement out of bounds: (15, 0)", "A", at, [(15, 0, "1"), (7, 7, "B")]),
        ("Invalid placement letter: '1'", "A", at, [(1, 1, "1"), (15, 0, "A")]), ("Placement collides with existing tile at (7, 7)", "B", at, [(7, 7, "B"), (1, 1, "1")]),
        ("No new tiles were provided.", "A", at, [(7, 7, "A")]), ("A Scrabble move may not place more than 7 tiles.", "A", at, [(0, i, "A") for i in range(8)]), ("Rack cannot supply letter 'Z'.", "A?", at, [(0, 0, "A"), (1, 1, "Z"), (2, 2, "Z")]),
        ("Placements must all be on the same row or column.", "AB", [], [(0, 0, "A"), (1, 1, "B")]), ("The opening move must cover the center square.", "AB", [], [(0, 0, "A"), (0, 2, "B")]), ("Move has a gap in its main word.", "AB", at, [(0, 0, "A"), (0, 2, "B")]),
        ("Main word is invalid: TB", "TB", at, [(0, 0, "T"), (0, 1, "B")]), ("Cross word is invalid: AB", "AB", at, [(8, 7, "B"), (8, 6, "A")]), ("Move does not connect to the existing board.", "AT", at, [(0, 0, "A"), (0, 1, "T")]),
        ("Single-tile move does not connect to any word.", "A", at, [(0, 0, "A")]), ("Word is invalid: ATB", "B", at, [(7, 9, "B")]),
    ]
    lex = words(spark, "A", "AT", "AB")
    got = {r.move_id: r.error for r in score_moves(moves(spark, rows), lex.where("word <> 'AB'").union(words(spark, "ABX"))).collect()}
    want = {r[0]: r[0] for r in rows}
    want["Cross word is invalid: AB"] = "Main word is invalid: AB"
    assert got == want


def slow_score(lex, cells, rack, raw):
    """Score of a move by walking a dictionary of squares, or None."""
    old = {(r, c): x for r, c, x in cells}
    fresh, stock = {}, list(rack)
    for r, c, x in sorted(raw):
        if x in stock:
            stock.remove(x)
            fresh[r, c] = x
        elif "?" in stock:
            stock.remove("?")
            fresh[r, c] = x.lower()
        else:
            return None
    if not fresh or len({r for r, _ in fresh}) > 1 and len({c for _, c in fresh}) > 1 or not old and (7, 7) not in fresh:
        return None
    every, found = old | fresh, {}
    for r, c in fresh:
        for dr, dc in ((0, 1), (1, 0)):
            a = b = 0
            while (r - dr * (a + 1), c - dc * (a + 1)) in every:
                a += 1
            while (r + dr * (b + 1), c + dc * (b + 1)) in every:
                b += 1
            squares = tuple((r + dr * k, c + dc * k) for k in range(-a, b + 1))
            if len(squares) > 1:
                found[squares] = None
    if len(fresh) > 1 and not any(set(fresh) <= set(s) for s in found):
        return None
    if not found:
        if old or len(fresh) > 1:
            return None
        found[tuple(fresh)] = None
    if old and not any(set(s) - set(fresh) for s in found):
        return None
    total = 50 * (len(fresh) == 7)
    for squares in found:
        if "".join(every[s] for s in squares).upper() not in lex:
            return None
        points, times = 0, 1
        for r, c in squares:
            p = 0 if every[r, c].islower() else POINTS[every[r, c]]
            points += p * (int(LETTER_DIGITS[r * 15 + c]) if (r, c) in fresh else 1)
            times *= int(WORD_DIGITS[r * 15 + c]) if (r, c) in fresh else 1
        total += points * times
    return total


def test_random_moves_and_generation(spark):
    rng = random.Random(4)
    lex = {"".join(p) for n in (2, 3) for p in itertools.product("ABE", repeat=n) if rng.random() < 0.5} | {"ABEB", "EBBA", "A"}
    positions = {"empty": ([], "AB?"), "row": (word("BAE", 7, 6, True), "BE"), "cross": (word("BAE", 7, 6, True) + [(8, 7, "b")], "AE?")}
    rows, want = [], {}
    for name, (cells, rack) in positions.items():
        squares = [(r, c) for r in range(3, 12) for c in range(2, 13) if (r, c) not in {x[:2] for x in cells}]
        for n in (1, 2, 3):
            for combo in itertools.combinations(squares, n):
                if len(combo) > len(rack) or len({r for r, _ in combo}) > 1 and len({c for _, c in combo}) > 1 or max(combo)[0] - min(combo)[0] > 4 or max(c for _, c in combo) - min(c for _, c in combo) > 4:
                    continue
                for letters in itertools.product("ABE", repeat=n):
                    raw = [(r, c, x) for (r, c), x in zip(combo, letters, strict=True)]
                    points = slow_score(lex, cells, rack, raw)
                    if points is not None:
                        want[name, tuple(sorted(raw))] = points
                    elif rng.random() > 0.03:
                        continue
                    rows.append((f"{len(rows)}", rack, cells, raw, name, points))
    got = {r.move_id: r.score for r in score_moves(moves(spark, [r[:4] for r in rows]), words(spark, *lex)).collect()}
    assert got == {r[0]: r[5] for r in rows} and len(want) > 100
    boards = spark.createDataFrame([(n, rack, [(r, c, x.upper(), x.islower()) for r, c, x in cells]) for n, (cells, rack) in positions.items()], f"id string, rack string, board {BOARD}")
    made = generate_moves(boards, words(spark, *lex))
    assert {(r.id, tuple((p.row, p.col, p.letter) for p in r.placements)): r.score for r in made.collect()} == want
    best = {r.id: r for r in canonical_moves(made).collect()}
    for name in positions:
        top = max(v for (n, _), v in want.items() if n == name)
        ties = [k for (n, k), v in want.items() if n == name and v == top]
        assert best[name].score == top and tuple((p.row, p.col, p.letter) for p in best[name].placements) == min(ties, key=lambda k: (len(k), k))


def test_opening_of_one_tile(spark):
    boards = spark.createDataFrame([("one", "A", []), ("blank", "?", []), ("none", "B", [])], f"id string, rack string, board {BOARD}")
    got = {(r.id, tuple((p.row, p.col, p.letter, p.is_blank) for p in r.placements)): r.score for r in generate_moves(boards, words(spark, "A", "AT")).collect()}
    assert got == {("one", ((7, 7, "A", False),)): 2, ("blank", ((7, 7, "A", True),)): 0}


def test_feasible_words_of_any_rack(spark):
    rng = random.Random(6)
    lex = {"".join(rng.choice("ABCD") for _ in range(rng.randint(1, 10))) for _ in range(400)}
    racks = ["ABCDABCD", "AB???", "?", "????????", "AABBCCDDAB", "ABC", "B", ""]
    table = spark.createDataFrame([*enumerate(racks)], "rack_id int, rack string")
    got = {(r.rack_id, r.word) for r in lexicon.feasible(table, words(spark, *lex)).collect()}
    assert got == {(r.rack_id, r.word) for r in lexicon.joined_feasible(table, words(spark, *lex)).collect()}
    want = {(i, w) for i, rack in enumerate(racks) for w in lex if (Counter(w) - Counter(rack.replace("?", ""))).total() <= rack.count("?")}
    assert got == want and len(want) > 200
    large = spark.createDataFrame([(1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3)], "rack_id int, rack string")
    assert {r.word for r in lexicon.feasible(large, words(spark, *lex)).collect()} == {w for w in lex if max(Counter(w).values()) <= 3}


def test_generated_moves_use_the_whole_lexicon(spark):
    lex = {w for (w,) in database(SMALL).execute(f"WITH {analogs.WORDS} SELECT word FROM words").fetchall()} | set(FIXTURE_WORDS)
    spelled = {w for w in lex if len(w) <= 7 and (Counter(w) - Counter("ATTRES")).total() <= 1}  # the rack has a blank too
    board = spark.createDataFrame([("none", "A?TTRES", [])], f"id string, rack string, board {BOARD}")
    assert {r.words[0] for r in generate_moves(board, words(spark, *lex)).collect()} == spelled


def test_self_play_repeats(spark):
    lex = words(spark, *{"".join(p) for p in itertools.product("AEIOR", "NSTLR")}, *{"".join(p) for p in itertools.product("AEIOR", "NSTLR", "AE")}).cache()
    one, two = (selfplay.play(spark, lex, games=n, plies=2, snapshots=(1, 2)) for n in (1, 2))
    own = {r.id: (r.rack, r.bag_count, r.optimal_score) for r in two.collect()}
    assert all(own[r.id] == (r.rack, r.bag_count, r.optimal_score) for r in one.collect()) and all(len(v[0]) == 7 for v in own.values())


def test_lexicon(spark, tmp_path):
    (tmp_path / "ENABLE.txt").write_text("\n".join([f"AA{i:05d}" for i in range(50)] + [" jows ", "JOWS", "straße", "x" * 16, "A"]))
    (tmp_path / "words.txt").write_text("a\nat\nhat\nabcdefghi\n")
    assert sorted(r.word for r in lexicon.read(spark, str(tmp_path / "ENABLE.txt")).collect()) == ["A", "JOWS", "STRASSE"]
    assert sorted(r.word for r in lexicon.read(spark, str(tmp_path / "words.txt")).collect()) == ["AT", "HAT"]
    (tmp_path / "none.txt").write_text("1\n")
    with pytest.raises(ValueError):
        lexicon.read(spark, str(tmp_path / "none.txt"))
    assert lexicon.first_existing([str(tmp_path / "no"), str(tmp_path / "none.txt")]).endswith("none.txt")


def test_attempts_and_texts(spark):
    a = spark.createDataFrame([("p", 1, True, "e1", None, 9, 5, 50), ("p", 2, True, None, 9, 9, 7, 60), ("q", 1, True, "e1", None, 8, 5, 50), ("q", 2, False, "down", None, 8, None, None)], "position_id string, attempt_index int, answered boolean, error string, score int, optimal_score int, total_tokens int, latency_ms int")
    got = {r.position_id: r for r in attempts.board_results(a).collect()}
    assert (got["p"].attempt_index, got["p"].move_score, got["p"].is_optimal, got["p"].retry_used, got["p"].total_tokens) == (2, 9, 1, 1, 7)
    assert (got["q"].attempt_index, got["q"].move_score, got["q"].validation_error, got["q"].total_tokens, got["q"].latency_ms) == (2, 0, "down", 5, 50)
    rack = spark.createDataFrame([("AB?", [(7, 7, "A", False)], "nope", "Rack cannot supply letter 'S'.")], f"rack string, board {BOARD}, reply string, error string")
    system, user, reply, told = (m.content for m in rack.select(attempts.retry_prompt(*(F.col(c) for c in rack.columns)).alias("m")).first().m)
    assert "only the new tiles placed this turn" in system and "Return only newly placed tiles" in user and json.loads(user)["rack"] == ["A", "B", "?"] and reply == "nope"
    told = json.loads(told)["tool_result"]
    assert told["status"] == "rejected" and told["hint"].startswith("Use only letters") and len(told["reminder"]) == 4
    one = spark.range(1).select(texts.percent_label(F.lit(1.45)), texts.percent_label(F.lit(0.35)), texts.compact(F.lit(1234.0)), texts.compact(F.lit(56789.0)), texts.compact(F.lit(999.1234567)), texts.milliseconds(F.lit(1250)), texts.milliseconds(F.lit(None).cast("int")), texts.iso_time(F.lit(0)), texts.effort(F.lit(" HIGH ")))
    assert list(one.first()) == ["1.4%", "0.3%", "1.2 K", "57 K", "999.123", "1.3s", "n/a", "1970-01-01T00:00:00+00:00", "high"]
    with pytest.raises(Exception, match="Unknown reasoning effort"):
        spark.range(1).select(texts.effort(F.lit("huge"))).collect()


def test_payloads_and_events(spark):
    values = spark.createDataFrame([('"s"',), ('["a",{"text":"b"},{"content":"c"},{"x":1}]',), ('{"summary":"d"}',), ("5",)], "v string")
    assert [r[0] for r in values.select(payload.text_of(F.parse_json("v"))).collect()] == ["s", "abc", "d", ""]
    rows = spark.createDataFrame([("k", 1, "first", "content", "item.completed"), ("k", 2, "second", "content", "agent_message"), ("k", 3, "again", "content", "last_agent_message"), ("j", 1, "only", "content", "last_agent_message")], "key string, seq int, text string, channel string, event_type string")
    assert {r.key: r.text for r in events.final_answer(rows).collect()} == {"k": "second", "j": "only"}
    lines = [("k", 1, 'data: {"choices":[{"delta":{"content":"he"}}],"provider":"x"}'), ("k", 2, 'data: {"choices":[{"delta":{"content":[{"text":"llo"}],"reasoning":"r"}}],"usage":{"total_tokens":7}}'), ("k", 3, ": ping"), ("k", 4, "data: [DONE]"), ("j", 1, 'data: {"error":{"message":"bad"}}')]
    answers = {r.key: r for r in events.provider_answer(events.provider_chunks(spark.createDataFrame(lines, "key string, seq int, line string"))).collect()}
    assert (answers["k"].content, answers["k"].reasoning, answers["k"].total_tokens, answers["k"].provider, answers["j"].error) == ("hello", "r", 7, "x", "bad")
    made = spark.range(1).select(events.synthetic_events(F.lit("ab"), F.lit(""), F.lit(9)).alias("e")).first().e
    assert [(e.type, e.elapsed_ms, e.chars) for e in made] == [("request_sent", 0, None), ("non_stream_response", 9, None), ("content_delta", 9, 2)]
    t = spark.createDataFrame([([("reasoning_delta", 5, 5, 3, None), ("content_delta", 9, 4, 2, None), ("reasoning_delta", 4, 0, None, None)],)], "e array<struct<type:string,elapsed_ms:int,delta_ms:int,chars:int,source:string>>").select(traces.summary(F.col("e"), F.lit(10)).alias("s")).first().s
    assert (t.reasoning_events, t.last_reasoning_ms, t.first_content_ms, t.reasoning_chars, t.wait_before_reasoning_ms) == (2, 4, 9, 3, 5)


def test_outputs(spark):
    lines = [("k", 1, '{"type":"text","part":{"text":"he"}}'), ("k", 2, '{"type":"text","part":{"text":"llo"}}'), ("m", 1, '{"content":" a "}'), ("m", 2, '{"message":{"content":"b"}}'), ("n", 1, "raw"), ("n", 2, "text")]
    got = {r.key: r.text for r in events.output_text(spark.createDataFrame(lines, "key string, seq int, line string")).collect()}
    assert got == {"k": "hello", "m": "b", "n": "raw\ntext"}
    one = spark.range(1).select(payload.details_text(F.parse_json(F.lit('[{"summary":"a"},{"summary":["b",{"text":"c"}]},5,{"x":1}]'))), events.status_text(F.lit("s"), F.lit("x" * 300)), events.status_text(F.lit("s"), F.lit(None).cast("string")))
    assert list(one.first()) == ["a\nb\nc", "s: " + "x" * 237 + "...\n", "s\n"]
    cells = [(7, 8, "T", None), (7, 7, "A", False)]
    keys = spark.createDataFrame([(cells, "AB"), (cells[::-1], "AB"), (cells, "BA")], f"board {BOARD}, rack string").select(board.position_key(F.col("board"), F.col("rack")).alias("k")).collect()
    assert keys[0] == keys[1] != keys[2]
    agents = spark.createDataFrame([("codex", "Codex", " m ", "LOW"), ("x", "X", None, None)], "id string, name string, model string, effort string")
    assert [tuple(r) for r in catalog.agent_metadata(agents).collect()] == [("cli/codex/m", "Codex (m) [low]", "cli", True, "low"), ("cli/x", "X (default)", "cli", False, "cli")]


def test_catalogue(spark):
    hits = spark.createDataFrame([("a/m", "M", "a", "2024", True)], "slug string, name string, author string, created_at string, supports_reasoning boolean")
    listing = spark.createDataFrame([("b/n", "N", 0, ["reasoning"])], "id string, name string, created long, supported array<string>")
    models = spark.createDataFrame([("a/m:thinking",), ("b/n",), ("c",)], "model_id string")
    got = {r.model_id: tuple(r)[1:] for r in catalog.metadata(models, hits, listing).collect()}
    assert got == {"a/m:thinking": ("M (thinking)", "a", "2024", True), "b/n": ("N", "b", "1970-01-01T00:00:00+00:00", True), "c": ("c", "unknown", None, False)}
    cache = spark.createDataFrame([('{"v":1,"list":[{"slug":"x","display_name":"X"},{"slug":"x"},{"slug":"h","visibility":"hide"},{"id":"y","visibility":"list"}]}',)], "value string")
    known = catalog.first_known(files.cached_models(cache))
    default = spark.createDataFrame([("d", "D")], "id string, name string")
    assert {(r.id, r.name) for r in catalog.with_default(known, default).collect()} == {("d", "D"), ("x", "X"), ("y", "y")}
    assert catalog.search(hits.select("slug", "name"), " ").collect() == [] and len(catalog.search(hits.select("slug", "name"), "A/").collect()) == 1
    variants = catalog.thinking_variant(models, spark.createDataFrame([("c:thinking",)], "slug string"))
    assert {r.model_id: r.effective for r in variants.collect()} == {"a/m:thinking": "a/m:thinking", "b/n": "b/n", "c": "c:thinking"}
    assert tuple(spark.range(1).select(catalog.slug_parts(F.lit("cli/codex/a/b")).alias("p")).first().p) == ("cli", "codex", "a/b")


def test_files(spark, tmp_path):
    assert files.read_positions(spark, f"{tmp_path}/none.json").collect() == []
    (tmp_path / "p.json").write_text(json.dumps([{"id": i, "band_ply": b, "rack": "A", "board": [{"row": 7, "col": 7, "letter": "a"}]} for i, b in (("pos-10", 6), ("pos-9", 6), ("pos-1", 10))]))
    positions = files.read_positions(spark, f"{tmp_path}/p.json")
    assert [r.id for r in files.select_positions(positions, "custom", 2).collect()] == ["pos-10", "pos-9"]
    assert board.cell_rows(positions).where("letter = 'A'").count() == 3
    files.write_positions(positions, f"{tmp_path}/out")
    assert [r.id for r in files.select_positions(files.read_positions(spark, f"{tmp_path}/out"), "full").collect()] == ["pos-10", "pos-9", "pos-1"]
    lines = spark.createDataFrame([(1, "A=1"), (2, "# x"), (3, ""), (4, "A=2"), (5, "B = x=y"), (6, "none")], "seq int, value string")
    assert {r.key: r.value for r in files.settings(lines).collect()} == {"A": "1", "B": "x=y"}
    files.export_csv(spark.createDataFrame([("a,b", None, 1.5), ('q"', "", 2.0)], "x string, y string, z double"), f"{tmp_path}/csv")
    (made,) = (tmp_path / "csv").glob("part-*")
    assert made.read_bytes() == b'x,y,z\r\n"a,b",,1.5\r\n"q""",,2.0\r\n'
    runs = spark.createDataFrame([("r", "queued", "2")], "id string, status string, started_at string")
    with pytest.raises(RuntimeError):
        results.admit(runs, runs)
    assert results.admit(runs.where("false"), runs).count() == 1
    assert files.with_effort(runs).first().reasoning_effort == "high"


def test_streams(spark, tmp_path):
    log = [
        {"type": "run_started", "run_id": "r"}, {"type": "attempt_started", "run_id": "r", "position_id": "p", "attempt_index": 1}, {"type": "output_delta", "run_id": "r", "position_id": "p", "channel": "content", "text": "x"},
        {"type": "attempt_invalid", "run_id": "r", "position_id": "p", "error": "e"}, {"type": "attempt_started", "run_id": "r", "position_id": "p", "attempt_index": 2}, {"type": "output_delta", "run_id": "r", "position_id": "p", "channel": "content", "text": "he"},
        {"type": "output_delta", "run_id": "r", "position_id": "p", "channel": "content", "text": "llo"}, {"type": "board_result", "run_id": "r", "position_id": "p", "move_score": 7, "optimal_score": 9}, {"type": "run_cancelled", "run_id": "r"},
    ]
    folder = tmp_path / "log"
    folder.mkdir()
    for n, part in enumerate((log[:5], log[5:], log[7:8])):  # the last file replays a result
        (folder / f"{n}.jsonl").write_text("\n".join([*map(json.dumps, part), *(["{broken"] if n == 1 else [])]))
        os.utime(folder / f"{n}.jsonl", (1_700_000_000 + n, 1_700_000_000 + n))  # a file source goes by time

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    own = lambda: live.tail(spark, str(folder), 1)
    assert [tuple(r) for r in run(live.totals(live.events(own())), "complete", "totals")] == [("r", 1, 7, 9)]
    assert [r.value for r in run(live.dead_letters(own()), "append", "dead")] == ["{broken"]
    assert [tuple(r) for r in run(live.finished(live.events(own())), "append", "finished")] == [("r", "run_cancelled")]
    states = run(live.positions(live.events(own())), "update", "states")
    assert (states[-1].status, states[-1].attempt_index, states[-1].move_score, states[-1].content) == ("done", 2, 7, "hello")
    batch = spark.createDataFrame([(i, e["run_id"], e.get("position_id"), e["type"], float(e.get("move_score", 0))) for i, e in enumerate(log)], "seq int, run_id string, position_id string, type string, points double")
    assert [tuple(r) for r in live.progress(batch).collect()] == [("r", 1, 1, 0, 7.0)]


def test_commands(spark, tmp_path, monkeypatch):
    """A dataset is generated, a run prepared, played over recorded replies, shown, exported and another cancelled."""
    from tilegrid import __main__ as cli

    store = f"file://{tmp_path}/store"
    (tmp_path / "words.txt").write_text("\n".join("".join(p) for p in itertools.product("AEIORT", "NSTLRDGE", "AEIO")))
    run = lambda *args: cli.shown(spark, cli.parser().parse_args(["--store", store, *args]))
    monkeypatch.setattr(selfplay, "QUOTAS", {1: 2, 2: 1})
    monkeypatch.setattr(selfplay, "PLIES", 2)
    monkeypatch.setattr(selfplay.dataset, "__defaults__", (None, 2, 20260412, 2, 50))
    asked = ("--mode", "custom", "--lexicon", f"{tmp_path}/words.txt")
    positions = run("dataset", *asked).collect()
    assert [r.band_ply for r in positions] == [1, 1, 2] and len({r.id for r in positions}) == 3
    spark.createDataFrame([("a/m", "M", "a", "2024")], cli.MODEL).write.parquet(f"{store}/models")
    spark.createDataFrame([("codex", "Codex", True)], cli.AGENT).write.parquet(f"{store}/agents")
    run_id = run("prepare-run", *asked, "--model", "a/m", "--effort", "low").first().id
    with pytest.raises(RuntimeError, match="already active"):
        run("prepare-run", *asked, "--model", "a/m")
    assert [r.status for r in run("runs").collect()] == ["queued"] == [run("active-run").first().status]
    (tmp_path / "replies.json").write_text(json.dumps({"position_id": positions[0].id, "attempt_index": 1, "reply": "none", "total_tokens": 5, "latency_ms": 7}))
    row = run("play", *asked, "--model", "a/m", "--run-id", run_id, "--replies", str(tmp_path / "replies.json")).first()
    assert (row.run_id, row.status, row.model_name, row.company_slug, row.reasoning_effort, row.raw_points, row.avg_total_tokens) == (run_id, "completed", "M", "a", "low", 0, 5.0)
    assert run("active-run").collect() == [] and run("leaderboard").count() == 1
    (result,) = run("run", run_id).collect()
    assert (result.position_id, result.raw_response, result.validation_error, result.parsed_move, result.attempt_trace) == (positions[0].id, "none", "Response did not contain JSON.", None, [])
    run("export", "--kind", "run", "--run-id", run_id, "--out", f"{store}/one")
    assert spark.read.option("header", True).csv(f"{store}/one").first().position_id == positions[0].id
    for command in (("run", "nobody"), ("cancel-run", "nobody"), ("export", "--kind", "run", "--run-id", "nobody")):
        with pytest.raises(RuntimeError, match="Unknown run id"):
            run(*command)
    other = run("prepare-run", *asked, "--model", "x").first().id
    assert run("cancel-run", other).first().ok and {r.id: r.status for r in run("runs").collect()} == {run_id: "completed", other: "cancelled"}
    assert [r.source for r in run("search-models", "codex").collect()] == ["cli"] and [r.slug for r in run("search-models", "M").collect()] == ["a/m"]
    assert run("cli-agents").first().id == "codex"


def test_follow_looks_again(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.jsonl").write_text('{"type":"run_started","run_id":"r"}\n')
    seen = []
    query = live.follow(live.events(live.tail(spark, str(tmp_path / "log"))), lambda rows, n: seen.extend(r.type for r in rows.collect()), f"{tmp_path}/state")
    query.processAllAvailable()
    (tmp_path / "log" / "2.jsonl").write_text('{"type":"run_completed","run_id":"r"}\n')
    query.processAllAvailable()
    query.stop()
    assert seen == ["run_started", "run_completed"]
