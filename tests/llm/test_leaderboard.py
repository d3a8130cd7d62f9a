"""The change feed of the leaderboard against a plain replay, on odd rows and on several levels of a tree."""

import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tilegrid.llm import leaderboard

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp, batch int, nation_id int, cents string"
ITEMS, VENDORS = "item_id long, price double, known string", "vendor_id long, nation_id int, batch string"


def replayed(lines, items, vendors):
    """All changes, by keeping every revenue and sorting every board after each day."""
    price, home = defaultdict(list), defaultdict(list)
    for i, p, _ in items:
        price[i].append(p)
    for v, n, _ in vendors:
        home[v].append(n)
    least = lambda values: min((v for v in values if v is not None), default=None)
    batches = defaultdict(list)
    for sale, no, item, vendor, quantity, amount, flag, at, *_ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, no)).encode())
        s = 19723 + h % 150 if at is None else (at - datetime(1970, 1, 1)).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        batch = min(10, max(1, 1 + math.floor((a - 19723) * 10 / 180)))
        p = least(price.get(item, []))
        cents = math.floor(100 * amount + 0.5) if amount is not None else quantity * math.floor(100 * p + 0.5) if quantity is not None and p is not None else 0
        nation = least(home.get(vendor, [])) if item in price and item is not None and vendor is not None else None
        batches[batch].append((s, a, nation, item, -cents if flag == "swapped" else cents))
    revenue, boards, seen, out = defaultdict(lambda: defaultdict(int)), defaultdict(list), None, []
    for batch, rows in sorted(batches.items()):
        days = defaultdict(list)
        for s, a, nation, item, cents in rows:
            if nation is not None and (seen is None or s + 3 >= seen):
                days[a].append((nation, item, cents))
        for a in sorted(days):
            for nation, item, cents in days[a]:
                revenue[nation][item] += cents
            for nation in {n for n, _, _ in days[a]}:
                new = [i for m, i in sorted((-m, i) for i, m in revenue[nation].items() if m > 0)[:10]]
                old, boards[nation] = boards[nation], new
                for item in {*old, *new}:
                    ranks = [b.index(item) + 1 if item in b else None for b in (old, new)]
                    if ranks[0] != ranks[1]:
                        out.append((nation, a, item, batch, "enter" if ranks[0] is None else "exit" if ranks[1] is None else "move", *ranks, revenue[nation][item]))
        seen = max([*(r[0] for r in rows), *([] if seen is None else [seen])])
    return sorted(out, key=str)


def told(spark, lines, items, vendors):
    made = leaderboard.leaderboard_changes(spark.createDataFrame(lines, LINES), spark.createDataFrame(items, ITEMS), spark.createDataFrame(vendors, VENDORS))
    assert made.dtypes == [("nation_id", "int"), ("arrival_day", "bigint"), ("item_id", "bigint"), ("batch", "int"), ("change", "string"), ("old_rank", "int"), ("new_rank", "int"), ("revenue", "bigint")]
    return sorted((tuple(r) for r in made.collect()), key=str)


def shop(seed, n_lines, n_items):
    rng = random.Random(seed)
    or_none = lambda x: None if rng.random() < 0.03 else x
    day = lambda: datetime(2024, 1, 1) + timedelta(days=rng.randrange(150), seconds=rng.randrange(86400))
    item = lambda: 7 if rng.random() < 0.3 else rng.randrange(n_items + 3)
    lines = [(or_none(rng.randrange(999)), or_none(rng.randrange(7)), or_none(item()), or_none(rng.randrange(9)), or_none(rng.randrange(50)), or_none(rng.randrange(1, 900) / 4), or_none(rng.choice(["kept", "swapped"])), or_none(day()), 1, 1, "x") for _ in range(n_lines)]
    lines += rng.choices(lines, k=n_lines // 10) + [(1, 1, 1, 1, 1, 1.0, "kept", datetime(2023, 12, 1), 1, 1, "x")]
    items = [(i, or_none(rng.randrange(100, 9000) / 100), "x") for i in range(n_items)]
    vendors = [(v, or_none(v % 3), "x") for v in range(8)]
    return lines, items + [(3, 1.0, "x"), (None, 2.0, "x")], vendors + [(2, 1, "x"), (None, 1, "x")]


@pytest.mark.parametrize(("leaf", "fan"), [(4, 3), (2048, 32)])
def test_feed_is_that_of_a_replay(spark, monkeypatch, leaf, fan):
    """Odd rows all along; with small leaves and nodes the tree has four levels."""
    monkeypatch.setattr(leaderboard, "LEAF", leaf)
    monkeypatch.setattr(leaderboard, "FAN", fan)
    rows = shop(leaf, 1500, 60)
    want = replayed(*rows)
    assert told(spark, *rows) == want and {r[4] for r in want} == {"enter", "exit", "move"} and len({r[3] for r in want}) > 7


def test_empty_tables(spark):
    assert told(spark, [], [], []) == []
    assert told(spark, [(1, 1, 1, 1, 1, 1.0, "kept", datetime(2024, 2, 1), 1, 1, "x")], [], []) == []
