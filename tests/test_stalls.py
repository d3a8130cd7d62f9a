"""Silence told by timers, under a clock that the test moves."""

import random

import duckdb
import pandas as pd
import pytest

from tilegrid.plans import catalogue
from tilegrid.streaming.stalls import Silence


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Clock:
    """The store of one key, its timers and the time."""

    def __init__(self):
        self.now, self.value, self.timers = 0, Value(), set()

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.due


def life(own_clock, steps):
    """What is told for steps of (time, lines as seq and time); at each, timers that are due come last, as in a batch."""
    clock, told = Clock(), []
    silence = Silence(["run"], 60, own_clock)
    silence.init(clock)
    take = lambda frames: told.extend((clock.now, *r) for f in frames for r in f.astype(object).where(f.notna(), None).drop(columns="run").itertuples(index=False, name=None))
    for clock.now, lines in steps:
        if lines:
            take(silence.handleInputRows(("r",), iter([pd.DataFrame(lines[:1], columns=["line_seq", "line_at"]), pd.DataFrame(lines[1:], columns=["line_seq", "line_at"])]), clock))
        for due in sorted(t for t in clock.timers if t <= clock.now):
            clock.due = due
            clock.timers.remove(due)
            take(silence.handleExpiredTimer(("r",), clock, clock))
    return told


def test_silence_is_told_once_and_late_lines_revive():
    told = life(False, [(1_000, [(1, None)]), (30_000, [(2, None)]), (90_000, []), (90_001, []), (91_000, []), (200_000, []), (200_500, [(3, None), (4, None)]), (260_500, [(5, None)]), (320_600, []), (400_000, [(6, None)])])
    assert told == [(90_001, "stalled", 30_000, None, None), (200_500, "revived", 30_000, 170, 3), (320_600, "stalled", 260_500, None, None), (400_000, "revived", 260_500, 139, 6)]


def test_the_logs_own_clock():
    """Gaps within a batch are told both ways at once; lines of a batch are put in order."""
    told = life(True, [(0, [(2, 10_000), (1, 5_000), (4, 200_000), (3, 70_000)]), (200_000, []), (260_001, []), (300_000, [(5, 261_000)]), (300_001, [(6, 270_000)])])
    assert told == [(0, "stalled", 70_000, None, None), (0, "revived", 70_000, 130, 4), (260_001, "stalled", 200_000, None, None), (300_000, "revived", 200_000, 61, 5)]


class Marked(Clock):
    """The store of one group, whose watermark is the time; counts what it is asked."""

    asked = 0

    def getCurrentWatermarkInMs(self):
        return self.now

    def registerTimer(self, at):
        self.asked += 1
        super().registerTimer(at)

    def deleteTimer(self, at):
        self.asked += 1
        super().deleteTimer(at)


@pytest.mark.parametrize("own_clock", [False, True])
def test_keys_of_a_group_are_told_as_each_alone(own_clock):
    """Calls and timers don't grow in number with the keys of a group; no key at all is one of them."""
    rng, runs, steps = random.Random(4), [None, *range(60)], []
    for n in range(30):
        heard = [] if n % 5 == 4 else rng.sample(runs, 20)
        steps.append((n * 25_000, {run: [(10 * n + k, rng.randrange(max(n - 4, 0) * 25_000, n * 25_000 + 1)) for k in rng.sample(range(10), rng.choice((1, 2, 5)))] for run in heard}))
    clock, silence, told = Marked(), Silence(["run"], 60, own_clock, grouped=True), []
    silence.init(clock)
    take = lambda frames: told.extend((clock.now, *r) for f in frames for r in f.astype(object).where(f.notna(), None)[["run", "kind", "since_ms", "gap_seconds", "seq"]].itertuples(index=False, name=None))
    for clock.now, lines in steps:
        if lines:
            rows = [(run, *line) for run, own in lines.items() for line in own]
            rng.shuffle(rows)
            take(silence.handleInputRows((7,), iter([pd.DataFrame(rows[i::2], columns=["run", "line_seq", "line_at"]) for i in (0, 1)]), clock))
        for clock.due in sorted(t for t in clock.timers if t <= clock.now):
            clock.timers.remove(clock.due)
            take(silence.handleExpiredTimer((7,), clock, clock))
        assert len(clock.timers) <= 1
    want = {run: life(own_clock, [(now, lines.get(run)) for now, lines in steps]) for run in runs}
    assert {run: [(now, *t) for now, r, *t in told if r == run] for run in runs} == want
    assert clock.asked <= 3 * len(steps) and sum(map(len, want.values())) > 100


def test_no_line_of_a_log_is_late(spark, tmp_path):
    """Runs whose lines have higher numbers and the same times as others', and one whose times don't follow its numbers."""
    rng, rows = random.Random(6), []
    for copy in range(4):
        for n, at in enumerate(sorted(rng.randrange(0, 3_000_000) for _ in range(60))):
            rows.append((1000 * copy + n, at, 10 * copy + rng.randrange(4)))
    rows += [(5000 + n, rng.randrange(0, 3_000_000), 99) for n in range(40)]
    frame = pd.DataFrame(rows, columns=["event_id", "ms", "user_id"])  # noqa: F841
    db = duckdb.connect()
    db.execute("CREATE TABLE events AS SELECT event_id, make_timestamp(1704067200000000 + ms * 1000) AS ts, user_id, 'view' AS event_type, 1.0 AS value, '{\"k\": 1}' AS props FROM frame")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    made = catalogue.queries()["stream_stalls"](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(made.columns)} FROM ({catalogue.oracle_sql()['stream_stalls']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in made.collect()))) == sorted(map(str, want)) and len(want) > 100
