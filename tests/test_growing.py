"""The source of growing files: every line once, whenever it is completed and however the stream is stopped."""

import random

from tilegrid.streaming import growing


def test_blocks_hand_on_each_line_once(tmp_path):
    rng = random.Random(1)
    data = b"".join(b"x" * rng.choice([0, 1, 5, 40]) + rng.choice([b"\n", b"\r\n", b"\n\n"]) for _ in range(300))
    (tmp_path / "log").write_bytes(data + b"unfinished")
    path = str(tmp_path / "log")
    assert growing.complete(str(tmp_path)) == {path: len(data)}
    for size, start in ((1, 0), (7, 0), (64, 0), (len(data), 0), (13, data.index(b"\n", 500) + 1)):
        found = [line for b in growing.blocks({path: start}, {path: len(data)}, size) for line in growing.lines(str(tmp_path), b)]
        assert [v for v, _ in found] == data[start:].split(b"\n")[:-1] and all(data[at : at + len(v)] == v for v, at in found)


def test_lines_arrive_once_across_restarts(spark, tmp_path):
    log, seen = tmp_path / "log", []
    log.mkdir()

    def poll():
        new = []
        take = lambda rows, n: new.extend((r.path.rsplit("/", 1)[1], r.at, r.value) for r in rows.collect())
        query = growing.tail(spark, f"file://{log}").writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
        query.awaitTermination()
        seen.extend(new)
        return sorted(v for *_, v in new)

    def append(name, data):
        with open(log / name, "ab") as out:
            out.write(data)

    append("a", "one\ntwö\nthr".encode())
    append("_aside", b"not a line of the log\n")
    assert poll() == ["one", "twö"]
    append("a", b"ee\r\nfo")
    append("b", b"\nfirst of b\n")
    assert poll() == ["", "first of b", "three"]
    assert poll() == []
    append("a", b"ur\n")
    append("b", b"bad \xff byte\n" + b"long " * 60_000 + b"\n")
    assert poll() == ["bad � byte", "four", "long " * 60_000]
    (log / "b").write_bytes(b"shorter\n")
    assert poll() == []
    assert sorted(seen) == sorted([*((r.path.rsplit("/", 1)[1], r.at, r.value) for r in growing.held(spark, f"file://{log}").collect() if r.path.endswith("a")), *(s for s in seen if s[0] == "b")])
    assert sorted(v for n, _, v in seen if n == "a") == sorted(r.value for r in spark.read.text(str(log / "a")).collect())


def test_missing_folder_is_empty(spark, tmp_path):
    assert growing.held(spark, str(tmp_path / "none")).collect() == []
