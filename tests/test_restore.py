"""Backups restored: how often a key is read, and windows that meet the border of a batch."""

import hashlib
import random

import pyarrow as pa

from quillspark.operators import intervals


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_key_is_read_once_and_windows_are_not_joined_with_themselves(spark):
    known = intervals.verified(spark.createDataFrame([(1, "no key", bytearray(b"x"))], "id int, key string, content binary"))
    assert plan(known.where("parts IS NOT NULL AND parts.kind = 'live'").select("parts.filename", "parts.generation", "wrong")).count("RLIKE") == 3
    placed = spark.createDataFrame([("f", 0, 1, 1, 0, 5)], "file string, island int, id int, uploaded int, start long, end long")
    assert "Join" not in plan(intervals.covers(placed))


def test_the_last_turn_wins_over_borders_of_batches():
    rng = random.Random(2)
    rows = []
    for file, island, cell in [("a", 0, 0), ("a", 0, 1), ("a", 1, 1), ("b", 1, 1)]:
        own = [(low, low + rng.choice([1, 2, 7, 40])) for low in (rng.randrange(60) for _ in range(40))]
        turns = rng.sample(range(40), 40)
        rows += sorted((file, island, cell, low, high, turn, f"w{turn}") for (low, high), turn in zip(own, turns, strict=True))
    types = pa.schema([("file", pa.string()), ("island", pa.int64()), ("cell", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turn", pa.int32()), ("window", pa.string())])
    wanted = {}
    for file, island, cell, low, high, turn, _ in rows:
        for at in range(low, high):
            key = (file, island, cell, at)
            wanted[key] = max(wanted.get(key, -1), turn)
    plain = sorted((file, island, at, f"w{turn}") for (file, island, _, at), turn in wanted.items())
    for size in (1, 3, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in rows[k : k + size]], schema=types) for k in range(0, len(rows), size)]
        got = [r for b in intervals._newest(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["file"], r["island"], at, r["window"]) for r in got for at in range(r["from"], r["upto"])) == plain
    assert not list(intervals._newest(iter([])))


def test_a_report_goes_through_the_runs_once(spark):
    rows = [(1, "no key", 1, bytearray(b"x"))]
    report = intervals.restored(spark.createDataFrame(rows, "id int, key string, uploaded int, content binary"))[1]
    assert plan(report).count("MapInArrow") == 1 and report.count() == 0


def test_a_report_reads_each_window_once_and_matches_its_key_once(spark):
    def row(n, name, tag, start, data, fits=True):
        sha = hashlib.sha256(data).hexdigest()[:12] if fits else "0" * 12
        return n, f"audit/2024/05/06/live-{name}-g{tag}-{start}-{start + len(data)}-{sha}.jsonl", n, bytearray(data)

    rows = [row(1, "a", "0", 0, b"abc"), row(2, "a", "0", 1, b"x"), row(3, "a", "0", 0, b"xyz"), row(4, "a", "0", 5, b"q", False), row(5, "a", "1", 2, b"ab"), row(6, "a", "0", 9, b"")]
    rows += [row(7, "hurt", "0", 0, b"abc", False), row(8, "none", "0", 4, b""), row(9, "far", "0", 0, b"ab"), row(10, "far", "0", 40, b"cd"), (11, "no key", 11, bytearray(b"x"))]
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(counted), "id int, key string, uploaded int, content binary")
    for cell in (2, 1 << 24):
        report = intervals.restored(df, cell)[1]
        before = seen.value
        got = sorted(tuple(r) for r in report.select("file", "windows", "damaged", "superseded").collect())
        assert got == [("a", 6, 1, 3), ("far", 2, 0, 0), ("hurt", 1, 1, 0), ("none", 1, 0, 1)] and seen.value == before + len(rows)
        more = sorted(tuple(r) for r in report.select("file", "generations", "holes", "missing", "uncertain").collect())
        assert more == [("a", 3, 1, 2, False), ("far", 1, 1, 38, False), ("hurt", 0, 0, 0, False), ("none", 1, 0, 0, False)] and seen.value == before + 2 * len(rows)
    read = plan(df.select(intervals.key_parts(df.key).alias("parts")))
    assert "regexp_extract" not in read and read.count("regexp_replace") == 3
