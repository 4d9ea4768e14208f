"""Interval joins, restored backups, resumed runs and ranges of series against plain versions."""

import hashlib
import math
import os
import random

from pyspark.sql import functions as F

from quillspark.operators import intervals, operations
from quillspark.sources import resume


def test_points_in_intervals(spark):
    rng = random.Random(1)
    spans = [(k, rng.choice("ab"), low := rng.randrange(-50, 300), low + rng.choice([0, 1, 2, 3, 4, 5, 8, 17, 200, 5000, -3])) for k in range(200)] + [(900, "a", None, 5), (901, None, 0, 5), (902, "a", -(1 << 40), 1 << 40)]
    points = [(k, rng.choice("ab"), rng.randrange(-60, 400)) for k in range(300)] + [(999, "a", None), (998, None, 3)]
    i = spark.createDataFrame(spans, "i int, k string, low long, high long")
    p = spark.createDataFrame(points, "p int, k string, at long")
    got = sorted((r.p, r.i) for r in intervals.points_in(p, i, keys=("k",)).collect())
    assert got == sorted((a, b) for a, k, at in points for b, j, low, high in spans if None not in (k, at, low) and k == j and low <= at < high)
    assert intervals.points_in(p, i.limit(0), keys=("k",)).count() == 0
    free = intervals.points_in(p.drop("k"), i.drop("k").where("i = 902"))
    assert free.count() == 301


def key(name, tag, start, data, sha=None, end=None):
    return f"audit/2024/05/06/live-{name}{'-g' + tag if tag else ''}-{start}-{end or start + len(data)}-{sha or hashlib.sha256(data).hexdigest()[:12]}.jsonl"


def test_keys_of_backups(spark):
    keys = [key("a-b.log", "0f", 3, b"xyz"), key("a.log", "", 3, b"xyz"), "audit/2024/05/06/rotated-a-1.log-77-0123456789ab.jsonl", "audit/2024/5/06/live-a-1-2-0123456789ab.jsonl", None]
    got = [r.p and (r.p.kind, r.p.date, r.p.filename, r.p.generation, r.p.start, r.p.end, r.p.size) for r in spark.createDataFrame([(k,) for k in keys], "k string").select(intervals.key_parts(F.col("k")).alias("p")).collect()]
    assert got == [("live", "2024/05/06", "a-b.log", "0f", 3, 6, None), ("live", "2024/05/06", "a.log", "unknown", 3, 6, None), ("rotated", "2024/05/06", "a-1.log", None, None, None, 77), None, None]


def test_restored_bytes_are_those_of_a_replay(spark):
    rng = random.Random(3)
    rows, files = [], {}
    for n in range(240):
        name, tag = rng.choice(["x", "y.log"]), "ab"[n // 60 % 2]
        start, data = rng.randrange(0, 120), bytes(rng.randrange(97, 123) for _ in range(rng.choice([1, 5, 30, 90])))
        bad = n % 19 == 0
        rows.append((n, key(name, tag, start, data, *([("0" * 12)] if bad else [])), n // 2, bytearray(data)))
        if not bad:
            files.setdefault(name, []).append((n // 2, start, start + len(data), n, tag, data))
    rows += [(900, key("x", "a", 0, b"abc", end=9), 1, bytearray(b"abc")), (901, "no key", 1, bytearray(b"abc")), (902, key("x", "a", 0, b"abc"), 1, None)]
    df = spark.createDataFrame(rows, "id int, key string, uploaded int, content binary").repartition(5)
    for cell in (16, 1 << 24):
        pieces, report = intervals.restored(df, cell)
        got = {}
        for r in sorted(pieces.collect(), key=lambda r: (r.file, r.island, r.start)):
            held = got.setdefault((r.file, r.island), {})
            assert len(r.data) == r.end - r.start and not held.keys() & set(range(r.start, r.end))
            held.update(zip(range(r.start, r.end), bytes(r.data)))
        told = {r.file: r for r in report.collect()}
        for name, windows in files.items():
            windows.sort()
            island, last, plain, owner = -1, None, {}, {}
            for _, start, _, n, tag, data in windows:  # by upload, start, end
                island += tag != last
                last = tag
                plain.setdefault(island, {})
                owner.setdefault(island, {})
            island, last = -1, None
            for up, start, _, n, tag, data in windows:
                island += tag != last
                last = tag
                for k, b in enumerate(data):
                    if owner[island].get(start + k, (-1, -1)) < (up, n):
                        plain[island][start + k], owner[island][start + k] = b, (up, n)
            assert {i: got[name, i] for i in plain} == plain
            used = {n for held in owner.values() for _, n in held.values()}
            r = told[name]
            holes = sum(sum(1 for b in held if b and b - 1 not in held) + (0 not in held and 0) for held in plain.values())
            assert (r.generations, r.superseded, r.uncertain) == (island + 1, len(windows) - len(used), False) and r.holes == holes
            assert r.missing == sum(max(held) + 1 - len(held) for held in plain.values())
        assert told["x"].damaged == sum("0" * 12 in k and "live-x" in k for _, k, _, _ in rows) + 2
    same = spark.createDataFrame([(1, key("z", "a", 0, b"ab"), 5, bytearray(b"ab")), (2, key("z", "b", 0, b"cd"), 5, bytearray(b"cd"))], "id int, key string, uploaded int, content binary")
    assert intervals.restored(same)[1].first().uncertain and intervals.restored(same.limit(0))[1].count() == 0


def test_a_run_goes_on_where_one_ended(spark, tmp_path):
    state, seen = str(tmp_path / "state"), spark.sparkContext.accumulator(0)
    mark = resume.fingerprint("path", "text")

    def work(rows):
        @F.udf("long")
        def size(text):
            seen.add(1)
            return len(text or "")

        return rows.withColumn("n", size("text")).drop("text")

    def run(inputs):
        before = seen.value
        out = sorted((r.path, r.n) for r in resume.resumed(spark.createDataFrame(inputs, "path string, text string"), state, mark, work).collect())
        return out, seen.value - before

    first = [("a", "one"), ("b", "three"), ("c", None)]
    assert run(first) == ([("a", 3), ("b", 5), ("c", 0)], 3)
    assert run(first) == ([("a", 3), ("b", 5), ("c", 0)], 0)
    assert run([("a", "one"), ("b", "threes"), ("d", "x"), ("c", "")]) == ([("a", 3), ("b", 6), ("c", 0), ("d", 1)], 3)
    # A run that dies while it writes leaves the state as it was.
    parts = sorted(os.listdir(f"{state}/parts"))

    @F.udf("long")
    def fails(text):
        raise ValueError("lost")

    try:
        resume.resumed(spark.createDataFrame([("e", "new")], "path string, text string"), state, mark, lambda rows: rows.withColumn("n", fails("text")).drop("text"))
        raise AssertionError("it should have failed")
    except Exception as e:
        assert "lost" in str(e)
    assert sorted(os.listdir(f"{state}/parts")) == parts and run([("e", "new")]) == ([("e", 3)], 1)


def test_fingerprints_keep_borders(spark):
    rows = [("a", "bc"), ("ab", "c"), ("abc", None), ("abc", ""), (None, "abc"), ('a","b', "c"), ("a", 'b","c')]
    assert len({r[0] for r in spark.createDataFrame(rows, "x string, y string").select(resume.fingerprint("x", "y")).collect()}) == len(rows)


def test_ranges_of_a_counter(spark):
    rng = random.Random(5)
    series = {k: sorted({t: rng.randrange(0, 30) for t in rng.sample(range(400), 60)}.items()) for k in "ab"}
    rows = [(k, t, v) for k, s in series.items() for t, v in s] + [("a", series["a"][3][0], -1), ("c", 1, None)]
    got = {(r.k, r.t): r for r in operations.over_range(spark.createDataFrame(rows, "k string, t int, v int"), ["k"], "t", "v", 50).collect()}
    for k, s in series.items():
        for t, v in s:
            inside = [x for u, x in s if t - 50 < u <= t]
            steps = list(zip(inside, inside[1:]))
            r = got[k, t]
            assert (r.increase, r.changes, r.max_over_time) == (sum(b if b < a else b - a for a, b in steps), sum(a != b for a, b in steps), max(inside)) and r.rate == r.increase / 50


def test_quantiles_of_histograms(spark):
    inf = math.inf
    hist = {"a": [(1.0, 2), (5.0, 2), (10.0, 10), (inf, 10)], "b": [(1.0, 0), (inf, 4)], "c": [(1.0, 0), (inf, 0)], "d": [(1.0, 3)], "e": [(-2.0, 1), (3.0, 4), (inf, 5)]}
    df = spark.createDataFrame([(k, le, n) for k, h in hist.items() for le, n in h], "k string, le double, count long")
    at = lambda q: {r.k: r.value for r in operations.histogram_quantile(df, ["k"], q).collect()}
    assert at(0.5) == {"a": 5 + 5 * 3 / 8, "b": 1.0, "c": None, "d": None, "e": -2 + 5 * 1.5 / 3}
    assert at(0.1) == {"a": 0.5, "b": 1.0, "c": None, "d": None, "e": -2.0} and at(0.99)["e"] == 3.0
