"""Files by their metadata, archives that lie about sizes, tails of rotated logs, a pluggable model, and what a log may keep."""

import io
import json
import os
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import guarding, inference
from quillspark.operators import operations as ops
from quillspark.sources import discovery, files


@pytest.fixture
def folder(tmp_path):
    for name, n in {"a.txt": 10, "B.MD": 20, "sub/a.txt": 30, "sub/.hidden.txt": 5, ".git/c.txt": 5, "sub/note.csv": 5, "out/done.txt": 5, "plain": 7, "out.d/x.txt": 9}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x" * n)
    return tmp_path


def test_discovery_takes_records_once(spark, folder):
    paths = [str(folder), str(folder / "sub" / "note.csv"), str(folder / "sub"), str(folder / "plain")]
    found = {r.label: r.length for r in discovery.discovered(spark, paths, str(folder / "out")).collect()}
    assert found == {"a.txt": 10, "B.MD": 20, "sub/a.txt": 30, "out.d/x.txt": 9, "note.csv": 5, "plain": 7}
    assert discovery.discovered(spark, []).count() == 0


def greedy(rows, most_file, most_total):
    out, used = {}, 0
    for n, path in sorted((n, path) for path, n in rows):
        fits = n <= most_file and used + n <= most_total
        out[path] = "too large" if n > most_file else "" if fits else "over the total"
        used += n * fits
    return out


@pytest.mark.parametrize("most_total", [0, 1, 5_000, 60_000, 61_111, 10_000_000])
def test_admission_is_the_greedy_walk(spark, most_total):
    rng = random.Random(5)
    rows = [(f"f{i:04}", rng.choice([0, 1, 700, 701, 4096, 5000, 5000, 5000, 9000, 20_000])) for i in range(60)]
    df = spark.createDataFrame([(p, p, n) for p, n in rows], "path string, label string, length long")
    assert {r.path: r.reason for r in discovery.admitted(df, 15_000, most_total).collect()} == greedy(rows, 15_000, most_total)


def test_only_what_can_be_taken_is_opened(spark, folder):
    (folder / "huge.txt").write_bytes(b"y" * 5000)
    taken = discovery.admitted(discovery.discovered(spark, [str(folder)], str(folder / "out")), 1000, 45)
    read = discovery.contents(spark, [str(folder)], taken)
    # The reader raises an error for a file over this size if it opens it.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "25")
    try:
        assert {r.label: len(r.content) for r in read.collect()} == {"a.txt": 10, "B.MD": 20, "out.d/x.txt": 9}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert discovery.contents(spark, [str(folder)], taken.where("false")).count() == 0


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(f"{name}.txt", data)
    return bytearray(out.getvalue())


def test_sizes_are_counted_not_believed(monkeypatch):
    noise = os.urandom(3000)
    data = archive(good=b"fine", lies=noise, after=b"also fine")
    for mark, place in ((b"PK\x03\x04", 22), (b"PK\x01\x02", 24)):
        at = data.find(mark, data.find(b"lies.txt") - 50 if mark == b"PK\x03\x04" else data.find(mark) + 10)
        assert struct.unpack_from("<I", data, at + place)[0] == 3000
        struct.pack_into("<I", data, at + place, 7)
    found = {name: (content, why) for name, content, why in files.members(bytes(data))}
    assert found["good.txt"] == (b"fine", "") and found["after.txt"] == (b"also fine", "")
    assert found["lies.txt"] == (None, "header gives another size")
    monkeypatch.setattr(files, "MOST_MEMBER", 2000)
    monkeypatch.setattr(files, "CHUNK", 512)
    assert {n: w for n, _, w in files.members(bytes(data))}["lies.txt"] == "too large when expanded"
    monkeypatch.setattr(files, "MOST_EXPANDED", 10)
    monkeypatch.setattr(files, "MOST_RATIO", 10_000)
    with pytest.raises(ValueError, match="expanded"):
        list(files.members(bytes(archive(a=b"x" * 6, b=b"y" * 6))))
    monkeypatch.setattr(files, "MOST_MEMBERS", 1)
    with pytest.raises(ValueError, match="too many"):
        list(files.members(bytes(archive(a=b"x", b=b"y"))))


def test_tail_stops_when_it_has_enough(spark, tmp_path):
    log = str(tmp_path / "run.jsonl")
    every = [json.dumps({"n": n, "request_id": f"req_{n % 3:012x}"}) for n in range(30)]
    for name, some in ((log + ".2", every[:10]), (log + ".1", [*every[10:20], "{broken", ""]), (log, [*every[20:], "no json"])):
        with open(name, "w", encoding="utf-8") as f:
            f.write("\n".join(some) + "\n")
    (tmp_path / "run.jsonl.old").write_text("[]\n")
    for limit, opened in ((5, 1), (10, 1), (11, 2), (25, 3), (99, 3), (0, 0)):
        events, broken, n = discovery.recent(spark, log, limit)
        assert [r.line for r in events.collect()] == (every[-limit:] if limit else []) and n == opened
        assert {r.line for r in broken.collect()} == {0: set(), 1: {"no json"}}.get(opened, {"no json", "{broken"})
    found = discovery.looked_up(spark, log, "It failed (ref REQ_000000000001), sorry", most=4).collect()
    assert [json.loads(r.line)["n"] for r in found] == [19, 22, 25, 28] and all(r.truncated for r in found)
    assert discovery.looked_up(spark, log, "no reference").count() == 0 and discovery.recent(spark, log + "x")[2] == 0


def test_a_failing_model_costs_only_its_batch(spark):
    facts = spark.createDataFrame([(i, f"seen {1990 + i}" if i % 2 else None, None) for i in range(10)], "id int, description string, quote string").coalesce(1)
    got = {r.id: (r.iso, r.precision, r.state) for r in inference.inferred_dates(facts, "id").collect()}
    assert got == {i: (f"{1990 + i}-01-01", "year", "inferred") if i % 2 else (None, None, "none") for i in range(10)}
    calls = []

    def model(items):
        calls.append(len(items))
        if any("1995" in str(i["description"]) for i in items):
            raise OSError("gone")
        if len(calls) == 1:
            return {"dates": "none"}
        return {"dates": [7, {"index": 99, "date": "2001"}, {"index": True, "date": "2002"}, {"index": 0, "date": "2003-04"}, {"index": 1, "date": "soon"}, {"index": 2, "date": None}]}

    got = {r.id: (r.iso, r.state) for r in inference.inferred_dates(facts, "id", model, 4).collect()}
    assert {i: s for i, (_, s) in got.items()} == {0: "inferred", 1: "none", 2: "none", 3: "unanswered", 4: "lost", 5: "lost", 6: "lost", 7: "lost", 8: "inferred", 9: "none"}
    assert got[0][0] == "2003-04-01"
    assert inference.answers([{"index": 0, "description": "1995", "quote": ""}], model) is None


def test_logs_keep_counts_and_known_words(spark):
    cases = {
        '{"pages": 3, "calls": 1.5, "facts": true, "message": "John", "path": "/x"}': {"pages": 3, "calls": 1.5, "facts": True},
        '{"pages": "3", "status": "ok", "action": "delete", "request_id": "req_0123456789ab"}': {"status": "ok", "request_id": "req_0123456789ab"},
        '{"status": ["ok"], "request_id": "req_0123456789ab\\n", "chunks": {"a": 1}, "retries": null}': {},
        "[1]": {}, "{broken": {}, None: {},
    }
    df = spark.createDataFrame([(c,) for c in cases], "r string").select("r", guarding.loggable(F.col("r")).alias("k"))
    assert {r.r: json.loads(r.k) for r in df.collect()} == cases


def test_exposition_tells_what_is_unknown_from_nothing(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", None), ("c", float("nan")), ("d", float("inf")), (None, float("-inf"))], "x string, v double")
    got = {r.line for r in ops.exposition(df, "m", "gauge", "two\nlines", ["x"], "v").collect()}
    assert got == {"# HELP m two\\nlines", "# TYPE m gauge", 'm{x="a"} 1.5', 'm{x="c"} NaN', 'm{x="d"} +Inf', 'm{x=""} -Inf'}
