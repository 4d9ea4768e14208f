import datetime
import io
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import operations, shaping
from quillspark.sources import files, sinks
from quillspark.streaming import usage

DOCX = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def word(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", DOCX.format(body))
    return out.getvalue()


def test_files_become_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("größe".encode("utf-16"))
    (tmp_path / "bad.txt").write_bytes(b"\xff\x00\xfe")
    (tmp_path / "c.docx").write_bytes(word("<w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p>"))
    (tmp_path / "d.docx").write_bytes(word("<w:p><w:ins><w:r><w:t>x</w:t></w:r></w:ins></w:p>"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "f.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in.txt", "inner")
        z.writestr("deep.zip", b"PK")
        z.writestr("bomb.txt", "0" * 2_000_000)
    rows = files.read_pages(spark, str(tmp_path)).collect()
    assert {(r.name, r.page, r.text) for r in rows if not r.reason} == {("a.txt", 1, "héllo"), ("b.md", 1, "größe"), ("c.docx", 1, "one"), ("c.docx", 2, "two"), ("in.txt", 1, "inner")}
    assert {r.name: r.reason for r in rows if r.reason}.keys() == {"bad.txt", "d.docx", "e.pdf", "deep.zip", "bomb.txt"}


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "[NaN]", "[1e999]", '["\\ud800"]', "3", "{", "[" * 70 + "]" * 70, "[" + "1," * 20_001 + "1]"])
def test_strict_json_refuses(text):
    with pytest.raises(files.Refused):
        files.strict_json(text)


def test_strict_json_reads():
    assert files.strict_json('{"a": [1, {"b": null}]}') == {"a": [1, {"b": None}]}


def test_guarded_csv_and_blobs(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 1), ("plain", 2), (None, 3)], "v string, n int")
    sinks.guarded_csv(df, str(tmp_path / "csv"), {"v": "3 rows"})
    back = {r.v for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()}
    assert back == {"'=1+1", "plain", "3 rows", None}
    kept = sinks.blobs(spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"y")], "id int, c binary"), "c", str(tmp_path / "blobs"))
    assert kept.count() == 3 and spark.read.parquet(str(tmp_path / "blobs")).count() == 2


def test_blocks_are_lossless_and_chunks_cover(spark):
    text = "".join(f"word{i} " + ("\n\n" if i % 50 == 0 else "") for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x" * 500)], "doc_id long, text string")
    got = shaping.blocks(docs, 400).orderBy("doc_id", "block").collect()
    assert "".join(r.text for r in got if r.doc_id == 1) == text and all(len(r.text) <= 400 for r in got if r.text)
    assert [r.block for r in got if r.doc_id == 4] == [-1]
    pieces = [r for r in shaping.chunks(docs).orderBy("chunk").collect() if r.doc_id == 1]
    clean = docs.select(shaping.clean_text(F.col("text")).alias("t")).first().t
    at = 0
    for p in pieces:
        found = clean.index(p.text, max(0, at - 400))
        assert found <= at
        at = found + len(p.text)
    assert at == len(clean) and len(pieces) == pieces[0].chunks > 1


def test_excerpts_hold_the_best_sentence():
    text = "First one. " * 30 + "The knee hurts badly. " + "Last one. " * 30
    found = shaping.excerpt(text, {"knee", "hurts"}, 100)
    slice_ = found.removeprefix(shaping.EARLIER).removesuffix(shaping.LATER)
    assert "The knee hurts badly." in slice_ and len(slice_) <= 100 and slice_ in text and slice_ != found
    lines = "Seen in May.\n\nKnee  hurt.\tAgain \n\nthen well. Left knee hurt in June, badly. The end of it"
    assert shaping.excerpt(lines, {"knee", "june"}, 60) == f"{shaping.EARLIER}Again \n\nthen well. Left knee hurt in June, badly.{shaping.LATER}"
    assert shaping.excerpt("short", set(), 10) == "short" and shaping.excerpt("x" * 50, set(), 10) == ""


def replay(events, lease=900, most=3):
    status, attempts, beat = "queued", 0, 0.0
    for at, kind in events:
        held = status == "running" and at - beat <= lease
        if kind == "claim" and (status == "queued" or status == "running" and not held):
            status, attempts, beat = ("abandoned", attempts, beat) if attempts >= most else ("running", attempts + 1, at)
        elif held and kind == "beat":
            beat = at
        elif held and kind in ("done", "fail", "release"):
            status, attempts = {"done": "done", "fail": "failed", "release": "queued"}[kind], attempts - (kind == "release")
    return status, attempts


def test_leases_in_batch_and_stream(spark, tmp_path):
    import random

    rng = random.Random(8)
    jobs = {j: [(float(600 * k + rng.randrange(500)), rng.choice(["claim", "claim", "beat", "done", "fail", "release"])) for k in range(12)] for j in range(40)}
    rows = [(j, k, at, kind) for j, e in jobs.items() for k, (at, kind) in enumerate(e)]
    df = spark.createDataFrame(rows, "job_id long, seq long, at double, kind string")
    wanted = {j: replay(e) for j, e in jobs.items()}
    assert {r.job_id: (r.status, r.attempts) for r in operations.leases(df).collect()} == wanted
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = usage.leases(stream).writeStream.outputMode("update").format("memory").queryName("leased").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.job_id: (r.status, r.attempts) for r in spark.sql("SELECT * FROM leased").collect()} == wanted


def streamed(spark, batches, schema, query, name, tmp_path, mode="append"):
    """What a query on a stream wrote, its files read one after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = query(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_sessions_end_after_the_gap(spark, tmp_path):
    at = lambda minute, second=0: datetime.datetime(2024, 1, 1, 0, minute, second)
    batches = [[(at(0), 1), (at(4), 1), (at(0), 2)], [(at(8, 59), 1), (at(14), 1), (at(59), 3)], [(at(59, 30), 3)], [(at(1), 2)]]
    got = {(r.user_id, r.start, r.end, r.n) for r in streamed(spark, batches, "ts timestamp, user_id long", usage.sessions, "sessions_seen", tmp_path)}
    # The last row comes a batch after its session was closed, and user 3's session is still open.
    assert got == {(1, at(0), at(13, 59), 3), (1, at(14), at(19), 1), (2, at(0), at(5), 1)}


def test_a_key_comes_in_once(spark, tmp_path):
    at = lambda hour: datetime.datetime(2024, 1, 1, hour)
    batches = [[(at(0), "a"), (at(0), "b"), (at(1), "a")], [(at(2), "b"), (at(2), "c")], [(at(3), "a"), (at(3), None), (at(4), None)]]
    got = streamed(spark, batches, "ts timestamp, k string", lambda s: usage.once(s, "k"), "keys_seen", tmp_path)
    assert Counter(r.k for r in got) == Counter(["a", "b", "c", None])


def test_windowed_usage_stream(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "e"))
    q = usage.usage(usage.events(spark, str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("used").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(calls) FROM used").first()[0] == 1000
