"""Queries over all rows of small tables, against plain Python."""

import datetime
import re

import pytest

from quillspark.plans import catalog

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders 1 to 40 of four customers: the keys of three customers are never multiples of four."""
    day = datetime.datetime(2020, 3, 1)
    rows = [(k, k % 4, "FOP"[k % 3], 10_000.0 * (k % 2), day, ["1-URGENT", "2-HIGH", "5-LOW"][k % 3]) for k in range(1, 41)]
    d = tmp_path_factory.mktemp("orders")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    return str(d), rows


def test_every_fact_gets_its_citation(spark, orders):
    from quillspark.sources import tables

    sf, rows = orders
    facts = sorted(tables.facts(spark, sf).collect(), key=lambda f: f.seq)
    wanted = {f.seq: next(o.source for o in facts if (o.date, o.description) == (f.date, f.description)) for f in facts}
    got = QUERIES["join_06_all_restored_citations"](spark, sf).collect()
    assert len(got) == len(rows) and {r.id: r.source for r in got} == wanted


def test_titles_of_every_order_are_padded(spark, orders):
    sf, rows = orders
    wanted = set()
    for case in {r[1] for r in rows}:
        own = list(dict.fromkeys(r[5] for r in rows if r[1] == case))
        more = [t for t in ("2-HIGH", "read it aloud", "add dates") if t not in own]
        wanted |= {(case, t, k) for k, t in enumerate((own + more)[: max(3, min(5, len(own)))], 1)}
    got = QUERIES["ded_07_all_padded"](spark, sf).collect()
    assert {(r.case_id, r.title, r.place) for r in got} == wanted and len(got) == len(wanted)


def test_every_event_falls_into_an_interval(spark, tmp_path):
    ids = [0, 1, 499, 500, 501, 9_999, 10_000, 10_001, 25_000]
    rows = [(k, datetime.datetime(2024, 1, 1), 1, "view", 0.1 * n) for n, k in enumerate(ids, 1)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    wanted = {}
    for n, k in enumerate(ids, 1):
        wanted[k // 500] = wanted.get(k // 500, 0) + int(0.1 * n * 10)
    assert {r.bucket: r.prompt for r in QUERIES["join_15_all_interval_tokens"](spark, str(tmp_path)).collect()} == wanted


def documents(spark, path, texts):
    rows = [(k, t, "de", "src1", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_texts_of_any_letters_and_lengths(spark, tmp_path):
    texts = ["Über the Straße\néthe the1 (THE) the_x", "plain the", "x-\na-\nb in c-\nD É-\ne", "é" * 170, "e" * 170, "word " * 40, "y" * 600, "z" * 600, "w" * 600]
    sf = documents(spark, tmp_path, texts)
    lit = {(k << 31) + n: re.sub(r"(?i)\b(the)\b", r"**\1**", p) for k, t in enumerate(texts) for n, p in enumerate(map(str.strip, t.split("\n")), 1) if p}
    assert {r.para_seq: r.text for r in QUERIES["txt_12_all_highlighted"](spark, sf).collect()} == lit
    joined = {k: re.sub(r"(?<=[A-Za-z])-\n(?=[a-z])", "", t.replace("in ", "in-\n")) for k, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in QUERIES["src_05_dehyphenate"](spark, sf).collect()} == joined
    # What the query plants by doc_id; with the 101 characters around them, the shortest texts have 200 at most.
    planted = ["placeholder lost", "heading lost", "section emptied", "closing changed", "text changed", "too short", "", "no statement"]
    assert {r.doc_id: r.reason for r in QUERIES["pred_06_all_rejections"](spark, sf).collect()} == {k: "too short" if len(t) < 90 else planted[k % 8] for k, t in enumerate(texts)}


def test_whole_quotes_and_excerpts(spark, tmp_path):
    same = "A beginning of more than forty characters in common, and then "
    texts = ["", same + "one end", same + "another end", "Donaudampfschifffahrtsgesellschaftskapitän mit drei Worten", "Before. A  BEGINNING of it all. After", "a beginning of it all."]
    sf = documents(spark, tmp_path, texts)
    words = {1: True, 2: True, 3: False, 4: True, 5: True}  # the page of document 3 is there twice
    assert {r.seq >> 31: r.found for r in QUERIES["join_01_whole_quotes"](spark, sf).collect()} == words
    assert {r.para_seq >> 31 for r in QUERIES["flt_05_whole_excerpts"](spark, sf).collect()} == {1, 5}
