"""Many phrases in many texts against the plain test of all pairs."""

import random

import numpy as np
import pytest

from quillspark.operators import substrings


@pytest.mark.parametrize("rarity", [1, 3])
def test_holding_against_all_pairs(spark, monkeypatch, rarity):
    monkeypatch.setattr(substrings, "RARITY", rarity)
    monkeypatch.setattr(substrings, "SLOTS", 64)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abAB é🙂") for _ in range(n))
    texts = [(k, word(rng.randrange(0, 60))) for k in range(150)] + [(900, None), (901, "")]
    phrases = [(k, rng.choice([word(rng.randrange(1, 7)), (t := rng.choice(texts)[1] or "x")[3:11], t[:2]])) for k in range(120)] + [(800, None), (801, ""), (802, "ABAB"), (803, "abab"), (804, "z" * 90)]
    got = sorted((r.id, r.phrase_id) for r in substrings.holding(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(phrases, "phrase_id int, phrase string")).collect())
    assert got == sorted((i, j) for i, t in texts for j, p in phrases if t and p and p.lower() in t.lower()) and len(got) > 200


def test_no_phrases_or_texts(spark):
    t, p = spark.createDataFrame([(1, "abc")], "id int, text string"), spark.createDataFrame([(1, "b")], "phrase_id int, phrase string")
    assert substrings.holding(t, p.limit(0)).count() == 0 and substrings.holding(t.limit(0), p).count() == 0 and substrings.holding(t, p).count() == 1


def test_cited_sources(spark):
    facts = [("Records.pdf p.7", "records.pdf", 7), ("other.pdf p.2", None, None), ("other.pdf p.3", "", 0), ("loose one", None, None), (" ", "x", 1), ("b.pdf p.1", "b.pdf", 1), ("never", "n", 9)]
    said = [("RECORDS.PDF p.7", "NOT FOUND"), ("see Other.pdf p.2, 2020-01-01", "SUPPORTED"), ("other.pdf p.3-4", "CONTRADICTED"), ("has LOOSE ONE in it", None), ("", "SUPPORTED"), (None, "SUPPORTED"), ("b.pdf p.1", "SUPPORTED"), ("b.pdf p.1", "NOT FOUND")]
    got = {r.source: r.positive for r in substrings.cited_sources(spark.createDataFrame(facts, "source string, document string, page int"), spark.createDataFrame(said, "record_reference string, verdict string"), ("SUPPORTED",)).collect()}
    assert got == {"Records.pdf p.7": False, "other.pdf p.2": True, "other.pdf p.3": False, "loose one": False, "b.pdf p.1": True}


def test_numbered_phrases_meet_their_own_texts_only(spark):
    n = 3000
    texts = spark.range(n).selectExpr("id", "concat('see Cust_', id, ' p.', id % 50 + 1, ', 2020-01-01') AS text")
    phrases = spark.range(n).selectExpr("id AS phrase_id", "concat('cust_', id, ' p.', id % 50 + 1) AS phrase")
    hashed = substrings._hashed(phrases.select("phrase"))
    rungs, wanted = np.full(substrings.SLOTS, -1), np.full(substrings.BITS // 8, 255, np.uint8)
    met = substrings._met(texts.selectExpr("id", "lower(text) AS text"), rungs, 0, wanted, substrings.BITS).join(hashed, "hash")
    assert met.count() < 2 * n and sorted((r.id, r.phrase_id) for r in substrings.holding(texts, phrases).collect()) == [(i, i) for i in range(n)]


def test_long_phrases_and_all_rungs(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ab ") for _ in range(70_000))
    sizes = sorted({*range(1, 70), *(s + d for s in substrings.RUNGS for d in (-1, 0, 1)), 60_000} - {0})
    phrases = [(2 * k + own, text[7 : 7 + s] + ("" if own else "#")) for k, s in enumerate(sizes) for own in (0, 1)]
    got = {r.phrase_id for r in substrings.holding(spark.createDataFrame([(1, text), (2, "#")], "id int, text string"), spark.createDataFrame(phrases, "phrase_id int, phrase string")).collect()}
    assert got == {k for k, _ in phrases if k % 2}
