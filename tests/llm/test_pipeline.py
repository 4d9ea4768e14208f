"""The pipeline's stages, each against what its operator decides."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillspark.llm import secret_ledger  # noqa: E402
from tests.llm.test_operators import WORD, brute_groups  # noqa: E402


def test_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, docs, sf).cache()
    assert good.columns == names and 0.7 * docs.count() < good.count() < docs.count()
    alone = steps["near_duplicates"](spark, good, sf).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    clean = steps["secrets"](spark, alone, sf).cache()
    assert clean.count() == alone.count() and clean.columns == names
    before = {r.doc_id: r.text for r in alone.collect()}
    for r in clean.collect():
        assert not re.search("[0-9a-f]{24}", r.text) and r.n_chars == len(r.text)
        if not re.search("(?i)token|secret|passw|api_?key|AKIA|[0-9a-f]{24}", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    mixed = steps["mix"](spark, clean, sf).cache()
    words = sum(len(WORD.findall(r.text)) for r in clean.collect())
    assert mixed.columns == names and abs(sum(len(WORD.findall(r.text)) for r in mixed.collect()) - 1.5 * words) <= 20
    out = steps["tokens"](spark, mixed, sf)
    assert out.count() == mixed.count() and {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert secret_ledger.RULES


def test_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, docs, "/root/testdata/sf0.001")
            assert kept.columns == docs.columns or name == "tokens"
            kept.collect()


def test_no_doc_id_loses_a_text(spark):
    """A further text of a doc_id that is near nothing stays, whatever becomes of the doc_id's other texts."""
    base, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, base, "x"), (5, base, "y"), (5, other, "z"), (5, other, "z"), (6, other + " end", "u"), (7, third, "v"), (7, third, "w"), (None, base, "n"), (None, None, "n"), (8, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # Which of doc_id 5's texts goes by its id is a matter of hashes: the group of `other` is 5 and 6 or 6 alone.
    groups = [(None, None), (None, base), (1, base), (7, third), (8, None)]
    assert [g for g in got if g in groups] == sorted(groups, key=repr) and len(got) == 6
    assert set(got) - set(groups) in ({(5, other)}, {(6, other + " end")})
