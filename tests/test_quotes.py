"""Borders of quotes and moved citations, case by case; cutters by the rules that they state."""

import random
import time

from pyspark.sql import functions as F

from quillspark.operators import quotes, shaping
from quillspark.plans import reviews

WHOLE = {2, 4, 6, 13, 14, 18}


def test_quotes_count_where_they_stand_whole(spark):
    cases = reviews._cases(spark)
    found = {-r.seq: r.found for r in quotes.quotes_present(cases.select("seq", "document", "page", "quote"), cases.select("document", "page", "text")).collect()}
    assert {k for k, f in found.items() if f} == WHOLE and len(found) == len(reviews._CASES)


def test_odd_quotes(spark):
    q = spark.createDataFrame([(1, "d", 1, None), (2, "d", 1, ""), (3, "x", 1, "no page of this"), (4, "e", 1, "two pages of it"), (5, "d", 1, "[a] (b|c) \\E. $d ^e* x? + \U0001f642")], "seq long, document string, page int, quote string")
    pages = spark.createDataFrame([("d", 1, "Say [A] (b|c)  \\E. $d ^e* x? + \U0001f642!"), ("e", 1, "two pages of it"), ("e", 1, "two pages of it"), ("n", 1, None)], "document string, page int, text string")
    assert {r.seq: r.found for r in quotes.quotes_present(q, pages).collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert not any(r.found for r in quotes.quotes_present(q, pages.limit(0)).collect())


def test_citations_move_to_the_one_page(spark):
    pages = spark.createDataFrame([("a", 1, "the left knee was swollen"), ("a", 2, "nothing of note"), ("a", 3, "he was well; he was well again"), ("a", 4, "he was well then, he was well"), ("b", 1, "gave 1.5 mg orally daily")], "document string, page int, text string")
    members = spark.createDataFrame([("c", "a", n) for n in (1, 2, 3, 4)] + [("c", "b", 1)], "chunk string, document string, page int")
    facts = spark.createDataFrame(
        [(1, "c", "a", 2, "The left knee was swollen"), (2, "c", "a", 1, "left knee was swollen"), (3, "c", "a", 2, "he was well then"), (4, "c", "b", 1, "5 mg orally daily"), (5, "c", "a", 2, "he was well again"), (6, "x", "a", 2, "the left knee was swollen"), (7, "c", "a", 4, "knee")],
        "seq long, chunk string, document string, page int, quote string",
    )
    got = {r.seq: (r.document, r.page, r.moved) for r in quotes.relocated(facts, members, pages).collect()}
    assert got == {1: ("a", 1, True), 2: ("a", 1, False), 3: ("a", 4, True), 4: ("b", 1, False), 5: ("a", 3, True), 6: ("a", 2, False), 7: ("a", 4, False)}


def texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        yield "".join(rng.choice(["word", "x", " ", " ", "\n\n", "\n", ". ", "\t", "lengthy"]) for _ in range(rng.randrange(0, 120)))


def test_blocks_are_cut_where_the_rule_says():
    limit = 40
    for text in texts(1):
        ends = shaping.Cuts(text).blocks(limit)
        if ends is None:
            assert max(map(len, text.split())) > limit // 2
            continue
        assert (ends[0], ends[-1]) == (0, len(text)) and all(0 < b - a <= limit for a, b in zip(ends, ends[1:]))
        for start, end in zip(ends, ends[1:-1]):
            full = start + limit
            blank = [p + 2 for p in range(start + limit // 2, full - 1) if text[p : p + 2] == "\n\n"]
            if blank:
                assert end == blank[-1]
            elif text[full].isspace():
                assert end == full
            else:
                assert text[end - 1].isspace() and not any(c.isspace() for c in text[end:full])
    assert shaping.Cuts("y" * 41).blocks(40) is None and shaping.Cuts("").blocks(40) == [0]


def test_chunks_are_cut_where_the_rule_says():
    size, overlap = 50, 12
    for text in texts(2):
        found = shaping.Cuts(text).windows(size, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        for (a, b), (c, _) in zip(found, found[1:]):
            assert c == max(b - overlap, a + 1)
            window = text[a : a + size]
            last = [k for k in (window.rfind("\n\n"), window.rfind(". ")) if k >= size // 2]
            assert b == min(a + (last[0] if last else size) + 1, len(text))


def test_the_first_place_of_a_quote_decides_unless_it_is_barred(spark):
    """Quotes behind a long text are found without a search by a pattern of each (28.9 s with one, 11.0 s without)."""
    page = "the left knee was examined, and " * 10_000
    page += " ".join(f"note {k:04d} of the ward says it hurt." for k in range(1_500)) + " xit was in may then, yet it was in may then"
    quotes_ = spark.range(1_500).select(F.col("id").alias("seq"), F.lit("d").alias("document"), F.lit(1).alias("page"), F.format_string("note %04d of the ward says it hurt.", "id").alias("quote"))
    more = spark.createDataFrame([(1_500, "d", 1, "it was in may then"), (1_501, "d", 1, "xit was in may"), (1_502, "d", 1, "he left knee was examined")], quotes_.schema)
    pages = spark.createDataFrame([("d", 1, page)], "document string, page int, text string")
    began = time.monotonic()
    found = {r.seq: r.found for r in quotes.quotes_present(quotes_.unionByName(more), pages).collect()}
    assert time.monotonic() - began < 20
    assert [k for k, v in found.items() if not v] == [1_502] and len(found) == 1_503
