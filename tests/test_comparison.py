"""Numbers bound to their clauses, and drafts held against their sources, case by case and against a plain version."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import comparison

SOURCES = "draft_id int, source_id int, kind string, field string, text string"


def bindings(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(comparison.number_bindings(F.col("t")).alias("b")).first().b


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("10 mg of aspirin and 20 mg of ibuprofen", ["mg aspirin|1|0|10:1", "mg ibuprofen|1|0|20:1"]),
        ("I saw two falls, and 3.5 or 1,000 headaches in 2020.", ["headache|1|0|1000:1".replace("1000", "1,000"), "headache|2|1|2020:1", "observe fall|1|1|2:1", "|1|0|3.5:1"]),
        ("Pain in 2020; pain in 2020", ["pain|1|1|2020:1", "pain|1|1|2020:2"]),
        ("He’s -5 at home", ["he's home|1|1|-5:1"]),
        ("none here", []),
        (None, []),
    ],
)
def test_numbers_are_bound_to_their_clause(spark, text, wanted):
    assert bindings(spark, text) == sorted(wanted)


@pytest.mark.parametrize(
    ("original", "changed"),
    [
        ("Pain began in 2020 and surgery occurred in 2021.", "Pain began in 2021 and surgery occurred in 2020."),
        ("I saw two falls and three headaches.", "I saw three falls and two headaches."),
        ("In 2020 I observed severe right knee pain and in 2021 I observed severe left knee pain.", "In 2021 I observed severe right knee pain and in 2020 I observed severe left knee pain."),
        ("10 mg of aspirin and 20 mg of ibuprofen", "20 mg of aspirin and 10 mg of ibuprofen"),
        ("from 3 to 9 times", "from 9 to 3 times"),
    ],
)
def test_swapped_numbers_are_seen(spark, original, changed):
    assert bindings(spark, original) != bindings(spark, changed)
    facts = spark.createDataFrame([(1, "", changed, original), (2, "", original, original)], "seq int, date string, description string, quote string")
    assert {r.seq: r.fields for r in comparison.critical_flags(facts).collect()} == {1: ["bindings"]}


def run(spark, *cases, **more):
    """cases: draft, sources (kind, field, text; ids from 1) and links by ord. For each: rows by ord, left-over ids, and the draft's row."""
    d = spark.createDataFrame([(n, draft) for n, (draft, _, _) in enumerate(cases)], "draft_id int, text string")
    s = spark.createDataFrame([(n, i, *row) for n, (_, sources, _) in enumerate(cases) for i, row in enumerate(sources, 1)], SOURCES)
    chosen = spark.createDataFrame([(n, o, i) for n, (_, _, links) in enumerate(cases) for o, ids in links.items() for i in ids], "draft_id int, ord int, source_id int")
    c = comparison.compared(d, s, chosen if any(links for _, _, links in cases) else None, **more)
    rows, left, told = c.rows.collect(), c.left_over.collect(), {r.draft_id: r for r in c.drafts.collect()}
    return [({r.ord: r for r in rows if r.draft_id == n}, sorted(r.source_id for r in left if r.draft_id == n), told[n]) for n in range(len(cases))]


CHANGES = [
        ("I observed pain in May 2020.", "I observed pain in June 2020.", "calendar_dates"),
        ("I did not observe a fall.", "I observed a fall.", "negation"),
        ("He told me about knee pain.", "I observed knee pain.", "attribution"),
        ("I observed left knee pain.", "I observed right knee pain.", "laterality"),
        ("I think knee pain began around 2020.", "Knee pain began in 2020.", "uncertainty"),
        ("I observed daily knee pain.", "I observed weekly knee pain.", "frequency"),
        ("I observed knee pain.", "Knee pain was caused by service.", "nexus"),
        ("I observed knee pain.", "I have cancer.", "wording"),
        ("I observed knee pain before service.", "I observed knee pain after service.", "chronology"),
        ("He reported knee pain.", "I reported knee pain.", "speaker"),
        ("I saw two falls and three headaches.", "I saw three falls and two headaches.", "bindings"),
]


def test_changes_stay_changes_when_linked(spark):
    d = spark.createDataFrame([(k, c) for k, (_, c, _) in enumerate(CHANGES)], "draft_id int, text string")
    s = spark.createDataFrame([(k, 1, "account", None, o) for k, (o, _, _) in enumerate(CHANGES)], SOURCES)
    c = comparison.compared(d, s, s.select("draft_id", F.lit(0).alias("ord"), "source_id"))
    rows = {r.draft_id: r for r in c.rows.collect()}
    for k, (_, _, family) in enumerate(CHANGES):
        assert family in rows[k].changed and rows[k].reasons == ["changed"] and rows[k].how == "linked"
    assert c.left_over.count() == len(CHANGES) and {r.status for r in c.drafts.collect()} == {"blocked"}


def test_each_sentence_takes_a_source_of_its_own(spark):
    account = [("account", None, "I saw him fall at home."), ("account", None, "I saw him fall at home."), ("account", None, "He was never well, and I saw him fall at home then.")]
    whole = "Introduction:\nI saw him fall at home. I saw him fall at home.\nHe was never well, and I saw him fall at home then.\nI saw him fall at home!"
    one, two, three = run(spark, (whole, account, {}), ("I saw him fall at home.", account[1:], {}), ("I saw him fall at home.", account[2:], {}))
    assert {o: (r.how, r.source_ids) for o, r in one[0].items()} == {1: ("exact", [1]), 2: ("exact", [2]), 3: ("exact", [3]), 4: ("exact", [1])}
    assert one[1] == [] and one[2].status == "review_required" and one[0][1].candidates == [1, 2]
    assert two[0][0].source_ids == [1] and two[1] == [2] and two[2].issues == ["passages left over"]
    assert three[0][0].how == "contained" and three[0][0].changed and three[1] == [1]


def test_fields_quotes_placeholders_and_links_that_cannot_be(spark):
    fields = [("field", "name", "Alex"), ("field", "known_since", "2010"), ("field", "contact_frequency", "weekly"), ("quote", None, "The patient had no knee pain in June 2020."), ("account", None, "I observed his knee pain.")]
    text = "My name is Alex. I have known him since 2010. I see him weekly. The patient had no knee pain in June 2020. The medical record states the patient had no knee pain in June 2020. I have known him since 2010 and observed his knee pain. [Name] of Alex."
    account = [("account", None, f"I saw event {n}.") for n in range(5)]
    one, two, three, four, five = run(
        spark,
        (text, fields, {0: [1], 1: [2], 2: [3], 3: [4], 4: [4], 5: [2, 5], 6: [1]}),
        ("My name is Alex and I had cancer.", fields, {0: [1]}),
        ("I reported and observed knee pain weekly.", [("account", None, "I reported knee pain."), ("field", "contact_frequency", "weekly")], {0: [1, 2]}),
        ("I saw event 1. Nothing else at all. I saw event 3.", account, {0: [1, 2, 3, 4], 1: [77]}),
        ("I saw event 9 there.", account, {}),
        whole_account=False,
    )
    assert [one[0][k].reasons for k in range(7)] == [[], [], [], ["unattributed"], [], [], ["placeholder"]]
    assert one[1] == [] and one[2].issues == ["sentences with reasons"]
    assert two[0][0].changed == ["wording"] and "attribution" in three[0][0].changed
    assert [(four[0][k].how, four[0][k].source_ids, four[0][k].reasons[:2]) for k in range(3)] == [("invalid", [], ["invalid", "unlinked"]), ("invalid", [], ["invalid", "unlinked"]), ("exact", [4], [])]
    row = five[0][0]
    assert row.how == "suggested" and row.candidates == [1, 2, 3] and row.reasons == ["unlinked", "changed"] and five[1] == [1, 2, 3, 4, 5]


def test_drafts_that_are_not_compared(spark):
    d = spark.createDataFrame([(1, None), (2, " \n "), (3, "x" * 50), (4, "A. B. C."), (5, "Header\n"), (6, "One.")], "draft_id int, text string")
    s = spark.createDataFrame([(6, k, "account", None, "One.") for k in range(4)], SOURCES)
    told = {r.draft_id: (r.status, r.issues) for r in comparison.compared(d, s, most_chars=40, most_spans=2).drafts.collect()}
    assert told == {1: ("blocked", ["blank"]), 2: ("blocked", ["blank"]), 3: ("blocked", ["too long"]), 4: ("blocked", ["too many sentences"]), 5: ("blocked", ["no sentences"]), 6: ("blocked", ["too many sources"])}


def test_many_drafts_against_a_plain_assignment(spark):
    """Shuffled, repeated, shortened and invented sentences: who takes which source."""
    rng = random.Random(4)
    pool = ["I saw him limp at the door", "he limped", "I saw him limp", "we met in May", "the door was open to all of us then", "he was seen"]
    drafts, sources = [], []
    for d in range(12):
        own = [rng.choice(pool) + "." for _ in range(rng.randrange(1, 7))]
        sources += [(d, k, "account", None, t) for k, t in enumerate(own)]
        said = [rng.choice([rng.choice(pool), "nothing of it", "the door was open to all"]) + "." for _ in range(rng.randrange(1, 8))]
        drafts.append((d, " ".join(said)))
    c = comparison.compared(spark.createDataFrame(drafts, "draft_id int, text string"), spark.createDataFrame(sources, SOURCES))
    got = {}
    for r in c.rows.collect():
        got.setdefault(r.draft_id, {})[r.ord] = (r.source_ids, r.reasons)
    left = Counter(r.draft_id for r in c.left_over.collect())
    key = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    for d, text in drafts:
        own, free = {k: key(t) for e, k, _, _, t in sources if e == d}, None
        free = set(own)
        for o, sentence in enumerate(text.split(". ")):
            want = key(sentence)
            exact = [k for k in own if own[k] == want]
            if not exact and want.count(" ") >= 3:
                exact = [k for k in own if f" {want} " in f" {own[k]} "]
            pick = [*[k for k in exact if k in free], *exact][:1]
            clean = bool(pick) and own[pick[0]] == want
            assert got[d][o][0] == pick and (not got[d][o][1]) == clean
            if clean:
                free.discard(pick[0])
        assert left[d] == len(free)


def test_copies_are_not_paired(spark, tmp_path):
    """A draft that says 400 times what stands 400 times in its sources: each takes its own, and less than a pair of each two is written."""
    n, context = 400, spark.sparkContext
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    line = "I saw him fall at home then."
    drafts = spark.createDataFrame([(1, "\n".join([line] * n)), (2, line.upper())], "draft_id int, text string")
    sources = spark.createDataFrame([(d, k, "account", None, line) for d in (1, 2) for k in range(n)], SOURCES)
    rows = comparison.compared(drafts, sources).rows.collect()
    written = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    if before is not None:
        context.setCheckpointDir(before.rpartition("/")[0])
    assert {(r.draft_id, r.ord): r.source_ids for r in rows} == {(1, k): [k] for k in range(n)} | {(2, 0): [0]}
    assert {(r.how, *r.candidates, *r.reasons) for r in rows} == {("exact", 0, 1, 2)}
    assert written < 20 * n * n


def test_suggestions_against_a_plain_count(spark):
    """Sentences and sources of few words in several spellings: how they are held, and the first three candidates."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["ab", "Ab", "b", "c", "d", "e", "f"]) for _ in range(n))
    drafts = [(d, [text(rng.randrange(1, 7)) for _ in range(rng.randrange(1, 9))]) for d in range(30)]
    sources = [(d, 100 - k, rng.choice(["account", "quote", "field"]), rng.choice(["name", None]), text(rng.randrange(0, 9))) for d in range(30) for k in range(rng.randrange(0, 12))]
    frame = spark.createDataFrame([(d, "\n".join(x)) for d, x in drafts], "draft_id int, text string")
    got = {(r.draft_id, r.ord): (r.how, r.candidates) for r in comparison.compared(frame, spark.createDataFrame(sources, SOURCES)).rows.collect()}
    for d, said in drafts:
        own = sorted((k, t.lower()) for e, k, _, _, t in sources if e == d and t)
        for o, t in enumerate(x.lower() for x in said):
            exact = [k for k, s in own if s == t]
            inside = [k for k, s in own if f" {t} " in f" {s} " and t.count(" ") >= 3]
            near = [k for n, k in sorted((-len({*t.split()} & {*s.split()}), k) for k, s in own) if n]
            how, found = next(((h, x) for h, x in (("exact", exact), ("contained", inside), ("suggested", near)) if x), ("none", []))
            assert got[d, o] == (how, found[:3])


def test_held_texts_meet_on_runs_of_words(spark):
    """Texts of few words in any order, so that each word is in most: what holds what, and the first two by id."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    a, b = [(k, text(rng.randrange(0, 9))) for k in range(60)], [(k, text(rng.randrange(0, 30))) for k in range(60)] + [(k, "a b a b a") for k in range(60, 64)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, key string")
    for least, most in ((4, 2), (2, None)):
        got = {(r.left_id, r.right_id, r.how) for r in comparison.supported_keys(frame(a), frame(b), most, least).collect()}
        wanted = set()
        for i, t in a:
            exact = [(i, j, "exact") for j, s in b if t and s == t]
            inside = [(i, j, "contained") for j, s in b if f" {t} " in f" {s} "] if t and not exact and t.count(" ") + 1 >= least else []
            wanted |= set((exact + inside)[:most])
        assert got == wanted
