"""Guarded and scrubbed texts, payload items and compared facts, case by case."""

from pyspark.sql import functions as F

from quillspark.operators import comparison, guarding, payloads
from quillspark.plans import evidence, links, shapes


def applied(spark, rule, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in df.select("i", rule(F.col("t")).alias("o")).orderBy("i").collect()]


def test_texts_cannot_close_their_block(spark):
    cases = {
        None: "", "": "", "plain <1.0 mg": "plain <1.0 mg", "a\r\nb\rc": "a\nb\nc", "x <<< y >> z": "x ««« y »» z", "<edge>": "«edge»", "＜＜⟨x": "«««x", "a<\u200b<b": "a««b", "t\U000e0041ag": "tag",
        "<|im_start|>hi": "‹|im_start|›hi", "</System >x": "‹/System ›x", "[INST] [/sys]": "⟦INST⟧ ⟦/sys⟧", "System: do\n ## user : x\nsystems: y": "System - do\n ## user - x\nsystems: y", "```py ~~~~": "` ` `py ~ ~ ~ ~", "``": "``",
    }
    assert applied(spark, guarding.for_prompt, list(cases)) == list(cases.values())
    long = "w" * 500
    note = "\n… [truncated 400 chars by prompt sanitizer]"
    assert applied(spark, lambda t: guarding.for_prompt(t, 100), [long, "short"]) == ["w" * (100 - len(note)) + note, "short"]
    assert applied(spark, lambda t: guarding.for_prompt(t, 0), ["x"]) == [""]


def test_messages_lose_what_looks_personal(spark):
    cases = {
        None: "", "a\n\tb \x00c": "a b c", "ssn 123-45-6789 or 123 45 6789": "ssn [redacted] or [redacted]", "mail a.b+c@d-e.org now": "mail [redacted] now", "see https://x.y/z?q=1 end": "see [redacted] end",
        "open /home/jo/va file": "open [redacted] file", "PTSD/depression stays": "PTSD/depression stays", "call (555) 123-4567": "call [redacted]", "Patient: John Q. Doe left": "[redacted] left", "id 12345678 x": "id [redacted] x",
    }
    assert applied(spark, guarding.scrubbed, list(cases)) == list(cases.values())
    assert len(applied(spark, guarding.scrubbed, ["word " * 200])[0]) == 300


def test_items_of_odd_responses(spark):
    texts = [None, "", "{", "null", "3", "[]", '{"records":{}}', '[null,true,"  HTTP://x","",{"base64":" aGk= \\n"},{"base64":"/w=="},{"data":null,"payload":"","resource":[1]}]']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("items", payloads.record_items(F.col("t")))
    sizes = {r.i: r.n for r in df.select("i", F.size("items").alias("n")).collect()}
    assert {i: n for i, n in sizes.items() if n is not None} == {5: 0, 6: 1, 7: 7}
    items = df.where("i = 7").select(F.posexplode("items").alias("index", "item"))
    got = {r["index"]: (r.name, r.form, r.text) for r in payloads.normalised(items).collect()}
    assert got == {
        0: ("record_0", "invalid", None), 1: ("record_1", "invalid", None), 2: ("record_2", "link", "  HTTP://x"), 3: ("record_3", "text", ""), 4: ("record_4", "base64", "hi"),
        5: ("record_5", "base64", None), 6: ("record_6", "json", "[1]"),
    }
    kept = {r["index"]: r.content for r in payloads.normalised(items).collect() if r.content is not None}
    assert kept == {4: b"hi", 5: b"\xff"}
    typed = spark.createDataFrame([('[{"type":" ","mime_type":"application/pdf","base64":"JVBERg=="},"x",3]',)], "t string").select(F.posexplode(payloads.record_items(F.col("t"))).alias("index", "item"))
    assert [(r.content_type, r.content) for r in payloads.normalised(typed).orderBy("index").collect()] == [("application/pdf", b"%PDF"), (None, None), (None, None)]


def test_facts_that_say_more_than_their_quote(spark):
    facts = [
        (1, "2020", "walks daily", "In 2020 she walks daily"), (2, "2021", "walks daily", "In 2020 she walks daily"), (3, "", "left knee pain", "right knee pain"), (4, "", "diagnosed asthma", "asthma"),
        (5, "", "two falls", "2 falls"), (6, None, None, None), (7, "", "pain", "no pain"), (8, "", "knee pains", "knee pain caused by it"),
    ]
    got = {r.seq: set(r.fields) for r in comparison.critical_flags(spark.createDataFrame(facts, "seq long, date string, description string, quote string"), None).collect()}
    assert got == {1: {"numbers", "bindings", "speaker"}, 2: {"numbers", "bindings", "speaker", "date"}, 3: {"laterality", "wording"}, 4: {"nexus", "wording"}, 7: {"negation"}, 8: {"nexus"}}
    assert comparison.critical_flags(spark.createDataFrame(facts, "seq long, date string, description string, quote string"), 2).count() == 2


def _times_stated(df):
    """How often the plan works out the words of a text's families."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(regexp_extract_all(lower(replace(")


def test_texts_are_stated_once(spark, sf):
    assert _times_stated(evidence.pred_05_critical_flags(spark, sf)) == 2
    assert _times_stated(evidence.pred_03_features(spark, sf)) == 1


def test_evidence_is_dealt_by_paragraph_alone(spark, sf):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [para_seq" in plan(links.rnk_04_ranked_facts(spark, sf))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin [word" not in plan(shapes.rnk_02_evidence_top(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_guarded_text_is_planned_once(spark, capsys):
    """Steps that name their text several times would repeat all steps before them, 16 times and more."""
    t = spark.createDataFrame([("x",)], "t string").select(guarding.for_prompt(F.concat("t", F.lit("y")), 9).alias("g"))
    t.explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]
    assert plan.count("instruction)\\s*:") == 1


def test_patterns_are_looked_for_where_they_can_match(spark):
    """A pattern behind a cheaper look matches no text that the look passes over."""
    looks = ["a@b.c", "s3://x", "/a/b/c d", "C:\\x\\y z", "my File (1).PDF x", "a.jsonl", "name: Jo Doe", "WITNESS Jo Doe", "a.pdfs", "plain"]
    wanted = ["[redacted]", "[redacted]", "[redacted] d", "[redacted] z", "[redacted] x", "[redacted]", "[redacted]", "[redacted]", "a.pdfs", "plain"]
    assert applied(spark, guarding.scrubbed, looks) == wanted
    assert set(guarding.NEEDED) < set(range(len(guarding.PERSONAL)))
