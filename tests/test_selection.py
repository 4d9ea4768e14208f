"""Samples, catalogs and shortened JSON against plain Python."""

import json

from pyspark.sql import functions as F

from quillspark.operators import guarding, selection
from quillspark.plans import selections
from quillspark.sources import tables


def sampled(rows, budget, most):
    """rows: (key, dated, seq, line) of a case; the seqs of its sample in order."""
    rows = sorted(rows, key=lambda r: (r[0], r[2]))
    n, dated = len(rows), [r for r in rows if r[1]]
    wanted = [rows[0], rows[-1], *dated[:1], *dated[-1:], *(rows[i * n // min(n, most)] for i in range(min(n, most)))]
    got, used = [], 0
    for r in wanted:
        if r not in got and len(got) < most and used + len(r[3]) + 1 <= budget:
            got.append(r)
            used += len(r[3]) + 1
    got.sort(key=lambda r: (r[0], r[2]))
    return got, dated


def test_sampled_timelines(spark, sf):
    from quillspark.functions import dates

    f = tables.facts(spark, sf).withColumn("case_id", F.col("type"))
    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in f.schema)
    f = f.unionByName(spark.createDataFrame([(-1, None, "1999-01-01", "x", "no case", "s", "d", 1), (-2, "alone", None, None, "", None, "d", 1), (-3, "long", "1999", "x", "y" * 900, "s", "d", 1)], schema))
    cases = {}
    for r in f.select("case_id", "seq", "date", "type", "description", "source", dates.sort_key(F.col("date")).alias("key")).collect():
        t = [x or "" for x in (r.date, r.type, r.description, r.source)]
        cases.setdefault(r.case_id, []).append((r.key, r.key != dates.UNDATED, r.seq, f"[{t[0]}] [fact-{r.seq}] ({t[1]}) {t[2]} — {t[3]}"))
    for budget, most in ((15_000, 400), (700, 400), (10**6, 7), (10**6, 100_000), (100, 0)):
        got = {r.case_id: r for r in selection.sampled_timeline(f, budget, most).collect()}
        assert set(got) == set(cases) - {None}
        for case, r in got.items():
            want, dated = sampled(cases[case], budget, most) if most else ([], [x for x in cases[case] if x[1]])
            assert r.selected == [x[2] for x in want] and r.text == "\n".join(x[3] for x in want)
            assert (r.total, r.omitted, r.complete) == (len(cases[case]), len(cases[case]) - len(want), len(want) == len(cases[case]))
            dated.sort(key=lambda x: (x[0], x[2]))
            assert (r.earliest_dated, r.latest_dated) == (bool(dated) and dated[0] in want, bool(dated) and dated[-1] in want)


def test_catalog(spark, sf):
    rows = selections.rnk_08_catalog(spark, sf).collect()
    facts = {r.seq: r for r in tables.facts(spark, sf).collect()}
    by_case = {}
    for r in rows:
        e, f = json.loads(r.entry), facts[r.place]
        assert (e["description"], e["quote"], e["date"], e["source"]) == (f.description, f'said "{f.description}"', f.date, f.source)
        assert r.entry == json.dumps(e, ensure_ascii=False) and r.place % 7 not in (0, 3)
        by_case.setdefault(r.case_id, []).append(r)
    for case, taken in by_case.items():
        ok = sorted(k for k, f in facts.items() if f.type == case and k % 7 not in (0, 3))
        assert sorted(r.place for r in taken) == ok[:150] and len({r.fact_id for r in taken}) == len(taken)
    cols = "case_id string, place long, date string, type string, description string, quote string, source string, verified boolean"
    few = spark.createDataFrame([("c", 1, "d", "t", "x" * 300, "q", "s", True), ("c", 2, "d", "t", "x", "q", "s", True), ("c", 3, "d", "t", "x", "q", "s", True), ("c", 4, "d", "t", " ", "q", "s", True), ("c", 5, "d", "t", "y", None, "s", None)], cols)
    assert [r.place for r in selection.catalog(few, budget=300).collect()] == [2]


def test_shortened_json(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", guarding.for_prompt(F.to_json(F.struct("doc_id", F.split("text", "\n").alias("lines")))).alias("g"))
    whole = {r.doc_id: json.loads(r.g) for r in d.collect()}
    cut = 0
    for r in selections.rnk_10_fitted_json(spark, sf).collect():
        got, all_ = json.loads(r.data), whole[r.doc_id]
        if len(json.dumps(all_, indent=1)) <= 25_000:
            assert got == all_
            continue
        cut += 1
        assert len(r.data) <= 25_000 and got["_note"] == selection.NOTE
        cap = next(c for c in selection.STRING_CAPS if len(json.dumps({"doc_id": all_["doc_id"], "lines": [x if len(x) <= c else x[:c] + selection.CUT for x in all_["lines"][:1]], "_note": selection.NOTE}, indent=1)) <= 25_000)
        n = len(got["lines"])
        assert got["lines"] == [x if len(x) <= cap else x[:cap] + selection.CUT for x in all_["lines"][:n]]
        if n < len(all_["lines"]):
            more = all_["lines"][n] if len(all_["lines"][n]) <= cap else all_["lines"][n][:cap] + selection.CUT
            assert len(json.dumps(got | {"lines": [*got["lines"], more]}, indent=1)) > 25_000
    assert cut
    df = spark.createDataFrame([("[1]",), ("{broken",), (None,), ('{"a": "<<<"}',)], "t string")
    assert [r.o for r in df.select(selection.fitted_json(F.col("t")).alias("o")).collect()] == [None, None, None, '{\n "a": "\\u00ab\\u00ab\\u00ab"\n}']
