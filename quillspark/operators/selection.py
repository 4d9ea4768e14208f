"""What enters a list of bounded size: sampled timelines, catalogs, questions, advice, shortened JSON."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import guarding
from quillspark.operators.operations import fitting
from quillspark.operators.review import element

#: What is asked about a condition, about an element without evidence (in the order asked), and about opinions.
CONDITION_QUESTION = "What are the current VA rating criteria for %s, and is it presumptive under any exposure or service basis?"
GAP_QUESTIONS = {
    "nexus": "What evidence does VA require to establish a nexus between %s and service, and what makes a medical opinion adequate for that purpose?",
    "in_service_event": "What counts as an in-service event, injury, or aggravation for %s when the service treatment records are incomplete?",
    "current_diagnosis": "What are VA's current diagnostic criteria and rating schedule for %s?",
    "buddy_observable": "Which observations can a lay witness competently describe for %s without offering a diagnosis or an opinion on causation?",
    "functional_impact": "How does VA evaluate functional impact for %s, and what do raters count as the functional limitation?",
    "severity_frequency": "How do frequency and severity of symptoms affect the rating for %s?",
    "treatment_history": "What does VA expect to see in the treatment record for %s?",
}
OPINION_QUESTION = "How does VA weigh a private provider's opinion against a VA examination opinion for %s, and what makes either adequate?"
#: Advice without claims, about contradictions, gaps and problems, and to fill up with: title, impact, explanation.
NO_CLAIMS = (
    (
        "Add specific, verifiable factual claims", "+15 points",
        "No checkable factual assertions were found in the statement. Add concrete dates, events, symptoms, or treatments the witness personally observed.",
    ),
    (
        "Cite supporting medical record evidence", "+10 points",
        "There are no claims yet to cite evidence for — once factual claims are added, cite the record source (filename + page) for each where available.",
    ),
)
CONTRADICTED = ("Resolve contradictions with the medical records", "+10 points", "%s claim(s) conflict with the medical records — correct them or add a written explanation before submitting.")
GAP = ("Address gap: %s", "+5 points", "This checklist topic is applicable but weakly covered in the statement.")
PROBLEM = ("Improve statement detail", "+5 points", "Add more specific, record-grounded detail.")
FILLERS = (
    ("Improve overall specificity and detail", "+3 points", "Add concrete dates, frequencies, and specific incidents where possible."),
    ("Strengthen functional-impact descriptions", "+3 points", "Describe a specific daily activity the condition limits, not just the diagnosis."),
    ("Add clearer before/after timeline detail", "+3 points", "Contrast functioning before and after onset so continuity is unmistakable."),
)
#: The caps of strings tried in turn, and what marks cut strings and shortened data.
STRING_CAPS = (2000, 1000, 400, 120, 60)
CUT = "… [shortened for prompt budget]"
NOTE = "Shortened to fit the drafting prompt budget; trailing rows and long fields were dropped."


def sampled_timeline(facts: DataFrame, budget: int = 15_000, most: int = 400) -> DataFrame:
    """A sample of each case's facts (case_id, seq, date, type, description, source) of whole
    lines: its first, last and last dated fact, then facts at equal strides, while they fit the
    budget of characters and the number; a line that does not fit is skipped. Per case: text
    (lines by date, then seq), selected (their seq), total, omitted, complete, and whether the
    earliest and latest dated facts are in. Facts without a case are left out; null fields are
    empty.

    Places come from counts per date, so that only facts of one date are numbered together; at
    most `most` + 3 lines of a case stand for choice."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("["), text("date"), F.lit("] [fact-"), text("seq"), F.lit("] ("), text("type"), F.lit(") "), text("description"), F.lit(" — "), text("source"))
    f = facts.where("case_id is not null").select("case_id", "seq", dates.sort_key(F.col("date")).alias("key"), line.alias("line"))
    per_case = Window.partitionBy("case_id")
    days = f.groupBy("case_id", "key").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(per_case.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dated = F.sum(F.when(F.col("key") != dates.UNDATED, F.col("n")).otherwise(0)).over(per_case)
    days = days.select("case_id", "key", before.alias("before"), F.sum("n").over(per_case).alias("total"), dated.alias("dated"))
    placed = f.join(days, ["case_id", "key"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("case_id", "key").orderBy("seq", "line")) - 1)
    taken = F.greatest(F.least(F.col("total"), F.lit(most)), F.lit(1)).cast("long")
    stride = F.call_function("div", F.col("place") * taken + F.col("total") - 1, F.col("total"))
    at_stride = (stride < taken) & (F.call_function("div", stride * F.col("total"), taken) == F.col("place"))
    priority = F.when(F.col("place") == 0, 0).when(F.col("place") == F.col("total") - 1, 1).when(F.col("place") == F.col("dated") - 1, 3).when(at_stride, stride + 4)
    for_choice = placed.withColumn("priority", priority).where("priority is not null").withColumn("size", F.length("line") + 1)
    fits = fitting(for_choice, "case_id", "priority", "size", budget, most).select("case_id", F.explode("taken").alias("priority"))
    chosen = for_choice.join(fits, ["case_id", "priority"]).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", "line", "seq"))).alias("c"))
    totals = days.groupBy("case_id").agg(F.max("total").alias("total"), F.max("dated").alias("dated")).join(chosen, "case_id", "left")
    c = F.coalesce(F.col("c"), F.array().cast(chosen.schema["c"].dataType))
    has = lambda place: (F.col("dated") > 0) & F.exists(c, lambda x: x["place"] == place)
    omitted = F.col("total") - F.size(c)
    return totals.select(
        "case_id", F.array_join(F.transform(c, lambda x: x["line"]), "\n").alias("text"), F.transform(c, lambda x: x["seq"]).alias("selected"), "total", omitted.alias("omitted"), (omitted == 0).alias("complete"),
        has(F.lit(0)).alias("earliest_dated"), has(F.col("dated") - 1).alias("latest_dated"),
    )


def _quoted(text: Column) -> Column:
    """Text as a JSON string."""
    whole = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def catalog(facts: DataFrame, budget: int = 90_000, most: int = 150) -> DataFrame:
    """The facts of each case (case_id, place, date, type, description, quote, source, verified)
    that a prompt may quote: verified, described, unchanged by the guard of prompts, each once,
    in the order of place while they fit; one that does not is skipped. case_id, place, fact_id
    (a digest of the entry) and entry (JSON). Facts without a case are left out."""
    fields = ("source", "description", "quote", "date", "type")
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), _quoted(F.col(c))) for c in fields])
    ok = facts.where("case_id is not null and verified").where(F.length(F.trim(F.coalesce("description", F.lit("")))) > 0)
    named = ok.select("case_id", F.col("place").cast("long").alias("place"), F.concat(F.lit("fact-"), F.sha2(body, 256)).alias("fact_id"), body.alias("body"))
    entries = named.select("case_id", "place", "fact_id", F.concat(F.lit('{"fact_id": "'), "fact_id", F.lit('", '), "body", F.lit("}")).alias("entry"))
    once = entries.where(guarding.for_prompt(F.col("entry")) == F.col("entry")).groupBy("case_id", "fact_id").agg(F.min("place").alias("place"), F.first("entry").alias("entry"))
    taken = fitting(once.withColumn("size", F.length("entry") + 2), "case_id", "place", "size", budget - 2, most)
    return once.join(taken.select("case_id", F.explode("taken").alias("place")), ["case_id", "place"]).select("case_id", "place", "fact_id", "entry")


def _normal(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def questions(facts: DataFrame, conditions: DataFrame, providers: DataFrame, most: int = 12, most_conditions: int = 6, most_gaps: int = 4) -> DataFrame:
    """case_id, place (from 1), kind, text, condition and support of what to ask about each case
    with facts (case_id, type, description, quote): its conditions (case_id, seq, condition) by
    how many facts mention them, then by seq; elements without a fact; and how opinions weigh, if
    it has two providers (case_id, provider). A condition under three characters, or spelt like
    an earlier one but for spaces, is none; it is mentioned by its phrase or by all its words of
    over three letters.

    Texts are counted before they meet conditions, so that repeated facts are looked at once."""
    mine = conditions.select("case_id", "seq", F.trim("condition").alias("condition"), _normal(F.col("condition")).alias("phrase"))
    mine = mine.where((F.length("condition") >= 3) & (F.col("phrase") != "")).groupBy("case_id", F.replace("phrase", F.lit(" "), F.lit("")).alias("_k")).agg(F.min_by(F.struct("condition", "phrase"), F.struct("seq", "condition")).alias("c"), F.min("seq").alias("seq"))
    mine = mine.select("case_id", "seq", "c.condition", "c.phrase", F.filter(F.split("c.phrase", " "), lambda w: F.length(w) > 3).alias("words"))
    texts = facts.groupBy("case_id", _normal(F.concat_ws(" ", "description", "quote")).alias("t")).agg(F.count("*").alias("n"))
    own = F.split("t", " ")
    hit = F.contains(F.col("t"), F.col("phrase")) | ((F.size("words") > 0) & F.forall("words", lambda w: F.array_contains(own, w)))
    found = mine.join(texts, "case_id").where(hit).groupBy("case_id", "seq", "phrase").agg(F.sum("n").alias("support"))
    ranked = mine.join(found, ["case_id", "seq", "phrase"], "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("support"), "seq", "phrase"))
    best = ranked.withColumn("place", place).where(F.col("place") <= most_conditions).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", "condition", "support"))).alias("best"))
    covered = facts.groupBy("case_id").agg(F.collect_set(element(F.col("type"), F.col("description"))).alias("covered"))
    several = providers.groupBy("case_id").agg((F.count_distinct("provider") > 1).alias("several"))
    cases = covered.join(best, "case_id", "left").join(several, "case_id", "left")
    primary = F.coalesce(F.get(F.col("best")["condition"], F.lit(0)), F.lit(""))

    def asked(kind: str, text: Column, condition: Column, support: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), condition.alias("condition"), support.cast("long").alias("support"))

    none = F.lit(None).cast("long")
    about = F.transform(F.coalesce("best", F.array().cast(best.schema["best"].dataType)), lambda b: asked("condition", F.format_string(CONDITION_QUESTION, b["condition"]), b["condition"], b["support"]))
    of = F.when(primary == "", "the condition in this claim").otherwise(primary)
    gaps = F.array(*[F.when(~F.array_contains("covered", e), asked("evidence", F.format_string(q, of), primary, none)) for e, q in GAP_QUESTIONS.items()])
    opinion = F.array(F.when(F.col("several"), asked("opinion", F.format_string(OPINION_QUESTION, F.when(primary == "", "the claimed condition").otherwise(primary)), F.lit(""), none)))
    all_ = F.slice(F.concat(about, F.slice(F.array_compact(gaps), 1, most_gaps), F.array_compact(opinion)), 1, most)
    return cases.select("case_id", F.posexplode(all_).alias("at", "q")).select("case_id", (F.col("at") + 1).alias("place"), "q.kind", "q.text", "q.condition", "q.support")


def advice(claims: Column, contradictions: Column, gaps: Column, problems: Column, least: int = 3, most: int = 5) -> Column:
    """Array of title, impact and explanation: what to do without claims, about contradictions
    (both numbers), gaps (array of topics; null where topics aren't complete) and problems (array
    of problem and suggestion), filled up to least, at most most. Null numbers are none."""

    def row(title: Column, impact: str, explanation: Column) -> Column:
        return F.struct(title.alias("title"), F.lit(impact).alias("impact"), explanation.alias("explanation"))

    def fixed(rows: tuple[tuple[str, str, str], ...]) -> Column:
        return F.array(*[row(F.lit(t), i, F.lit(e)) for t, i, e in rows])

    def told(text: Column, otherwise: str) -> Column:
        return F.when(F.coalesce(text, F.lit("")) == "", otherwise).otherwise(text)

    empty = F.slice(fixed(FILLERS), 1, 0)
    first = F.when(F.coalesce(claims, F.lit(0)) == 0, fixed(NO_CLAIMS)).otherwise(empty)
    against = F.when(contradictions > 0, F.array(row(F.lit(CONTRADICTED[0]), CONTRADICTED[1], F.format_string(CONTRADICTED[2], contradictions.cast("string"))))).otherwise(empty)
    open_ = F.transform(gaps, lambda g: row(F.substring(F.format_string(GAP[0], g), 1, 160), GAP[1], F.lit(GAP[2])))
    wrong = F.transform(problems, lambda p: row(F.substring(told(p["problem"], PROBLEM[0]), 1, 160), PROBLEM[1], told(p["suggestion"], PROBLEM[2])))
    own = F.concat(first, against, F.coalesce(open_, empty), F.coalesce(wrong, empty))
    lack = F.greatest(F.lit(0), F.least(F.lit(len(FILLERS)), F.lit(least) - F.size(own)))
    return F.slice(F.concat(own, F.slice(fixed(FILLERS), F.lit(1), lack)), 1, most)


def _pieces(value: Any, rank: int = -1, line: str = "\n") -> Iterator[tuple[int, str, bool]]:
    """What prints a JSON value with an indent of one, piece by piece: the last place that any
    list around it has to keep (-1: none), the piece, and whether it is a string's own text."""
    if isinstance(value, str):
        yield rank, value, True
    elif value and isinstance(value, dict | list):
        named = value.items() if isinstance(value, dict) else ((None, v) for v in value)
        yield rank, "{" if isinstance(value, dict) else "[", False
        for at, (key, inner) in enumerate(named):
            own = rank if isinstance(value, dict) else max(rank, at)
            yield own, ("," if at else "") + line + " " + ("" if key is None else json.dumps(key) + ": "), False
            yield from _pieces(inner, own, line + " ")
        yield rank, line + ("}" if isinstance(value, dict) else "]"), False
    else:
        yield rank, json.dumps(value), False


def shortened_json(value: dict[str, Any], budget: int) -> str:
    """A JSON object printed within the budget: strings cut to the first of STRING_CAPS with
    which lists of one row fit, lists to as many rows as then fit, and a note that says so.

    Of lists cut to n rows, just the pieces of a rank below n are left, so sizes summed by rank
    tell for a cap how many rows fit."""
    whole = json.dumps(value, indent=1)
    if len(whole) <= budget:
        return whole
    pieces = list(_pieces(value | {"_note": None}))
    note = next(i for i, (_, piece, own) in enumerate(pieces) if not own and piece.endswith('\n "_note": ')) + 1
    pieces[note] = (-1, json.dumps(NOTE), False)
    for chars in STRING_CAPS:
        shown = [json.dumps(piece if len(piece) <= chars else piece[:chars] + CUT) if own else piece for _, piece, own in pieces]
        sizes: Counter[int] = Counter()
        for (rank, _, _), text in zip(pieces, shown, strict=True):
            sizes[max(rank, 0)] += len(text)
        fitting = [rank for rank, size in zip(sorted(sizes), accumulate(sizes[r] for r in sorted(sizes)), strict=True) if size <= budget]
        if fitting or chars == STRING_CAPS[-1]:
            last = max(fitting, default=0)
            return "".join(text for (rank, _, _), text in zip(pieces, shown, strict=True) if rank <= last)
    raise AssertionError("the last cap always returns")


def fitted_json(data: Column, budget: int = 25_000) -> Column:
    """shortened_json of a text that holds a JSON object, guarded as a prompt's text before, so
    that what is measured is what is sent; null for any other text."""

    @F.pandas_udf("string")
    def fit(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                value = json.loads(text or "")
            except ValueError:
                return None
            return shortened_json(value, budget) if isinstance(value, dict) else None

        return texts.map(one)

    return fit(guarding.for_prompt(data))


def combined(parts: DataFrame) -> DataFrame:
    """Facts of several parts (part, case_id, seq, date, type, description, pages) as one run for
    each case: the facts that say something new by date and description, their sorted types,
    the pages of its parts, and how many facts repeat others."""
    from quillspark.operators.review import first_of, norm_key

    own = first_of(parts, ["case_id", norm_key(F.col("date")).alias("_date"), norm_key(F.col("description")).alias("_text")])
    once = own.groupBy("case_id").agg(F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    read = parts.groupBy("case_id", "part").agg(F.max("pages").alias("pages"), F.count("*").alias("n")).groupBy("case_id").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"))
    return once.join(read, "case_id").select("case_id", "facts", "types", "pages", (F.col("n") - F.col("facts")).alias("repeated"))
