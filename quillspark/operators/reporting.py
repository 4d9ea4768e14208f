"""Oversized paragraphs, highlights, mentions, sampled timelines, sections, reports and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.functions.columns import once
from quillspark.operators.replay import State, replayed


def grouped_lines(text: Column, limit: int = 1500) -> Column:
    """A block over the limit as groups of its lines: a line that would exceed it starts a new
    group; each line counts one more for its end."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", "")), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0).alias("used"))

    def step(s: Column, x: Column) -> Column:
        turn = (s["now"] != "") & (s["used"] + F.length(x) > limit)
        return F.struct(
            F.when(turn, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]).alias("out"),
            F.when(turn | (s["now"] == ""), x).otherwise(F.concat(s["now"], F.lit("\n"), x)).alias("now"),
            (F.when(turn, 0).otherwise(s["used"]) + F.length(x) + 1).alias("used"),
        )

    folded = F.aggregate(lines, start, step, lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["now"]))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(folded)


def highlighted(text: Column, tokens: list[str]) -> Column:
    """Whole-word matches of tokens over one letter between double stars, the longest tokens first."""
    for t in sorted({t for t in tokens if len(t) > 1}, key=lambda t: (-len(t), t)):
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])(\Q{t}\E)(?![\p{{L}}\p{{N}}_])", "**$1**")
    return text


def is_export(head: Column, filename: Column, marker: str, record: str, hint: str) -> Column:
    """A marker in the head of a file, and either a record's mark there or a hint in its name."""
    return head.rlike(marker) & (head.rlike(record) | filename.rlike(hint))


def visible(text: Column) -> Column:
    """Whether a character can be seen: no space, control or format character."""
    return F.coalesce(text.rlike(r"[^\s\p{Cc}\p{Cf}\p{Z}]"), F.lit(False))


#: Conditions that mentions() looks for at most.
MOST_CONDITIONS = 10_000


def mentions(conditions: DataFrame, facts: DataFrame) -> DataFrame:
    """condition and n: facts (text) that hold the phrase, or else all its words over three
    letters. Conditions are broadcast, and refused beyond MOST_CONDITIONS; each distinct text is
    looked at once."""
    if conditions.limit(MOST_CONDITIONS + 1).count() > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions: look for them in parts")
    words = F.filter(F.split(F.lower("condition"), r"\s+"), lambda w: F.length(w) > 3)
    asked = F.broadcast(conditions.select("condition", F.lower("condition").alias("_p"), words.alias("_w")))
    hit = F.contains(F.col("_t"), F.col("_p")) | ((F.size("_w") > 0) & F.forall("_w", lambda w: F.contains(F.col("_t"), w)))
    found = facts.groupBy(F.lower("text").alias("_t")).agg(F.count("*").alias("_n")).join(asked, hit).groupBy("condition").agg(F.sum("_n").alias("n"))
    return conditions.select("condition").join(found, "condition", "left").select("condition", F.coalesce("n", F.lit(0)).alias("n"))


def printed_dates(text: Column, most: int = 6) -> Column:
    """The first distinct dates that a text prints: array of raw, iso and precision."""
    any_date = rf"(?i)\b(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}-\d{{1,2}}|(?:{dates.MONTH})\.?\s+\d{{1,2}},?\s+\d{{4}}|(?:{dates.MONTH})\.?\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{4}})\b"
    raw = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(any_date), F.lit(0))), 1, most)

    def one(r: Column) -> Column:
        return dates.let(dates.printed_date(r), lambda d: F.struct(r.alias("raw"), d["iso"].alias("iso"), F.coalesce(d["precision"], F.lit("unresolved")).alias("precision")))

    return F.transform(raw, one)


def sections(text: Column) -> Column:
    """A Markdown checklist at its '## X. title' headings: array of letter, title and body."""
    parts = F.filter(F.split(text, r"(?m)(?=^## [A-Z]\. )"), lambda p: p.rlike(r"^## [A-Z]\. "))
    head = r"^## ([A-Z])\. ([^\n]*)\n?"
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, head, 1).alias("letter"), F.trim(F.regexp_extract(p, head, 2)).alias("title"), F.trim(F.regexp_replace(p, head, "")).alias("body")))


def report(rows: DataFrame, group: str, order: str, line: Column, title: Column) -> DataFrame:
    """group and text: a Markdown section per group, its lines in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(group).agg(lines.alias("_lines")).select(group, F.concat(F.lit("## "), title, F.lit("\n\n"), "_lines").alias("text"))


def ledger(events: DataFrame, budget: int) -> DataFrame:
    """run, state, reserved, spent and refused after a replay of (run, seq, kind, amount): reserve
    takes from the budget if it fits, attempt spends from what is reserved, finish gives the
    rest back; what can't be done, or has no amount, is refused."""

    def step(s: State, x: State) -> None:
        kind, amount = x["kind"], x["amount"]
        if kind == "reserve" and s["state"] == "new" and amount is not None and amount <= budget:
            s.update(state="open", reserved=amount)
        elif kind == "attempt" and s["state"] == "open" and amount is not None and s["spent"] + amount <= s["reserved"]:
            s["spent"] += amount
        elif kind == "finish" and s["state"] == "open":
            s.update(state="done", reserved=s["spent"])
        else:
            s["refused"] += 1

    rows = events.select("run", "seq", "kind", F.col("amount").cast("long").alias("amount"))
    start = {"state": "new", "reserved": 0, "spent": 0, "refused": 0}
    return replayed(rows, "run", ["seq"], start.copy, step, "state string, reserved long, spent long, refused long")


#: What counts as white space at a text's ends and between its words.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
#: Lines that head a section without a mark, and the words that begin a closing.
PLAIN_HEADINGS = (
    "header", "introduction", "introduction & credentials of observation", "in-service event / onset", "observed symptoms and their progression", "observed symptoms",
    "functional impact", "continuity", "continuity statement", "closing", "certification", "closing & certification", "signature",
)
CLOSING = r"(?i)\bI\s+(?:(?:hereby|solemnly)\s+)?(?:certify|declare|affirm|attest)\b"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def plain(text: Column) -> Column:
    """Words joined by single spaces."""
    return _bare(F.regexp_replace(text, rf"{WHITE}+", " "))


def headings(text: Column) -> Column:
    """The lines of a text that aren't blank, each as struct(label, filled): the heading's plain
    label (null for other lines), and whether the next line is none."""
    lines = F.filter(F.transform(F.split(text, r"\R|[\x1C-\x1E]"), _bare), lambda x: x != "")

    def label(x: Column) -> Column:
        bare = F.lower(plain(F.regexp_replace(F.regexp_replace(x, r"^(?:#{1,6}\s+|\d+[.)]\s+)", ""), r"^[*_#: ]+|[*_#: ]+$", "")))
        starred = x.startswith("**") & F.regexp_replace(x, ":+$", "").endswith("**")
        return once(bare, lambda name: F.when((name != "") & (x.startswith("#") | starred | (x.rlike(r"^\d+[.)]\s+") & (F.length(name) <= 120)) | name.isin(*PLAIN_HEADINGS)), name))

    def filled(labels: Column) -> Column:
        return F.transform(labels, lambda x, i: F.struct(x.alias("label"), ((i + 1 < F.size(labels)) & F.get(labels, i + 1).isNull()).alias("filled")))

    return once(F.transform(lines, label), filled)


def lost(had: Column, has: Column) -> Column:
    """Whether an element stands less often in has than in had."""

    def fewer(both: Column) -> Column:
        return F.exists(F.array_distinct(both["had"]), lambda p: F.size(F.filter(both["had"], lambda x: x == p)) > F.size(F.filter(both["has"], lambda x: x == p)))

    return once(F.struct(had.alias("had"), has.alias("has")), fewer)


def rejected(before: Column, after: Column, placeholder: str = r"\[[^\[\]]+\]") -> Column:
    """Why a revised text can't stand, the first of: no statement (null or blank), too short, a
    placeholder or a heading lost (each counts as often as it stands there), a section emptied,
    the closing changed, the text changed; or "". A null original is empty."""
    old, new = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))

    def held(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(placeholder), F.lit(0)), plain)

    def named(text: Column, filled: bool) -> Column:
        return F.transform(F.filter(headings(text), lambda h: h["label"].isNotNull() & (h["filled"] if filled else F.lit(True))), lambda h: h["label"])

    from_ = F.length(old) - F.length(F.regexp_replace(old, rf"(?s)^.*?(?={CLOSING})", ""))
    closing = F.when(old.rlike(CLOSING), plain(F.substring(old, from_ + 1, F.length(old))))
    short = F.length(_bare(new)) <= F.greatest(F.lit(200), F.floor(F.length(old) * 0.4))
    rules = [
        (_bare(new) == "", "no statement"),
        (short, "too short"),
        (lost(held(old), held(new)), "placeholder lost"),
        (lost(named(old, False), named(new, False)), "heading lost"),
        (lost(named(old, True), named(new, True)), "section emptied"),
        (~plain(new).endswith(closing), "closing changed"),
        (plain(old) != plain(new), "text changed"),
    ]
    return F.coalesce(*[F.when(rule, F.lit(reason)) for rule, reason in rules], F.lit(""))
