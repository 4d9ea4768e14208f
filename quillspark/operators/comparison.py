"""Facts against their sources: what a sentence claims by family, what changed, and which source it may come from."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import mapped, once, worked_out
from quillspark.operators import choosing
from quillspark.session import settled

#: What is a word, a number, a claim of cause, a border of clauses.
WORD = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?"
NUMBER = r"(?<![\p{L}\p{N}_])-?\d+(?:[.,]\d+)*(?![\p{L}\p{N}_])"
#: Number words and what they count.
NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40",
    "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000", "million": "1000000",
}
#: Words without content of their own.
GRAMMAR = (
    "i", "me", "my", "we", "us", "our", "he", "she", "him", "her", "his", "they", "them", "their", "it", "its", "the", "a", "an", "this", "that", "these", "those", "and", "or", "but",
    "as", "is", "are", "was", "were", "be", "been", "being", "am", "have", "has", "had", "do", "does", "did", "to", "of", "from", "in", "on", "at", "for", "with", "by", "after", "before",
    "since", "during", "until", "which", "who", "whom", "what", "when", "where", "than", "then", "so", "also", "can", "will", "would", "should", "medical", "clinical", "record",
    "records", "show", "shows", "state", "states", "note", "notes", "according",
)
#: Words that count as one.
SAME = {"observed": "observe", "observe": "observe", "observing": "observe", "saw": "observe", "seen": "observe", "see": "observe", "watched": "observe", "reported": "report", "reports": "report", "report": "report"}
#: Families of words, each a list of the words found.
LISTED = {
    "calendar_dates": (
        "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
        "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    ),
    "chronology": ("before", "after", "since", "during", "until", "earlier", "later", "prior", "following"),
    "laterality": ("left", "right", "bilateral", "both"),
    "frequency": ("daily", "weekly", "monthly", "hourly", "occasionally", "sometimes", "constantly", "always", "every"),
}
#: Families of marks, each mark there if one of its words is.
MARKED = {
    "speaker": {"first person": ("i", "me", "my", "we", "our", "us"), "third person": ("he", "she", "him", "her", "his", "they", "them", "their")},
    "negation": {
        "negated": (
            "no", "not", "never", "denies", "denied", "without", "cannot", "can't", "didn't", "isn't", "wasn't", "doesn't", "hasn't", "haven't", "couldn't", "won't", "unable", "negative",
        )
    },
    "date_precision": {"approximate": ("around", "about", "approximately", "circa", "roughly")},
    "uncertainty": {"uncertain": ("maybe", "possibly", "possible", "might", "could", "uncertain", "unsure", "believe", "think", "suspect")},
    "attribution": {"observed": ("observed", "saw", "seen", "watched", "personally"), "reported": ("told", "reported", "reports", "said", "says")},
}
DIAGNOSIS = ("diagnosed", "diagnosis", "diagnoses")
#: All of these words.
TOLD = tuple(dict.fromkeys(w for some in (*LISTED.values(), *(x for rules in MARKED.values() for x in rules.values()), DIAGNOSIS) for w in some))
#: What a text's claims are told apart by.
FAMILIES = ("wording", "numbers", *LISTED, *MARKED, "bindings", "nexus")
#: What a witness's fields may be wrapped in, by field, and words of how often.
IDENTITY = ("name", "relationship", "known_since", "contact_frequency")
OPPORTUNITY = (
    "daily", "weekly", "monthly", "hourly", "occasionally", "sometime", "constant", "always", "every", "day", "days", "week", "month", "year", "hour", "time", "often", "rarely", "regularly",
)
#: Lines of form, and how records are named as the source.
FORM = (
    "header", "introduction", "introduction & credentials of observation", "in-service event / onset", "observed symptoms and their progression", "observed symptoms",
    "functional impact", "continuity", "continuity statement", "closing", "certification", "closing & certification", "signature",
)
#: The words of FORM, one key each.
FORM_KEYS = tuple(" ".join(re.findall(r"\w+", line)) for line in FORM)
#: How a sentence is held that has sources.
CHOSEN = ("exact", "contained", "linked")
OATH = "i certify that this statement is true and correct to the best of my knowledge and belief"
ATTRIBUTED = r"(?i)\b(?:records? (?:show|state|report|document|note)|according to (?:the )?(?:medical )?records?|(?:medical|clinical) (?:record|note|report))\b"
BORDER = r"[;!?]|\b(?:and|or|but)\b|(?<!\d)[,.]|[,.](?!\d)"
CAUSE = r"(?i)\b(?:caused by|due to|service[- ]connected|nexus)\b"
#: Words in a row on which texts meet that hold one another.
GRAM = 4
#: What no lower-cased clause with a number is without.
COUNTED = rf"\d|(?<![a-z])(?=[{''.join(sorted({w[0] for w in NUMBERS}))}])(?:{'|'.join(NUMBERS)})(?![a-z])"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), F.lit(WORD), F.lit(0))


def content_word(w: Column) -> Column:
    """A word by what it means the same as, else without ing, ed or s."""
    def without(n: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - n)

    stem = F.when((F.length(w) > 5) & w.endswith("ing"), without(3)).when((F.length(w) > 4) & w.endswith("ed"), without(2)).when((F.length(w) > 4) & w.endswith("s"), without(1)).otherwise(w)
    return F.when(w.isin(*SAME), F.try_element_at(mapped(SAME), w)).otherwise(stem)


def number_bindings(text: Column) -> Column:
    """Every number of a text (digits or a word) with what it is bound to: the content words of its
    clause, which of the clause's numbers it is, and how many of those words stand before it. A
    sorted array; equal bindings are numbered. A null text has none. Clauses without a number,
    which most are, are passed over before their words are told apart."""
    counted = mapped(NUMBERS)

    def content(w: Column) -> Column:
        return ~w.isin(*GRAMMAR, "known", "know", "name") & ~w.isin(*NUMBERS) & ~w.rlike(rf"^(?:\p{{Nd}}+|{NUMBER})$")

    def of_clause(tokens: Column) -> Column:
        each = F.transform(tokens, lambda t: F.struct(F.when(t.isin(*NUMBERS), F.try_element_at(counted, t)).when(t.rlike(f"^{NUMBER}$"), t).alias("number"), F.when(content(t), content_word(t)).alias("word")))
        return once(each, bound)

    def bound(marks: Column) -> Column:
        said = F.array_join(F.array_compact(F.transform(marks, lambda m: m["word"])), " ")

        def upto(i: Column, part: str) -> Column:
            return F.size(F.filter(F.slice(marks, F.lit(1), i), lambda m: m[part].isNotNull())).cast("string")

        return F.array_compact(F.transform(marks, lambda m, i: F.when(m["number"].isNotNull(), F.concat_ws("|", said, upto(i + 1, "number"), upto(i, "word"), m["number"]))))

    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("’"), F.lit("'")))

    def of_text(t: Column) -> Column:
        clauses = F.transform(F.filter(F.split(t, BORDER), lambda c: c.rlike(COUNTED)), lambda c: of_clause(F.regexp_extract_all(c, F.lit(f"{NUMBER}|{WORD}"), F.lit(0))))
        numbered = once(F.flatten(clauses), lambda b: F.transform(b, lambda x, i: F.concat(x, F.lit(":"), F.size(F.filter(F.slice(b, F.lit(1), i + 1), lambda y: y == x)).cast("string"))))
        return F.when(t.rlike(COUNTED), F.array_sort(numbered)).otherwise(F.array().cast("array<string>"))

    return once(lowered, of_text)


def stated(text: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    """Families of what a text claims, a struct of sorted arrays: its content words, numbers (digits
    and words), the words of LISTED and the marks of MARKED, what numbers are bound to, and
    diagnoses and causes; those named alone. A null text has empty families."""
    full = F.coalesce(text, F.lit(""))

    def of_words(own: Column) -> Column:
        return once(F.filter(own, lambda w: w.isin(*TOLD)), lambda told: of_both(own, told))

    def of_both(own: Column, told: Column) -> Column:
        """told: those of the words that a list or a mark names."""
        spelt = F.transform(F.filter(own, lambda w: w.isin(*NUMBERS)), lambda w: F.try_element_at(mapped(NUMBERS), w))

        def has(some: tuple[str, ...]) -> Column:
            return F.arrays_overlap(told, F.array(*map(F.lit, some)))

        def marks(rules: dict[str, Column]) -> Column:
            return F.array_compact(F.array(*[F.when(rule, mark) for mark, rule in sorted(rules.items())]))

        wording = F.filter(own, lambda w: ~w.isin(*GRAMMAR) & ~w.isin(*NUMBERS) & ~w.rlike(r"^\p{Nd}+$"))
        out = {"wording": F.array_sort(F.array_distinct(F.transform(wording, content_word))), "numbers": F.array_sort(F.array_union(F.regexp_extract_all(full, F.lit(NUMBER), F.lit(0)), spelt))}
        out |= {name: F.array_sort(F.array_intersect(told, F.array(*map(F.lit, some)))) for name, some in LISTED.items()}
        out |= {name: marks({m: has(some) for m, some in rules.items()}) for name, rules in MARKED.items()}
        out |= {"bindings": number_bindings(text), "nexus": marks({"diagnosis": has(DIAGNOSIS), "causation": full.rlike(CAUSE)})}
        return F.struct(*[out[k].alias(k) for k in families])

    return once(F.array_distinct(words(full)), of_words)


def critical_flags(facts: DataFrame, most: int | None = 100) -> DataFrame:
    """seq and fields of facts (seq, date, description, quote) whose description says something
    other than their own quote: families that differ, content words that the quote lacks, and
    numbers of the date that it lacks. The first most by seq."""
    a, b = ({k: F.col(f"{x}.{k}") for k in FAMILIES} for x in ("_quote", "_said"))
    facts = worked_out(facts.select("seq", "date", "quote", "description"), _quote=stated(F.col("quote")), _said=stated(F.col("description")))
    changed = [F.when(a[k] != b[k], k) for k in FAMILIES if k != "wording"]
    changed.append(F.when(F.size(F.array_except(b["wording"], a["wording"])) > 0, "wording"))
    changed.append(F.when(F.size(F.array_except(F.regexp_extract_all(F.coalesce("date", F.lit("")), F.lit(r"\d+"), F.lit(0)), a["numbers"])) > 0, "date"))
    out = worked_out(facts, fields=F.array_compact(F.array(*changed))).select("seq", "fields").where(F.size("fields") > 0)
    return out if most is None else out.orderBy("seq").limit(most)


def key_of(text: Column) -> Column:
    """A text's words joined by spaces: what makes texts equal here."""
    full = F.coalesce(text, F.lit(""))
    # Without an apostrophe, words are all that isn't between them.
    bare = F.trim(F.regexp_replace(F.lower(full), r"[^\p{L}\p{N}_]+", " "))
    return F.when(F.contains(full, F.lit("'")) | F.contains(full, F.lit("’")), F.array_join(words(full), " ")).otherwise(bare)


def supported(outputs: DataFrame, sources: DataFrame, most: int | None = 3, least_words: int = 4, scope: tuple[str, ...] = ()) -> DataFrame:
    """left_id, right_id, how and place: the sources (id, text) that hold an output (id, text)
    word for word: exact, or else contained, if the output has least_words. First by id; all
    with most None. Rows meet within equal scope columns, which come out too.

    A source that contains an output has each run of GRAM of its words, so an output meets only
    the sources with the run that fewest have; runs meet as hashes, and texts are compared then.
    Of equal sources, the first most alone take part: no later one can come out."""
    a, b = (settled(worked_out(x.select(*scope, "id", "text"), key=key_of(F.col("text"))).select(*scope, "id", "key")) for x in (outputs, sources))
    return supported_keys(a, b, most, least_words, scope)


def supported_keys(outputs: DataFrame, sources: DataFrame, most: int | None = 3, least_words: int = 4, scope: tuple[str, ...] = ()) -> DataFrame:
    """supported, of tables that have the key_of their text (id, key) already."""
    left, right, w = [*scope, "left_id"], [*scope, "right_id"], [*scope, "w"]
    a = outputs.select(*scope, F.col("id").alias("left_id"), "key").where("key <> ''")
    b = sources.select(*scope, F.col("id").alias("right_id"), "key").where("key <> ''")
    if most is not None:
        b = b.withColumn("_nth", F.row_number().over(Window.partitionBy(*scope, "key").orderBy("right_id"))).where(F.col("_nth") <= most).drop("_nth")
    exact = a.join(b, [*scope, "key"]).select(*left, "right_id", F.lit("exact").alias("how"))
    rest = a.where(F.size(F.split("key", " ")) >= least_words).join(exact.select(*left).distinct(), left, "left_anti")
    n = max(1, min(least_words, GRAM))

    def runs(own: Column) -> Column:
        return F.when(F.size(own) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(own) - (n - 1)), lambda i: F.xxhash64(F.slice(own, i, n)))))

    asked = rest.select(*left, F.explode(once(F.split("key", " "), runs)).alias("w"))
    postings = b.select(*right, F.explode(once(F.split("key", " "), runs)).alias("w"))
    postings = settled(postings.join(asked.select(*w).distinct(), w, "left_semi"))
    df = postings.groupBy(*w).agg(F.count("*").alias("n"))
    rarest = asked.join(df, w, "left").groupBy(*left).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("r")).where("r.n > 0").select(*left, F.col("r.w").alias("w"))
    near = rarest.join(postings, w).join(rest, left).join(b.withColumnRenamed("key", "source"), right)
    held = near.where(F.contains(F.concat(F.lit(" "), "source", F.lit(" ")), F.concat(F.lit(" "), "key", F.lit(" ")))).select(*left, "right_id", F.lit("contained").alias("how"))
    place = F.row_number().over(Window.partitionBy(*left).orderBy("right_id"))
    found = exact.unionByName(held).withColumn("place", place)
    return found if most is None else found.where(F.col("place") <= most)


@dataclass(frozen=True)
class Compared:
    """What a comparison of drafts with their sources says. rows: draft_id, ord, sentence, how,
    source_ids, candidates, changed and reasons of every sentence; left_over: draft_id and
    source_id of the account's passages that no sentence without reasons uses; drafts: draft_id,
    status (blocked or review_required) and issues. whole has a row for each draft, of which the
    others are parts: each is worked out from it when it is read, so persist it to read several."""

    rows: DataFrame
    left_over: DataFrame
    drafts: DataFrame
    whole: DataFrame


def sentences(texts: DataFrame, text: str = "text") -> DataFrame:
    """The sentences and lines of each text, with their ord from 0; null texts have none."""
    return worked_out(texts, _spans=_spans(F.col(text))).select(*[c for c in texts.columns if c != text], F.posexplode("_spans").alias("ord", "sentence"))


def _spans(text: Column) -> Column:
    """Parts that end before white space after a mark, or at the end of a line, without white space at their ends."""
    parts = F.split(F.regexp_replace(text, r"([.!?])(?=\s)", "$1\n"), "\n")
    # Most texts have spaces alone; a $ is also before a last one of these others.
    cut = F.when(text.rlike(r"[\t\x0B\f\r\x85\u2028\u2029]"), F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).otherwise(F.transform(parts, lambda x: F.trim(x)))
    return F.filter(cut, lambda x: x != "")


def is_form(text: Column, key: Column | None = None) -> Column:
    """Whether a line (with its key_of, where it is known) is a heading or the oath, and says nothing of the case."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\s#*: ]+|[\s#*: ]+$", ""), r"\.+$", "")
    key = key_of(text) if key is None else key
    # What is cut off holds no words.
    return (key.isin(*FORM_KEYS) & F.lower(bare).isin(*FORM)) | (key == OATH)


def _excess(expected: dict[str, Column], actual: dict[str, Column], kinds: Column, fields: Column, often: Column) -> Column:
    """The families in which a sentence says more or less than its sources (with their kinds and
    fields, and whether they hold words of how often alone): a witness's fields may be wrapped in a
    few words of their own."""
    apart = kinds == F.array(F.lit("field"))
    often = apart & (fields == F.array(F.lit("contact_frequency"))) & often
    has = {f: F.array_contains(fields, f) for f in IDENTITY}

    def free(rule: Column, *some: str) -> Column:
        return F.when(rule, F.array(*map(F.lit, some))).otherwise(F.array().cast("array<string>"))

    allowed = {
        "chronology": free(has["known_since"], "since"),
        "attribution": free(often, "observed"),
        "wording": F.concat(free(has["name"], "name"), free(has["known_since"], "know", "known"), free(often, "observe")),
    }
    identity = apart & (F.size(fields) > 0) & (F.size(F.array_except(fields, F.array(*map(F.lit, IDENTITY)))) == 0)
    out = []
    for name, said in actual.items():
        added = F.array_except(said, expected[name])
        if name in allowed:
            added = F.array_except(added, allowed[name])
        more = F.size(added) > 0
        differs = (more & ~identity if name == "speaker" else more) | (F.size(F.array_except(expected[name], said)) > 0)
        out.append(F.when((said != expected[name]) & differs, name))
    return F.array_compact(F.array(*out))


def compared(drafts: DataFrame, sources: DataFrame, links: DataFrame | None = None, whole_account: bool = True, most_spans: int = 4000, most_chars: int = 120_000) -> Compared:
    """Drafts (draft_id, text) sentence by sentence against their sources (draft_id, source_id,
    kind: account, field or quote, field: the field's name, text; a passage each).

    A sentence's options are the sources that hold it word for word; it takes the first that no
    earlier sentence without reasons has taken, or else the first. Others are held against the
    source that shares most words with them, which is a suggestion only. links (draft_id, ord,
    source_id: three a sentence at most) choose instead. Reasons are: unlinked, invalid (links to
    unknown or too many sources), the families that changed (`changed`), unattributed (a record's
    quote told as one's own) and placeholder. Sentences of form are passed over. A blank draft, or
    one with more than most_chars or most_spans sentences or sources, is blocked without rows.

    A draft that isn't refused is one row, with its sources in it: rows meet once, by draft, and
    nothing is written in between. Equal texts of a draft are looked at once, and sentences of
    equal text share their options, so that n copies in a draft and m in its sources are n + m
    numbers, not n * m pairs. What texts say is compared only where they differ."""
    passages = sources.select("draft_id", "source_id", "kind", F.when(F.col("kind") == "field", F.col("field")).alias("field"), F.coalesce("text", F.lit("")).alias("text"))
    # One source more than a draft may have tells that it has too many.
    nth = F.row_number().over(Window.partitionBy("draft_id").orderBy("source_id"))
    each = F.struct("source_id", "kind", "field", "text")
    known = passages.withColumn("nth", nth).where(F.col("nth") <= most_spans + 1).groupBy("draft_id").agg(F.count("*").alias("known"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most_spans, each))).alias("spoken"))
    told = worked_out(drafts.select("draft_id", F.coalesce("text", F.lit("")).alias("text")), parts=_spans(F.col("text")))
    told = told.join(known, "draft_id", "left")
    nothing = F.array().cast("array<string>")
    told = told.withColumn("asked", F.array().cast("array<struct<ord:int,source_id:string>>")) if links is None else told.join(_asked(links), "draft_id", "left")
    refused = F.when(F.col("draft_id").isNull() | (F.size("parts") == 0), "blank").when(F.length("text") > most_chars, "too long").when(F.size("parts") > most_spans, "too many sentences").when(F.col("known") > most_spans, "too many sources")
    told = worked_out(told, refused=refused)
    kinds = {name: told.schema[name].dataType for name in ("parts", "spoken", "asked")}
    told = told.select("draft_id", "refused", *[F.when(F.col("refused").isNull() & F.col(n).isNotNull(), F.col(n)).otherwise(F.array().cast(kind)).alias(n) for n, kind in kinds.items()])

    # From here on texts are numbers, and sources their places.
    told = told.select("*", choosing.numbered("parts", "spoken.text").alias("at"))
    told = worked_out(told, texts=once(F.concat("parts", "spoken.text"), lambda x: F.transform("at.first", lambda i: F.get(x, i))))
    told = worked_out(told, keys=F.transform("texts", key_of))

    def text_of(t: Column) -> Column:
        return F.get("texts", t)

    lines = F.filter(F.transform("at.parts", lambda t, i: F.struct(i.alias("ord"), t.alias("t"))), lambda s: ~is_form(text_of(s["t"]), F.get("keys", s["t"])))
    form = F.transform("spoken", lambda s: F.when(s["kind"] == "field", F.concat_ws(":", F.lit("field"), s["field"])).when(s["kind"] == "quote", "quote").otherwise(""))
    places = F.array().cast("array<int>") if links is None else F.transform("asked.source_id", lambda i: (F.nullif(F.array_position("spoken.source_id", i), F.lit(0)) - 1).cast("int"))
    told = worked_out(told, said=lines, spoken_t=F.col("at.spoken"), form=form, places=places).drop("parts", "at")
    told = told.select("*", choosing.met("keys", "said.t", "said.ord", "spoken_t", "form", "asked.ord", "places").alias("met")).drop("keys", "form", "places", "asked")
    told = worked_out(told, says=F.map_from_arrays("met.wanted", F.transform("met.wanted", lambda t: stated(text_of(t)))))

    def verdict(o: Column, own: Column) -> Column:
        """What is changed, and the reasons, in an option with one of its sets of sources."""
        compared = F.transform(own, lambda p: F.struct(F.get("spoken", p).alias("s"), F.try_element_at("says", F.get("spoken_t", p)).alias("states")))
        full = once(compared, lambda x: once(F.try_element_at("says", o["t"]), lambda says: once(F.when(says.isNotNull(), changed(says, x)).otherwise(nothing), lambda c: F.struct(c.alias("changed"), reasons(o, x, c).alias("reasons")))))
        return F.when(o["plain"] & ~F.contains(text_of(o["t"]), F.lit("[")), F.struct(nothing.alias("changed"), nothing.alias("reasons"))).otherwise(full)

    def changed(says: Column, x: Column) -> Column:
        of = F.struct(*[F.array_sort(F.array_distinct(F.array_compact(x["s"][k]))).alias(k) for k in ("kind", "field")])
        calm = (F.size(x) > 0) & F.forall(x, lambda s: F.size(F.array_except(s["states"]["wording"], F.array(*map(F.lit, OPPORTUNITY)))) == 0)
        states = {k: F.coalesce(F.get(x["states"][k], F.lit(0)), nothing) if links is None else F.flatten(x["states"][k]) for k in FAMILIES}
        return once(of, lambda f: _excess(states, {k: says[k] for k in FAMILIES}, f["kind"], f["field"], calm))

    def reasons(o: Column, x: Column, c: Column) -> Column:
        chosen, sentence = o["how"].isin(*CHOSEN), text_of(o["t"])
        rules = [
            ("invalid", o["how"] == "invalid"), ("unlinked", ~chosen), ("changed", F.size(c) > 0),
            ("unattributed", chosen & F.exists(x, lambda s: F.coalesce(s["s"]["kind"] == "quote", F.lit(False))) & ~sentence.rlike(ATTRIBUTED)), ("placeholder", sentence.rlike(r"\[[^\[\]]+\]")),
        ]
        return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))

    told = worked_out(told, verdicts=F.transform("met.options", lambda o: F.transform(o["sets"], lambda own: verdict(o, own)))).drop("says", "spoken_t")
    clean = F.transform("verdicts", lambda v: F.transform(v, lambda x: F.size(x["reasons"]) == 0))
    told = told.select("*", choosing.taken("met.uses", "met.like", "met.options.how", "met.options.sets", clean).alias("taken"))
    ids = F.array().cast(told.select("spoken.source_id").schema[0].dataType)

    def ids_of(places: Column) -> Column:
        return F.transform(places, lambda p: F.get("spoken.source_id", p))

    def row(s: Column, i: Column) -> Column:
        use, pick, at = F.get("met.uses", i), F.get("taken.pick", i), F.get("taken.at", i)
        o, v = F.get("met.options", use), F.get(F.get("verdicts", use), pick)
        own = F.when(at >= 0, F.array(F.get("spoken.source_id", at))).when(o["how"] == "linked", ids_of(F.get(o["sets"], pick))).otherwise(ids)
        return F.struct(s["ord"].alias("ord"), text_of(s["t"]).alias("sentence"), o["how"].alias("how"), own.alias("source_ids"), ids_of(o["candidates"]).alias("candidates"), v["changed"].alias("changed"), v["reasons"].alias("reasons"))

    told = worked_out(told, rows=F.transform("said", row)).select("draft_id", "refused", "spoken", "rows")
    used = F.flatten(F.transform(F.filter("rows", lambda r: F.size(r["reasons"]) == 0), lambda r: r["source_ids"]))
    account = F.transform(F.filter("spoken", lambda s: (s["kind"] == "account") & ~is_form(s["text"])), lambda s: s["source_id"])
    whole = told.select("draft_id", "refused", "rows", F.array_except(account, used).alias("left_over"))
    bad, short = F.size(F.filter("rows", lambda r: F.size(r["reasons"]) > 0)) > 0, F.size("left_over") > 0
    issues = F.array_compact(F.array(F.col("refused"), F.when(F.col("refused").isNull() & (F.size("rows") == 0), "no sentences"), F.when(F.lit(whole_account) & short, "passages left over"), F.when(bad, "sentences with reasons")))
    issued = whole.select("draft_id", F.when(F.size(issues) == 0, "review_required").otherwise("blocked").alias("status"), issues.alias("issues"))
    return Compared(whole.select("draft_id", F.inline("rows")), whole.select("draft_id", F.explode("left_over").alias("source_id")), issued, whole)


def _asked(links: DataFrame) -> DataFrame:
    """draft_id and asked: the links (ord, source_id) of its sentences, one more for each than it may have at most."""
    nth = F.row_number().over(Window.partitionBy("draft_id", "ord").orderBy("source_id"))
    some = links.select("draft_id", F.col("ord").cast("int").alias("ord"), "source_id").distinct().withColumn("nth", nth).where(F.col("nth") <= choosing.MOST + 1)
    return some.groupBy("draft_id").agg(F.collect_list(F.struct("ord", "source_id")).alias("asked"))
