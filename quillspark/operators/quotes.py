"""Quotes checked against their pages: a quote counts where it stands whole, and not where it
cuts into a word, a compound or a number.

The check is one pattern for each quote, of the quote itself and what may not stand before and
behind it, so it runs in the JVM; plain containment, which is cheap, goes first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.columns import once
from quillspark.operators.review import norm_key

#: Prefixes that a dash of any length can join to a term.
PREFIXES = (
    "non", "un", "anti", "contra", "pre", "post", "hypo", "hyper", "pseudo", "intra", "inter", "extra", "peri", "para", "sub", "supra", "infra", "super", "re", "de", "dis", "mis",
)
#: Characters of words, what joins two of them, dashes, what parts a number has inside, what ends it, what begins it.
WORD, JOINER, DASH = r"[\p{L}\p{N}\p{M}_]", r"[-‐‑'’/]", "[–—−]"
INNER, SUFFIX, SIGN, DIGIT = r"[.,:/‐‑–—−-]", r"[%％‰‱+−\-°℃℉±]", r"[+\-−±<>≤≥≈~=]", r"\p{Nd}"
LEAST_WORDS = 4
#: More characters than any border looks at.
CONTEXT = 32
_PREFIX = "|".join(PREFIXES)

#: What a quote begins with, and what may not stand right before it then.
BEFORE = (
    (rf"^{WORD}", rf"{WORD}"),
    (rf"^{WORD}", rf"{WORD}{JOINER}"),
    (rf"^{WORD}", rf"(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])(?:{_PREFIX}){DASH}"),
    (rf"^{DIGIT}", rf"{SIGN}"),
    (rf"^{DIGIT}", rf"{DIGIT}{INNER}"),
    (rf"^(?:{INNER}{DIGIT}|{SUFFIX})", rf"{DIGIT}"),
    (rf"^(?:{WORD}|{SUFFIX})", rf"{DIGIT}{SUFFIX}{{1,20}}"),
)
#: What it ends with, and what may not stand right behind it then.
BEHIND = (
    (rf"{WORD}$", rf"{WORD}"),
    (rf"{WORD}$", rf"{JOINER}{WORD}"),
    (rf"(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])(?:{_PREFIX})$", rf"{DASH}{WORD}"),
    (rf"{DIGIT}$", rf"{INNER}{DIGIT}"),
    (rf"{DIGIT}{INNER}$", rf"{DIGIT}"),
    (rf"{DIGIT}{SUFFIX}*$", rf"{SUFFIX}"),
    (rf"{DIGIT}{SUFFIX}+$", rf"{WORD}"),
)


def long_enough(quote: Column) -> Column:
    """Whether a quote has four words, by spaces, that hold a letter or digit."""
    return F.size(F.filter(F.split(F.trim(quote), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))) >= LEAST_WORDS


def stands_in(quote: Column, text: Column) -> Column:
    """Whether a text holds a quote between its borders; both as norm_key has them. The quote has a character.

    Nearly always the first place decides, by fixed patterns and the CONTEXT characters around it;
    only a text whose first place is barred is searched for others, by a pattern of the quote's own."""
    escaped = F.regexp_replace(quote, r"([^\p{L}\p{N}\p{M}\s])", r"\\$1")
    before = [F.when(quote.rlike(begins), F.lit(f"(?<!{barred})")).otherwise("") for begins, barred in BEFORE]
    behind = [F.when(quote.rlike(ends), F.lit(f"(?!{barred})")).otherwise("") for ends, barred in BEHIND]

    def within(part: Column) -> Column:
        left, right = F.substring(part["around"], F.lit(1), part["before"]), F.substring(part["around"], part["before"] + F.length(quote) + 1, F.lit(CONTEXT))
        bars = [quote.rlike(begins) & left.rlike(rf"(?:{barred})\z") for begins, barred in BEFORE] + [quote.rlike(ends) & right.rlike(rf"\A(?:{barred})") for ends, barred in BEHIND]
        return F.when(reduce(Column.__or__, bars), F.regexp_like(text, F.concat(*before, escaped, *behind))).otherwise(True)

    def at(place: Column) -> Column:
        from_ = F.greatest(F.lit(1), place - CONTEXT)
        around = F.substring(text, from_, place - from_ + F.length(quote) + CONTEXT)
        return F.when(place == 0, False).when(place > 0, once(F.struct(around.alias("around"), (place - from_).alias("before")), within))

    return once(F.position(quote, text), at)


def quotes_present(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Quotes (seq, document, page, quote) with found: whether the page at that address, if it is
    the only one there, holds the quote, but for case and white space; short quotes never.
    An empty table of pages finds nothing; a null quote isn't found."""
    at = pages.groupBy("document", "page").agg(F.count("*").alias("n"), F.any_value(norm_key(F.col("text"))).alias("text"))
    joined = quotes.join(at, ["document", "page"], "left").withColumn("_q", norm_key(F.col("quote")))
    whole = long_enough(F.col("quote")) & (F.col("n") == 1) & stands_in(F.col("_q"), F.col("text"))
    return joined.select("seq", F.coalesce(whole, F.lit(False)).alias("found"))


def relocated(facts: DataFrame, members: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts (seq, chunk, document, page, quote) with their document and page, moved to the one
    page of their chunk that holds the quote where their own page doesn't; moved says so. members:
    chunk, document, page. Pages whose address several have take no part.

    A fact meets the pages of its chunk only, and chunks are of bounded size."""
    single = pages.groupBy("document", "page").agg(F.count("*").alias("n"), F.any_value(norm_key(F.col("text"))).alias("text")).where("n = 1").drop("n")
    asked = facts.withColumn("_q", norm_key(F.col("quote"))).where(long_enough(F.col("quote")))
    near = members.join(single, ["document", "page"]).select("chunk", F.struct("document", "page").alias("_at"), "text")
    holds = asked.join(near, "chunk").where(stands_in(F.col("_q"), F.col("text")))
    own = F.col("_at") == F.struct("document", "page")
    found = holds.groupBy("seq").agg(F.count("*").alias("_n"), F.any_value("_at").alias("_to"), F.max(own).alias("_own"))
    move = F.coalesce((F.col("_n") == 1) & ~F.col("_own"), F.lit(False))
    out = facts.join(found, "seq", "left").withColumn("moved", move)
    return out.select("seq", F.when(move, F.col("_to.document")).otherwise(F.col("document")).alias("document"), F.when(move, F.col("_to.page")).otherwise(F.col("page")).alias("page"), "moved")
