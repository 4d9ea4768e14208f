"""Dates as records print them: two parsers, with precision and order keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
NAMED_DAY = rf"(?i)\b({MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
SLASH = r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"
ISO_DAY = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
ISO_MONTH = r"\b(\d{4})-(\d{1,2})\b"
MONTH_YEAR = rf"(?i)\b({MONTH})\.?\s+(\d{{4}})\b"
YEAR = r"\b(\d{4})\b"
APPROXIMATE = r"(?i)^\s*(?:circa|c\.|around|approx\.?|approximately)\s"
SEARCH = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
UNDATED = "9999-99-99"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _month(name: Column) -> Column:
    """The number of a month by its first three letters."""
    return ((F.position(F.lower(F.substring(name, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.date_format(F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def literal_date(text: Column) -> Column:
    """struct(iso, precision) by the first kind of date found in strict order; null if none,
    or if that first one is invalid or its order of day and month is open."""
    return let(text, _literal_date)


def _literal_date(text: Column) -> Column:
    nothing = F.lit(None).cast("struct<iso:string,precision:string>")

    def made(iso: Column, precision: str) -> Column:
        return F.when(iso.isNotNull(), F.struct(iso.alias("iso"), F.lit(precision).alias("precision"))).otherwise(nothing)

    one, two, year = (_part(text, SLASH, g) for g in (1, 2, 3))
    a, b = one.cast("int"), two.cast("int")
    open_ = (F.length(year) != 4) | ((a <= 12) & (b <= 12) & (a != b))
    slash = F.when(open_, nothing).otherwise(made(_date(year, F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b)), "day"))
    first = F.lit("01")
    by_year = made(_date(_part(text, YEAR, 1), first, first), "year")
    month_year = made(_date(_part(text, MONTH_YEAR, 2), _month(_part(text, MONTH_YEAR, 1)), first), "month")
    return (
        F.when(text.isNull() | (text == ""), nothing)
        .when(text.rlike(NAMED_DAY), made(_date(_part(text, NAMED_DAY, 3), _month(_part(text, NAMED_DAY, 1)), _part(text, NAMED_DAY, 2)), "day"))
        .when(text.rlike(SLASH), slash)
        .when(text.rlike(ISO_DAY), made(_date(_part(text, ISO_DAY, 1), _part(text, ISO_DAY, 2), _part(text, ISO_DAY, 3)), "day"))
        .when(text.rlike(ISO_MONTH), made(_date(_part(text, ISO_MONTH, 1), _part(text, ISO_MONTH, 2), first), "month"))
        .when(text.rlike(MONTH_YEAR), F.coalesce(month_year, by_year))
        .when(text.rlike(YEAR), by_year)
        .otherwise(nothing)
    )


def _approximate(text: Column) -> Callable[[Column], Column]:
    def body(d: Column) -> Column:
        p = d["precision"]
        named = F.when((p != "year") & text.rlike(APPROXIMATE), F.concat(F.lit("approximate-"), p)).otherwise(p)
        return F.when(d.isNotNull(), F.struct(d["iso"].alias("iso"), named.alias("precision")))

    return body


def printed_date(text: Column) -> Column:
    """literal_date, whose precision says approximate- where the text begins so and more than a year is given."""
    return let(text, lambda t: let(_literal_date(t), _approximate(t)))


def key_of(d: Column) -> Column:
    """A string to order parsed dates by: years in their middle, months at their first day, undated last."""
    return (
        F.when(d.isNull(), F.lit(UNDATED))
        .when(d["precision"] == "year", F.concat(F.substring(d["iso"], 1, 4), F.lit("-06-15")))
        .when(d["precision"] == "month", F.concat(F.substring(d["iso"], 1, 7), F.lit("-01")))
        .otherwise(d["iso"])
    )


def sort_key(text: Column) -> Column:
    """key_of the date that a text prints."""
    return let(printed_date(text), key_of)


def search_dates(text: Column) -> Column:
    """Dates of the lenient parser: ISO, then month/day/year with four or two digits (69 to 99 are of the 1900s)."""
    found = F.regexp_extract_all(text, F.lit(SEARCH), F.lit(0))

    def one(raw: Column) -> Column:
        y = F.regexp_extract(raw, r"^\d{1,2}/\d{1,2}/(\d{2,4})$", 1)
        full = F.when(F.length(y) == 2, F.concat(F.when(y.try_cast("int") >= 69, F.lit("19")).otherwise(F.lit("20")), y)).when(F.length(y) == 4, y)
        m, d = F.regexp_extract(raw, r"^(\d{1,2})/", 1), F.regexp_extract(raw, r"^\d{1,2}/(\d{1,2})/", 1)
        return F.coalesce(F.try_to_date(raw, "yyyy-MM-dd"), F.try_to_date(F.concat_ws("-", full, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))

    return F.filter(F.transform(found, one), lambda d: d.isNotNull())


def any_date_between(text: Column, low: str | None, high: str | None) -> Column:
    """Whether any date in the text lies in the range; false without dates."""

    def inside(d: Column) -> Column:
        ok = F.lit(True)
        if low:
            ok = ok & (d >= F.lit(low).cast("date"))
        if high:
            ok = ok & (d <= F.lit(high).cast("date"))
        return ok

    return F.exists(search_dates(text), inside)


def category(kind: Column) -> Column:
    """diagnostic, treatment or other."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin("diagnosis", "test_result", "symptom", "provider_visit"), "diagnostic").when(k.isin("treatment", "medication", "hospitalization"), "treatment").otherwise("other")
