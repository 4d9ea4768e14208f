"""Records out of JSON responses: find the list of records, and make a document of each item.

Responses are variants, so that a list, an object and a string are told apart by type and not
by how they are spelt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys that responses use, in the order they are tried.
LISTS = ("documents", "records", "files", "items")
NAMES = ("filename", "name", "title", "id")
TYPES = ("content_type", "mime_type", "media_type", "type")
BASE64 = ("base64", "data_base64", "file_base64", "content_base64")
LINKS = ("download_url", "url", "file_url", "href")
TEXTS = ("text", "content", "body", "markdown")
STRUCTURED = ("json", "data", "payload", "resource")


def _strings(item: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that holds a string with a visible character."""
    each = [F.when(kind(F.try_variant_get(item, f"$.{k}", "variant")) == "STRING", F.try_variant_get(item, f"$.{k}", "string")) for k in keys]
    return F.coalesce(*[F.when(F.trim(s) != "", s) for s in each])


def kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY and so on."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def record_items(payload: Column) -> Column:
    """array<variant>: the records of a response (JSON text): the response itself if it is a
    list; of an object the first list under one of LISTS, else under data, else the object
    alone. Null for what is neither, and for text that is no JSON."""
    v = F.try_parse_json(payload)
    paths = [f"$.{k}" for k in LISTS] + [f"$.data.{k}" for k in LISTS]
    lists = [F.try_variant_get(v, p, "array<variant>") for p in paths]
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(kind(v) == "OBJECT", F.coalesce(*lists, F.array(v)))


def _one(item: Column, index: Column) -> Column:
    """struct(name, form, text) of an item; see normalised."""
    what = kind(item)
    string, own = what == "STRING", F.try_variant_get(item, "$", "string")
    coded, link_of, text = _strings(item, BASE64), _strings(item, LINKS), _strings(item, TEXTS)
    bytes_ = F.try_to_binary(F.regexp_replace(coded, r"\s", ""), F.lit("base64"))
    parts = [F.try_variant_get(item, f"$.{k}", "variant") for k in STRUCTURED]
    some = [F.when((kind(p) != "VOID") & (F.to_json(p) != '""'), F.to_json(p)) for p in parts]
    nothing = F.lit(None).cast("string")
    cases = [
        (string & own.rlike(r"(?i)^\s*https?://"), "link", own), (string, "text", own), (what != "OBJECT", "invalid", nothing),
        (coded.isNotNull() & bytes_.isNull(), "invalid", nothing), (coded.isNotNull(), "base64", F.when(F.is_valid_utf8(bytes_.cast("string")), bytes_.cast("string"))),
        (link_of.isNotNull(), "link", link_of), (text.isNotNull(), "text", text),
    ]
    name = F.coalesce(F.when(~string, _strings(item, NAMES)), F.concat(F.lit("record_"), index.cast("string")))
    form, said = F.lit("json"), F.coalesce(*some, F.to_json(item))
    for rule, f, t in reversed(cases):
        form, said = F.when(rule, F.lit(f)).otherwise(form), F.when(rule, t).otherwise(said)
    content = F.when(form == "base64", bytes_)
    return F.struct(name.alias("name"), form.alias("form"), said.alias("text"), content.alias("content"), F.when(what == "OBJECT", _strings(item, TYPES)).alias("content_type"))


def normalised(items: DataFrame) -> DataFrame:
    """Adds name, form, text, content and content_type to items (item: variant, index: from 1). form
    is link (text is the address, to be fetched), text, base64 (content is what it decodes to, text
    the same if that is UTF-8), json (text is the structured part, or the item), or invalid: no
    string or object, or broken base64. content_type is what the item says of itself.

    A string is a link or a text; an object's base64 goes first, then its link, its text and
    its structured part."""
    # As a lambda's body the long rule is interpreted; compiled, it would not fit a method.
    one = F.element_at(F.transform(F.array(F.struct(F.col("item").alias("v"), F.col("index").alias("i"))), lambda x: _one(x["v"], x["i"])), 1)
    return items.withColumn("_one", one).select(*items.columns, "_one.*")


def record_set(payload: Column) -> Column:
    """struct(items, retrieved, expected, partial, error) of a response with records or documents,
    the number expected and a flag; partial also where fewer came than were expected. Null if
    the response is no list or object."""
    v = F.try_parse_json(payload)
    found = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("records", "documents")]
    full = [F.when(F.size(f) > 0, f) for f in found]
    items = F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.coalesce(*full, F.array().cast("array<variant>")))
    n = F.size(items).cast("long")
    wanted = F.coalesce(F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$.expected", "long")), n)
    flagged = F.coalesce(F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$.partial", "boolean")), F.lit(False))
    partial = flagged | (n < wanted)
    said = F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$.error", "string"))
    short = F.when(partial, F.concat(F.lit("Incomplete record set: retrieved "), n.cast("string"), F.lit(" of "), F.greatest(wanted, n).cast("string"), F.lit(" expected record(s).")))
    whole = F.struct(items.alias("items"), n.alias("retrieved"), F.greatest(wanted, n).alias("expected"), partial.alias("partial"), F.coalesce(F.nullif(said, F.lit("")), short).alias("error"))
    return F.when(kind(v).isin("ARRAY", "OBJECT"), whole)


def best_reading(readings: DataFrame, key: str) -> DataFrame:
    """key and text: of the readings (key, place, text) of one page the one that prints most
    dates, then the longest, then the first."""
    dates = r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b"
    score = F.struct(F.regexp_count(F.col("text"), F.lit(dates)).alias("dates"), F.length("text").alias("n"), (-F.col("place")).alias("first"))
    return readings.groupBy(key).agg(F.max_by("text", score).alias("text"))
