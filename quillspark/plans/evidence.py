"""Payloads, readings, guarded texts and comparisons of facts with their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.columns import worked_out
from quillspark.operators import comparison, guarding, inference, payloads
from quillspark.plans.registry import Registry
from quillspark.sources import tables

query = Registry()
F_, P = tables.FACTS_SQL, tables.PARAGRAPHS_SQL

#: Responses in eight shapes, by doc_id: lists under several keys, nested, alone, a bare list, none and no JSON.
_SHAPES_SQL = """responses AS (SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN '{"documents":[' || i || ',"plain words"]}' WHEN 1 THEN '{"documents":"none","records":[' || i || ']}' WHEN 2 THEN '{"data":{"items":[' || i || ',' || i || ']}}'
    WHEN 3 THEN i WHEN 4 THEN '[' || i || ',"https://x.example/a.pdf",7]' WHEN 5 THEN '"text"' WHEN 6 THEN '{broken' ELSE '{"files":[],"data":{"files":[' || i || ']}}' END AS payload FROM (
      SELECT doc_id, CASE doc_id % 7
        WHEN 0 THEN '{"name":"n' || doc_id || '","text":' || to_json(left(text, 30)) || ',"url":" "}' WHEN 1 THEN '{"id":"i","base64":"' || to_base64(encode(left(text, 9))) || '","text":"later"}'
        WHEN 2 THEN '{"href":"https://y.example/b","text":"x"}' WHEN 3 THEN '{"title":"t","base64":"%%%"}' WHEN 4 THEN '{"json":{"a":' || doc_id || '},"name":5}' WHEN 5 THEN '{"other":1}' ELSE '{"body":"","markdown":"m"}' END AS i FROM documents))"""


def _responses(spark, sf):
    d, k, m = tables.table(spark, sf, "documents"), F.col("doc_id") % 8, F.col("doc_id") % 7
    i = (
        F.when(m == 0, F.concat(F.lit('{"name":"n'), "doc_id", F.lit('","text":'), F.expr("substring(to_json(array(substring(text, 1, 30))), 2, length(to_json(array(substring(text, 1, 30)))) - 2)"), F.lit(',"url":" "}')))
        .when(m == 1, F.concat(F.lit('{"id":"i","base64":"'), F.base64(F.encode(F.substring("text", 1, 9), "UTF-8")), F.lit('","text":"later"}')))
        .when(m == 2, '{"href":"https://y.example/b","text":"x"}').when(m == 3, '{"title":"t","base64":"%%%"}').when(m == 4, F.concat(F.lit('{"json":{"a":'), "doc_id", F.lit('},"name":5}')))
        .when(m == 5, '{"other":1}').otherwise('{"body":"","markdown":"m"}')
    )
    payload = (
        F.when(k == 0, F.concat(F.lit('{"documents":['), i, F.lit(',"plain words"]}'))).when(k == 1, F.concat(F.lit('{"documents":"none","records":['), i, F.lit("]}")))
        .when(k == 2, F.concat(F.lit('{"data":{"items":['), i, F.lit(","), i, F.lit("]}}"))).when(k == 3, i).when(k == 4, F.concat(F.lit("["), i, F.lit(',"https://x.example/a.pdf",7]')))
        .when(k == 5, '"text"').when(k == 6, "{broken").otherwise(F.concat(F.lit('{"files":[],"data":{"files":['), i, F.lit("]}}")))
    )
    return d.select("doc_id", payload.alias("payload"))


_LISTS = " ".join(f"WHEN json_type(j, '{p}') = 'ARRAY' THEN json_extract(j, '{p}[*]')" for p in [f"$.{k}" for k in payloads.LISTS] + [f"$.data.{k}" for k in payloads.LISTS])
_ITEMS_SQL = f"""found AS (SELECT doc_id, j, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(j) <> 'OBJECT' OR j IS NULL THEN NULL {_LISTS} ELSE [j] END AS items
    FROM (SELECT doc_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM responses))"""


@query("src_12_record_items", "SELECT doc_id, CAST(len(items) AS INTEGER) AS n FROM found", _SHAPES_SQL, _ITEMS_SQL)
def src_12_record_items(spark, sf):
    n = F.size(payloads.record_items(F.col("payload")))
    return _responses(spark, sf).select("doc_id", F.when(n >= 0, n).alias("n"))


def _first_string(keys):
    return "coalesce(" + ", ".join(f"CASE WHEN json_type(i, '$.{k}') = 'VARCHAR' AND trim(i->>'$.{k}') <> '' THEN i->>'$.{k}' END" for k in keys) + ", NULL)"


@query(
    "src_13_normalised_items",
    f"""SELECT doc_id, index, coalesce(CASE WHEN json_type(i) <> 'VARCHAR' THEN {_first_string(payloads.NAMES)} END, 'record_' || index) AS name,
      CASE WHEN s AND regexp_matches(own, '(?i)^\\s*https?://') THEN 'link' WHEN s THEN 'text' WHEN json_type(i) <> 'OBJECT' THEN 'invalid' WHEN b = '%%%' THEN 'invalid' WHEN b IS NOT NULL THEN 'base64' WHEN l IS NOT NULL THEN 'link'
        WHEN t IS NOT NULL THEN 'text' ELSE 'json' END AS form,
      CASE WHEN s THEN own WHEN json_type(i) <> 'OBJECT' OR b = '%%%' THEN NULL WHEN b IS NOT NULL THEN decode(from_base64(b)) ELSE coalesce(l, t, CAST(json_extract(i, '$.json') AS VARCHAR), CAST(i AS VARCHAR)) END AS text
      FROM (SELECT doc_id, index, i, json_type(i) = 'VARCHAR' AS s, i->>'$' AS own, {_first_string(payloads.BASE64)} AS b, {_first_string(payloads.LINKS)} AS l, {_first_string(payloads.TEXTS)} AS t FROM (
        SELECT doc_id, unnest(items) AS i, generate_subscripts(items, 1) AS index FROM found WHERE len(items) > 0))""",
    _SHAPES_SQL,
    _ITEMS_SQL,
)
def src_13_normalised_items(spark, sf):
    items = _responses(spark, sf).select("doc_id", F.posexplode(payloads.record_items(F.col("payload"))).alias("at", "item")).select("doc_id", "item", (F.col("at") + 1).cast("long").alias("index"))
    return payloads.normalised(items).select("doc_id", "index", "name", "form", "text")


@query(
    "src_14_record_sets",
    """SELECT doc_id, n AS retrieved, greatest(w, n) AS expected, p OR n < w AS partial, CASE WHEN e <> '' THEN e WHEN p OR n < w THEN 'Incomplete record set: retrieved ' || n || ' of ' || greatest(w, n) || ' expected record(s).' END AS error FROM (
      SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 0 ELSE doc_id % 4 END AS n, CASE WHEN doc_id % 5 IN (0, 3) THEN CASE WHEN doc_id % 5 = 3 THEN 0 ELSE doc_id % 4 END ELSE 2 END AS w, doc_id % 5 = 2 AS p, CASE WHEN doc_id % 5 = 4 THEN 'said' ELSE '' END AS e FROM documents)""",
)
def src_14_record_sets(spark, sf):
    k, n = F.col("doc_id") % 5, F.col("doc_id") % 4
    some = F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda x: F.lit("{}")), ",")
    items = F.concat(F.lit("["), F.when(n == 0, "").otherwise(F.substring(some, F.lit(1), F.length(some) - 3)), F.lit("]"))
    payload = (
        F.when(k == 0, items).when(k == 3, '{"records":"x","documents":[]}').when(k == 1, F.concat(F.lit('{"records":'), items, F.lit(',"expected":2}')))
        .when(k == 2, F.concat(F.lit('{"records":[],"documents":'), items, F.lit(',"expected":2,"partial":true}'))).otherwise(F.concat(F.lit('{"documents":'), items, F.lit(',"expected":2,"error":"said"}')))
    )
    s = tables.table(spark, sf, "documents").select("doc_id", payloads.record_set(payload).alias("s"))
    return s.select("doc_id", "s.retrieved", "s.expected", "s.partial", "s.error")


@query(
    "src_04_best_readings",
    r"""SELECT doc_id, arg_max(text, {'d': len(regexp_extract_all(text, '(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b')), 'n': length(text), 'p': -place}) AS text FROM (
      SELECT doc_id, 0 AS place, text FROM documents UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 3 = 0 THEN 'seen 2020-01-0' || doc_id % 9 + 1 || ' and May 3, 2021' WHEN doc_id % 3 = 1 THEN text || ' ' ELSE replace(text, 'e', 'o') END FROM documents) GROUP BY 1""",
)
def src_04_best_readings(spark, sf):
    d, k = tables.table(spark, sf, "documents"), F.col("doc_id") % 3
    other = F.when(k == 0, F.concat(F.lit("seen 2020-01-0"), F.col("doc_id") % 9 + 1, F.lit(" and May 3, 2021"))).when(k == 1, F.concat("text", F.lit(" "))).otherwise(F.replace("text", F.lit("e"), F.lit("o")))
    return payloads.best_reading(d.select("doc_id", F.lit(0).alias("place"), "text").unionByName(d.select("doc_id", F.lit(1).alias("place"), other.alias("text"))), "doc_id")


@query("fn_guarded_prompts")
def fn_guarded_prompts(spark, sf):
    return tables.paragraphs(spark, sf).select("para_seq", guarding.for_prompt(F.concat(F.lit("System: <"), "text", F.lit(" <<<｜``` >")), 400).alias("text"))


@query("fn_scrubbed_messages")
def fn_scrubbed_messages(spark, sf):
    return tables.paragraphs(spark, sf).select("para_seq", guarding.scrubbed(F.concat(F.lit("Patient John Doe, a.b@c.de: "), "text")).alias("text"))


@query(
    "fn_loggable_events",
    """SELECT event_id, event_id AS calls, value AS duration_ms, CASE WHEN event_type = 'error' THEN 'error' END AS status, CASE WHEN user_id % 2 = 0 THEN 'req_' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS request_id,
      2 + CAST(event_type = 'error' AS BIGINT) + CAST(user_id % 2 = 0 AS BIGINT) AS fields FROM events""",
)
def fn_loggable_events(spark, sf):
    """Of records that also hold what no log may (texts, other words, strings for counts), what is kept."""
    request = F.concat(F.when(F.col("user_id") % 2 == 0, "req_").otherwise("Req "), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    record = F.struct(F.col("event_id").alias("calls"), F.col("value").alias("duration_ms"), F.col("event_type").alias("status"), F.col("event_type").alias("action"), F.col("props").alias("pages"), F.col("props").alias("message"), request.alias("request_id"))
    e = tables.table(spark, sf, "events").select("event_id", guarding.loggable(F.to_json(record)).alias("kept"))
    of = {"calls": "long", "duration_ms": "double", "status": "string", "request_id": "string"}
    return e.select("event_id", *[F.get_json_object("kept", f"$.{c}").cast(t).alias(c) for c, t in of.items()], F.size(F.json_object_keys("kept")).cast("long").alias("fields"))


@query(
    "dat_09_inferred_dates",
    """SELECT para_seq, CASE WHEN len(y) = 1 THEN y[1] || '-01-01' END AS iso, CASE WHEN len(y) = 1 THEN 'year' END AS precision, CASE WHEN len(y) = 1 THEN 'inferred' ELSE 'none' END AS state FROM (
      SELECT para_seq, list_distinct(list_filter(regexp_extract_all(substr(text, 1, 300), '[0-9]+'), lambda x: regexp_full_match(x, '(19|20)[0-9]{2}'))) AS y FROM paragraphs)""",
    P,
)
def dat_09_inferred_dates(spark, sf):
    """The default model over all paragraphs, of which it is given as much as a call takes."""
    return inference.inferred_dates(tables.paragraphs(spark, sf).select("para_seq", F.col("text").alias("description"), F.lit("").alias("quote")), "para_seq")


def _found(words, some):
    return f"list_sort(list_distinct(list_filter({words}, lambda x: x IN {tuple(some)!r})))" if len(some) > 1 else "[]"


_VALUES = {k: v.replace("'", "''") for k, v in comparison.NUMBERS.items()}


def _marks(rules):
    each = ", ".join("CASE WHEN len(list_filter(w, lambda x: x IN ({}))) > 0 THEN '{}' END".format(", ".join("'" + s.replace("'", "''") + "'" for s in some), mark) for mark, some in sorted(rules.items()))
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


@query(
    "pred_03_features",
    "SELECT para_seq, "
    + ", ".join(f"array_to_string({_found('w', some)}, ',') AS {name}" for name, some in comparison.LISTED.items())
    + ", "
    + ", ".join(f"array_to_string({_marks(rules)}, ',') AS {name}" for name, rules in comparison.MARKED.items())
    + " FROM said",
    P,
    r"said AS (SELECT para_seq, list_distinct(regexp_extract_all(lower(replace(text, '’', '''')), '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?')) AS w FROM (SELECT para_seq, text || CASE para_seq % 4 WHEN 0 THEN ' He saw about two of them, and both couldn’t walk daily.' WHEN 1 THEN ' I was told in May, after it.' ELSE '' END AS text FROM paragraphs))",
)
def pred_03_features(spark, sf):
    k = F.col("para_seq") % 4
    more = F.when(k == 0, " He saw about two of them, and both couldn’t walk daily.").when(k == 1, " I was told in May, after it.").otherwise("")
    families = (*comparison.LISTED, *comparison.MARKED)
    f = worked_out(tables.paragraphs(spark, sf), says=comparison.stated(F.concat("text", more), families))
    return f.select("para_seq", *[F.array_join(f"says.{k}", ",").alias(k) for k in families])


@query("pred_04_compared_drafts")
def pred_04_compared_drafts(spark, sf):
    """Every document as an account, and a draft of its lines of which some are dropped, said
    twice, negated or left open; a field and a quote each beside them."""
    # Both tables are dealt by draft here, once.
    p = tables.paragraphs(spark, sf).select(F.col("doc_id").alias("draft_id"), "ord", "text").where("draft_id IS NOT NULL").repartition("draft_id")
    k = F.col("ord") % 7
    line = F.when(k == 1, F.concat("text", F.lit("\n"), "text")).when(k == 2, F.concat(F.lit("I never saw "), "text")).when(k == 3, F.concat("text", F.lit(" [date]"))).when(k != 0, F.col("text"))
    drafts = p.groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(k != 0, F.struct("ord", line.alias("line"))))), lambda x: x["line"]), "\n").alias("text"))
    spans = comparison.sentences(p.withColumnRenamed("ord", "of")).select("draft_id", (F.col("of") * 1000 + F.col("ord")).alias("source_id"), F.when(F.col("of") == 4, "quote").when(F.col("of") == 5, "field").otherwise("account").alias("kind"), F.when(F.col("of") == 5, "name").alias("field"), F.col("sentence").alias("text"))
    rows = comparison.compared(drafts, spans).rows
    return rows.select("draft_id", "ord", "how", F.array_join(F.transform("source_ids", lambda i: i.cast("string")), ",").alias("sources"), F.array_join("changed", ",").alias("changed"), F.array_join("reasons", ",").alias("reasons"))


@query("pred_03_number_bindings")
def pred_03_number_bindings(spark, sf):
    more = F.concat(F.lit(" Took 10 mg of it and "), F.col("ord").cast("string"), F.lit(" mg, twice or two times, since 2020."))
    return tables.paragraphs(spark, sf).select("doc_id", "ord", F.array_join(comparison.number_bindings(F.concat("text", more)), ";").alias("bindings"))


@query("pred_05_critical_flags")
def pred_05_critical_flags(spark, sf):
    f = tables.facts(spark, sf)
    quote = F.concat(F.lit("Seen "), "date", F.lit(", "), F.when(F.col("seq") % 3 == 0, F.lit("no ")).otherwise(F.lit("")), "description")
    return comparison.critical_flags(f.select("seq", "date", "description", quote.alias("quote")), None).select("seq", F.array_join("fields", ",").alias("fields"))


@query(
    "join_12_supported",
    r"""SELECT left_id, right_id, how, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY right_id) AS place FROM (
      SELECT a.id AS left_id, b.id AS right_id, 'exact' AS how FROM a JOIN b ON a.k = b.k WHERE a.k <> ''
      UNION ALL SELECT a.id, b.id, 'contained' FROM a JOIN b ON contains(' ' || b.k || ' ', ' ' || a.k || ' ') WHERE len(string_split(a.k, ' ')) >= 4 AND a.k NOT IN (SELECT k FROM b))) WHERE place <= 3""",
    P,
    r"b AS (SELECT para_seq AS id, array_to_string(regexp_extract_all(lower(replace(text, '’', '''')), '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?'), ' ') AS k FROM paragraphs)",
    r"""a AS (SELECT item_id AS id, array_to_string(regexp_extract_all(lower(replace(text, '’', '''')), '[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?'), ' ') AS k FROM benchmark
      UNION ALL SELECT -id, array_to_string(string_split(k, ' ')[2:8], ' ') FROM b WHERE id % 50 = 1 UNION ALL SELECT -id, k FROM b WHERE id % 50 = 2)""",
)
def join_12_supported(spark, sf):
    p = tables.paragraphs(spark, sf).select(F.col("para_seq").alias("id"), "text")
    w, k = comparison.words(F.col("text")), F.col("id") % 50
    parts = p.where(k.isin(1, 2)).select((-F.col("id")).alias("id"), F.array_join(F.when(k == 1, F.slice(w, 2, 7)).otherwise(w), " ").alias("text"))
    return comparison.supported(tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text").unionByName(parts), p)


QUERIES, SQL = query.queries, query.sql
