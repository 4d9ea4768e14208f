"""Lists of bounded size (samples, catalogs, questions, advice, shortened JSON), combined parts, and
rules whose other queries have plain inputs, over real lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import reporting, selection, shaping
from quillspark.operators.review import ELEMENT_OF
from quillspark.plans.registry import Registry
from quillspark.sources import tables

query = Registry()
F_, P = tables.FACTS_SQL, tables.PARAGRAPHS_SQL


@query("rnk_06_sampled_timelines")
def rnk_06_sampled_timelines(spark, sf):
    """A case for each type of fact, so that cases are larger than their samples."""
    s = selection.sampled_timeline(tables.facts(spark, sf).withColumn("case_id", F.col("type")))
    return s.withColumn("selected", F.array_join(F.transform("selected", lambda k: k.cast("string")), ","))


@query("rnk_08_catalog")
def rnk_08_catalog(spark, sf):
    f, k = tables.facts(spark, sf), F.col("seq") % 7
    quote = F.when(k == 0, F.concat(F.lit("<<< "), "description")).otherwise(F.concat(F.lit('said "'), "description", F.lit('"')))
    return selection.catalog(f.select(F.col("type").alias("case_id"), F.col("seq").alias("place"), "date", "type", "description", quote.alias("quote"), "source", (k != 3).alias("verified")))


def _like(text: str) -> str:
    return "replace('" + text.replace("'", "''") + "', '%s', {})"


_ELEMENT = "CASE " + " ".join(f"WHEN type = '{k}' THEN '{e}'" for k, e in ELEMENT_OF.items()) + " ELSE 'other' END"
_GAPS = ", ".join(f"""CASE WHEN NOT list_contains(covered, '{e}') THEN {{'kind': 'evidence', 'text': {_like(q).format("if(main = '', 'the condition in this claim', main)")}, 'condition': main, 'support': NULL::BIGINT}} END""" for e, q in selection.GAP_QUESTIONS.items())


@query(
    "rnk_09_questions",
    f"""SELECT case_id, CAST(pos AS INTEGER) AS place, q.kind AS kind, q.text AS text, q.condition AS condition, q.support AS support FROM (
      SELECT case_id, unnest(qs) AS q, generate_subscripts(qs, 1) AS pos FROM (SELECT case_id, list_concat(list_concat(
        list_transform(coalesce(best, []), lambda b: {{'kind': 'condition', 'text': {_like(selection.CONDITION_QUESTION).format('b.condition')}, 'condition': b.condition, 'support': b.support}}),
        list_slice(list_filter([{_GAPS}], lambda x: x IS NOT NULL), 1, 4)),
        CASE WHEN providers > 1 THEN [{{'kind': 'opinion', 'text': {_like(selection.OPINION_QUESTION).format("if(main = '', 'the claimed condition', main)")}, 'condition': '', 'support': NULL::BIGINT}}] ELSE [] END) AS qs
      FROM (SELECT *, coalesce(best[1].condition, '') AS main FROM covers LEFT JOIN bests USING (case_id))))""",
    F_,
    """conditions AS (SELECT case_id, seq, CASE seq % 4 WHEN 0 THEN ' Status ' || description[8:8] || ' near ' WHEN 1 THEN 'near hospital status' WHEN 2 THEN 'F' ELSE 'STATUS: ' || page END AS condition FROM facts WHERE case_id % 5 <> 0)""",
    f"covers AS (SELECT case_id, list(DISTINCT {_ELEMENT}) AS covered, count(DISTINCT page % 3) AS providers FROM facts GROUP BY 1)",
    r"""bests AS (SELECT case_id, list({'condition': condition, 'support': support} ORDER BY pos) AS best FROM (SELECT case_id, condition, support, row_number() OVER (PARTITION BY case_id ORDER BY support DESC, seq, phrase) AS pos FROM (
      SELECT c.case_id, c.condition, c.phrase, c.seq, (SELECT count(*) FROM facts f WHERE f.case_id = c.case_id AND (contains(lower(f.description), c.phrase) OR (len(ws) > 0 AND len(list_filter(ws, lambda w: NOT list_contains(string_split(lower(f.description), ' '), w))) = 0))) AS support
      FROM (SELECT *, list_filter(string_split(phrase, ' '), lambda w: length(w) > 3) AS ws FROM (SELECT *, row_number() OVER (PARTITION BY case_id, replace(phrase, ' ', '') ORDER BY seq) AS k FROM (
        SELECT case_id, seq, trim(condition) AS condition, array_to_string(regexp_extract_all(lower(condition), '[a-z0-9]+'), ' ') AS phrase FROM conditions)) WHERE k = 1 AND length(condition) >= 3) c)) WHERE pos <= 6 GROUP BY 1)""",
)
def rnk_09_questions(spark, sf):
    f, k = tables.facts(spark, sf), F.col("seq") % 4
    name = F.when(k == 0, F.concat(F.lit(" Status "), F.substring("description", 8, 1), F.lit(" near "))).when(k == 1, "near hospital status").when(k == 2, "F").otherwise(F.concat(F.lit("STATUS: "), "page"))
    conditions = f.where("case_id % 5 <> 0").select("case_id", "seq", name.alias("condition"))
    return selection.questions(f.withColumn("quote", F.lit(None).cast("string")), conditions, f.select("case_id", (F.col("page") % 3).alias("provider")))


def _rows_sql(rows):
    return "[" + ", ".join("{{'title': '{}', 'impact': '{}', 'explanation': '{}'}}".format(*(x.replace("'", "''") for x in r)) for r in rows) + "]"


_C, _G, _P = selection.CONTRADICTED, selection.GAP, selection.PROBLEM


@query(
    "rnk_11_advice",
    f"""SELECT c_custkey, CAST(pos AS INTEGER) AS place, a.title AS title, a.impact AS impact, a.explanation AS explanation FROM (SELECT c_custkey, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM (
      SELECT c_custkey, list_slice(list_concat(own, list_slice({_rows_sql(selection.FILLERS)}, 1, greatest(0, 3 - len(own)))), 1, 5) AS l FROM (
        SELECT c_custkey, list_concat(list_concat(list_concat(if(claims = 0, {_rows_sql(selection.NO_CLAIMS)}, []),
          if(against > 0, [{{'title': '{_C[0]}', 'impact': '{_C[1]}', 'explanation': replace('{_C[2]}', '%s', CAST(against AS VARCHAR))}}], [])),
          if(c_custkey % 3 = 0, [], list_transform(gaps, lambda g: {{'title': left(replace('{_G[0]}', '%s', g), 160), 'impact': '{_G[1]}', 'explanation': '{_G[2]}'}}))),
          if(c_custkey % 4 = 0, [{{'title': left(c_comment_, 160), 'impact': '{_P[1]}', 'explanation': '{_P[2]}'}}, {{'title': '{_P[0]}', 'impact': '{_P[1]}', 'explanation': 'Do it'}}], [])) AS own
        FROM (SELECT c_custkey, repeat(c_name, 10) AS c_comment_, count(o_orderkey) AS claims, count(*) FILTER (o_orderstatus = 'P') AS against, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'P')), []) AS gaps
          FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2))))""",
)
def rnk_11_advice(spark, sf):
    mixed = F.col("o_orderstatus") == "P"
    o = tables.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("claims"), F.count_if(mixed).alias("against"), F.array_sort(F.collect_set(F.when(mixed, F.col("o_orderpriority")))).alias("gaps"))
    c = tables.table(spark, sf, "customer").join(o, "c_custkey", "left")
    problem = lambda p, s: F.struct(p.alias("problem"), F.lit(s).alias("suggestion"))
    problems = F.when(F.col("c_custkey") % 4 == 0, F.array(problem(F.repeat("c_name", F.lit(10)), ""), problem(F.lit(None).cast("string"), "Do it")))
    rows = selection.advice(F.col("claims"), F.col("against"), F.when(F.col("c_custkey") % 3 != 0, F.col("gaps")), problems)
    return c.select("c_custkey", F.posexplode(rows).alias("at", "a")).select("c_custkey", (F.col("at") + 1).alias("place"), "a.title", "a.impact", "a.explanation")


@query("rnk_10_fitted_json")
def rnk_10_fitted_json(spark, sf):
    data = F.to_json(F.struct("doc_id", F.split("text", "\n").alias("lines")))
    return tables.table(spark, sf, "documents").select("doc_id", selection.fitted_json(data).alias("data"))


@query(
    "ded_09_combined",
    r"""SELECT case_id, facts, types, CAST(pages AS BIGINT) AS pages, CAST(n - facts AS BIGINT) AS repeated FROM (
      SELECT case_id, count(*) AS facts, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM (SELECT *, row_number() OVER (PARTITION BY case_id, trim(lower(date)), trim(lower(description)) ORDER BY seq) AS k FROM parts) WHERE k = 1 GROUP BY 1)
      JOIN (SELECT case_id, sum(pages) AS pages, sum(n) AS n FROM (SELECT case_id, part, max(page) AS pages, count(*) AS n FROM parts GROUP BY 1, 2) GROUP BY 1) USING (case_id)""",
    F_,
    "parts AS (SELECT seq % 3 AS part, * FROM facts UNION ALL SELECT 3, * REPLACE (-seq - 1 AS seq, ' ' || upper(description) AS description) FROM facts WHERE seq % 4 <> 1)",
)
def ded_09_combined(spark, sf):
    f = tables.facts(spark, sf).withColumn("pages", F.col("page"))
    again = f.where("seq % 4 <> 1").withColumn("seq", -F.col("seq") - 1).withColumn("description", F.concat(F.lit(" "), F.upper("description")))
    return selection.combined(f.withColumn("part", F.col("seq") % 3).unionByName(again.withColumn("part", F.lit(3).cast("long"))))


@query(
    "txt_03_planted_spans",
    """SELECT doc_id, page FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY page), 0) AS before FROM (
      SELECT doc_id, ord AS page, length(text) AS n, sum(length(text)) OVER w - length(text) + if(para_seq % 11 = 0, 1, 0) AS s, sum(length(text)) OVER w + if(para_seq % 13 = 0, 2, 0) AS e FROM paragraphs WINDOW w AS (PARTITION BY doc_id ORDER BY ord)))
      WHERE s <> before OR e <= s OR e - s <> n""",
    P,
)
def txt_03_planted_spans(spark, sf):
    """Paragraphs as spans of their document, some of them moved by one or too long by two."""
    end = F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("ord"))
    moved, longer = (F.when(F.col("para_seq") % k == 0, n).otherwise(0) for k, n in ((11, 1), (13, 2)))
    spans = tables.paragraphs(spark, sf).select("doc_id", F.col("ord").alias("page"), "text", (end - F.length("text") + moved).alias("start"), (end + longer).alias("end"))
    return shaping.broken_spans(spans, "doc_id").select("doc_id", "page")


@query("flt_08_visible_rests", r"SELECT para_seq, regexp_matches(regexp_replace(text, '[\p{L}\p{N}.,;:-]', '', 'g') || CASE para_seq % 4 WHEN 0 THEN chr(8203) || chr(160) WHEN 1 THEN chr(173) ELSE '' END, '[^\s\p{Cc}\p{Cf}\p{Z}]') AS visible FROM paragraphs", P)
def flt_08_visible_rests(spark, sf):
    """What letters, digits and points leave of each paragraph, with invisible characters behind."""
    k = F.col("para_seq") % 4
    rest = F.concat(F.regexp_replace("text", r"[\p{L}\p{N}.,;:-]", ""), F.when(k == 0, "\u200b\u00a0").when(k == 1, "\u00ad").otherwise(""))
    return tables.paragraphs(spark, sf).select("para_seq", reporting.visible(rest).alias("visible"))


_DATES = rf"(?i)\b(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}-\d{{1,2}}|(?:{dates.MONTH})\.?\s+\d{{1,2}},?\s+\d{{4}}|(?:{dates.MONTH})\.?\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{4}})\b"


@query(
    "dat_04_dates_of_lines",
    rf"""SELECT seq, coalesce(raws[1], '') AS first, CAST(least(6, len(list_distinct(raws))) AS INTEGER) AS n FROM (SELECT seq, regexp_extract_all(
      date || ' and ' || text || ' near ' || date || CASE seq % 4 WHEN 0 THEN ' 1/2/99, 3/4/2001; 1987 or June 1990, July 4, 1991 then 2001-02' WHEN 1 THEN ' in ' || seq ELSE '' END, '{_DATES}') AS raws
      FROM facts JOIN (SELECT o_orderkey AS seq, o_orderstatus || ' ' || CAST(o_custkey + 1900 AS VARCHAR) AS text FROM orders) USING (seq))""",
    F_,
)
def dat_04_dates_of_lines(spark, sf):
    k = F.col("seq") % 4
    more = F.when(k == 0, " 1/2/99, 3/4/2001; 1987 or June 1990, July 4, 1991 then 2001-02").when(k == 1, F.concat(F.lit(" in "), "seq")).otherwise("")
    text = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat("o_orderstatus", F.lit(" "), F.col("o_custkey") + 1900).alias("text"))
    line = F.concat("date", F.lit(" and "), "text", F.lit(" near "), "date", more)
    found = tables.facts(spark, sf).join(text, "seq").select("seq", reporting.printed_dates(line).alias("d"))
    return found.select("seq", F.coalesce(F.get("d", F.lit(0))["raw"], F.lit("")).alias("first"), F.size("d").alias("n"))


@query(
    "src_24_sections_of_lines",
    """SELECT doc_id, section, letter, title, sha256(body) AS sha FROM (
      SELECT doc_id, section, max(letter) AS letter, max(title) AS title, trim(coalesce(string_agg(body, chr(10) ORDER BY i) || if(max(i) < any_value(n), chr(10), ''), '')) AS body FROM (
        SELECT doc_id, i, n, CAST((i - 1) // 4 AS INTEGER) AS section, if(i % 4 = 1, chr(CAST(65 + i % 26 AS INTEGER)), NULL) AS letter, if(i % 4 = 1, trim(line), NULL) AS title, if(i % 4 = 1, NULL, line) AS body FROM (
          SELECT doc_id, len(string_split(text, chr(10))) AS n, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1, 2)""",
)
def src_24_sections_of_lines(spark, sf):
    """Every fourth line of a document as the heading of a section."""
    def line(x, i):
        return F.when(i % 4 == 0, F.concat(F.lit("## "), F.chr(F.lit(65) + (i + 1) % 26), F.lit(". "), x)).otherwise(x)

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    s = tables.table(spark, sf, "documents").select("doc_id", F.posexplode(reporting.sections(text)).alias("section", "s"))
    return s.select("doc_id", "section", "s.letter", "s.title", F.sha2("s.body", 256).alias("sha"))


QUERIES, SQL = query.queries, query.sql
