"""Joins, unions, set differences, admission and completeness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import linking, review, search, shaping, substrings
from quillspark.plans.registry import Registry
from quillspark.plans.reviews import KEY
from quillspark.sources import tables

query = Registry()
F_, C, V, P = tables.FACTS_SQL, tables.CLAIMS_SQL, tables.VERIFICATIONS_SQL, tables.PARAGRAPHS_SQL


@query(
    "join_03_page_ranges",
    """SELECT id, count(page) AS n, coalesce(count(page) = any_value(high) - any_value(low) + 1 AND count(DISTINCT page) = count(page) AND bool_and(page % 7 <> 0), false) AS whole
      FROM (SELECT o_orderkey AS id, 'cust_' || o_custkey AS file, o_orderkey % 50 + 1 AS low, o_orderkey % 50 + 1 + o_orderkey % 3 AS high FROM orders) r LEFT JOIN (SELECT document, page FROM facts) u ON u.document = r.file AND u.page BETWEEN low AND high GROUP BY id""",
    F_,
)
def join_03_page_ranges(spark, sf):
    f = tables.facts(spark, sf)
    ranges = f.select(F.col("seq").alias("id"), F.col("document").alias("file"), F.col("page").alias("low"), (F.col("page") + F.col("seq") % 3).alias("high"))
    return linking.in_ranges(ranges, f.select(F.col("document").alias("file"), "page", (F.col("page") % 7 != 0).alias("readable")))


@query(
    "join_06_restored_citations",
    """SELECT seq AS id, coalesce(e.arg, l.arg) AS source FROM facts f LEFT JOIN (SELECT date, description, arg_min(source, seq) AS arg FROM facts GROUP BY 1, 2) e USING (date, description)
      LEFT JOIN (SELECT description, arg_min(source, seq) AS arg FROM facts GROUP BY 1) l USING (description)""",
    F_,
)
@query(
    "join_06_all_restored_citations",
    """SELECT seq AS id, coalesce(e.arg, l.arg) AS source FROM facts f LEFT JOIN (SELECT date, description, arg_min(source, seq) AS arg FROM facts GROUP BY 1, 2) e USING (date, description)
      LEFT JOIN (SELECT description, arg_min(source, seq) AS arg FROM facts GROUP BY 1) l USING (description)""",
    F_,
)
def join_06_all_restored_citations(spark, sf):
    f = tables.facts(spark, sf)
    return linking.restored(f.select(F.col("seq").alias("id"), "date", "description"), f)


@query(
    "join_09_topics",
    """SELECT DISTINCT case_id, topic FROM (SELECT o_custkey AS case_id, unnest(CASE o_orderpriority WHEN '1-URGENT' THEN ['A', 'D'] WHEN '2-HIGH' THEN ['F'] ELSE ['A', 'G', 'K'] END) AS topic FROM orders
      UNION ALL SELECT o_custkey, unnest(['B', 'C', 'E', 'J']) FROM orders)""",
)
def join_09_topics(spark, sf):
    picked = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("condition"))
    known = spark.createDataFrame([("1-URGENT", ["A", "D"]), ("2-HIGH", ["F"]), ("3-MEDIUM", None)], "condition string, topics array<string>")
    return linking.preselected(picked, known)


@query(
    "join_12_shared_words",
    r"""SELECT left_id, right_id, shared, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY shared DESC, right_id) AS place FROM (
      SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM (SELECT DISTINCT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark) a
      JOIN (SELECT DISTINCT para_seq AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM paragraphs) b USING (w) GROUP BY 1, 2)) WHERE place <= 3""",
    P,
)
def join_12_shared_words(spark, sf):
    words = lambda df, key: df.select(F.col(key).alias("id"), search.tokens(F.col("text")).alias("words"))
    return linking.shared_words(words(tables.table(spark, sf, "benchmark"), "item_id"), words(tables.paragraphs(spark, sf), "para_seq"))


@query(
    "join_04_positive_sources",
    "SELECT DISTINCT f.source AS source FROM facts f JOIN (SELECT o_custkey, o_orderkey % 50 + 1 AS page FROM orders WHERE o_orderstatus = 'F') v ON f.document = 'cust_' || v.o_custkey AND f.page = v.page",
    F_,
)
def join_04_positive_sources(spark, sf):
    good = tables.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("CUST_"), "o_custkey", F.lit(" p."), F.col("o_orderkey") % 50 + 1).alias("reference"))
    cited = good.select(review.citation(F.col("reference")).alias("c")).select(F.lower("c.document").alias("document"), "c.page").distinct()
    return tables.facts(spark, sf).join(cited, ["document", "page"], "left_semi").select("source").distinct()


@query(
    "join_04_cited_sources",
    """SELECT source, bool_or(good) AS positive FROM (
      SELECT f.source, v.good FROM (SELECT DISTINCT source, document, page FROM facts) f JOIN refs v ON v.exact AND f.document = 'cust_' || v.o_custkey AND f.page = v.page
      UNION ALL SELECT f.source, v.good FROM (SELECT DISTINCT source FROM facts) f JOIN (SELECT reference, bool_or(good) AS good FROM refs GROUP BY 1) v ON contains(lower(v.reference), lower(f.source))) GROUP BY 1""",
    F_,
    """refs AS (SELECT o_custkey, o_orderkey % 50 + 1 AS page, o_orderstatus = 'F' AS good, o_orderkey % 3 = 0 AS exact,
      CASE o_orderkey % 3 WHEN 0 THEN 'CUST_' || o_custkey || ' p.' || (o_orderkey % 50 + 1) WHEN 1 THEN 'see Cust_' || o_custkey || ' p.' || (o_orderkey % 50 + 1) || ', 2020-01-01' ELSE 'order ' || o_orderkey END AS reference FROM orders WHERE o_orderkey % 4 <> 1)""",
)
def join_04_cited_sources(spark, sf):
    """Sources cited by address or inside a free reference, and whether a supportive verdict does."""
    k, at = F.col("o_orderkey") % 3, F.concat(F.col("o_custkey"), F.lit(" p."), F.col("o_orderkey") % 50 + 1)
    reference = F.when(k == 0, F.concat(F.lit("CUST_"), at)).when(k == 1, F.concat(F.lit("see Cust_"), at, F.lit(", 2020-01-01"))).otherwise(F.concat(F.lit("order "), "o_orderkey"))
    said = tables.table(spark, sf, "orders").where("o_orderkey % 4 <> 1").select(reference.alias("record_reference"), F.when(F.col("o_orderstatus") == "F", "SUPPORTED").otherwise("NOT FOUND").alias("verdict"))
    return substrings.cited_sources(tables.facts(spark, sf), said, ("SUPPORTED", "PARTIALLY SUPPORTED"))


@query("join_11_catalog_mismatches", "SELECT count(*) AS n FROM facts WHERE seq % 11 = 0 AND page > 3", F_)
def join_11_catalog_mismatches(spark, sf):
    f = tables.facts(spark, sf)
    rows = f.select("seq", F.when(F.col("seq") % 11 == 0, F.least("page", F.lit(3))).otherwise(F.col("page")).alias("claimed"))
    return rows.join(f.select("seq", "page"), "seq").where("claimed <> page").agg(F.count("*").alias("n"))


@query("join_07_chunk_dates", "SELECT case_id, array_to_string(list(date ORDER BY f)[1:12], ', ') AS dates FROM (SELECT case_id, date, min(seq) AS f FROM facts GROUP BY 1, 2) GROUP BY 1", F_)
def join_07_chunk_dates(spark, sf):
    d = tables.facts(spark, sf).groupBy("case_id", "date").agg(F.min("seq").alias("f"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("f", "date"))), 1, 12)
    return d.groupBy("case_id").agg(F.array_join(F.transform(first, lambda x: x["date"]), ", ").alias("dates"))


@query("flt_04_selected_facts", "SELECT seq FROM facts WHERE document IN (SELECT 'cust_' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", F_)
def flt_04_selected_facts(spark, sf):
    chosen = tables.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("cust_"), "c_custkey").alias("document"))
    return tables.facts(spark, sf).join(chosen, "document", "left_semi").select("seq")


@query("flt_05_grounded_citations", f"SELECT para_seq FROM paragraphs p LEFT JOIN documents d ON d.doc_id = p.doc_id - 1 WHERE d.text IS NULL OR {KEY.format('d.text')} = '' OR contains({KEY.format('d.text')}, {KEY.format('p.text')})", P)
@query("flt_05_whole_excerpts", f"SELECT para_seq FROM paragraphs p LEFT JOIN documents d ON d.doc_id = p.doc_id - 1 WHERE d.text IS NULL OR {KEY.format('d.text')} = '' OR contains({KEY.format('d.text')}, {KEY.format('p.text')})", P)
def flt_05_whole_excerpts(spark, sf):
    d = tables.table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("doc_id"), review.norm_key(F.col("text")).alias("page_text"))
    return tables.paragraphs(spark, sf).join(d, "doc_id", "left").where(F.col("page_text").isNull() | (F.col("page_text") == "") | F.contains("page_text", review.norm_key(F.col("text")))).select("para_seq")


@query("flt_09_reasons", "SELECT CASE WHEN n_chars > 10000 THEN 'too long' WHEN n_chars < 50 THEN 'too short' WHEN trim(text) = '' THEN 'blank' ELSE '' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def flt_09_reasons(spark, sf):
    rules = {"too long": F.col("n_chars") > 10000, "too short": F.col("n_chars") < 50, "blank": F.trim("text") == ""}
    return linking.reasons(tables.table(spark, sf, "documents"), rules).groupBy("reason").agg(F.count("*").alias("n"))


@query("flt_12_placeholders", "SELECT doc_id, regexp_matches(CASE WHEN doc_id % 5 = 0 THEN 'see [confirm date] ' ELSE '[Confirmed] ' END || text, '(?i)\\[confirm\\b') AS open FROM documents")
def flt_12_placeholders(spark, sf):
    t = F.concat(F.when(F.col("doc_id") % 5 == 0, "see [confirm date] ").otherwise("[Confirmed] "), "text")
    return tables.table(spark, sf, "documents").select("doc_id", t.rlike(r"(?i)\[confirm\b").alias("open"))


@query("flt_13_admission", "SELECT source, sum(n_chars) <= 120000 AS admitted FROM documents GROUP BY 1")
def flt_13_admission(spark, sf):
    return tables.table(spark, sf, "documents").groupBy("source").agg((F.sum("n_chars") <= 120000).alias("admitted"))


@query(
    "ded_04_renamed_sources",
    """SELECT id, CASE WHEN k > 1 THEN n || ' (' || k || ')' ELSE n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY id) AS k FROM (
      SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN s || '/' || name ELSE name END AS n FROM (SELECT lang || '_' || (doc_id % 40) AS name, text, min(doc_id) AS id, min(source) AS s FROM documents GROUP BY ALL)))""",
)
def ded_04_renamed_sources(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", F.lit("_"), F.col("doc_id") % 40).alias("name"), F.sha2("text", 256).alias("content"), "source")
    return linking.renamed_sources(d).select("id", "name")


@query(
    "ded_07_padded",
    """WITH own AS (SELECT o_custkey AS case_id, o_orderpriority AS title, min(o_orderkey) AS seq FROM orders GROUP BY ALL),
      al AS (SELECT case_id, title, 0 AS kind, seq FROM own UNION ALL SELECT case_id, t, 1, i FROM (SELECT DISTINCT case_id FROM own), (VALUES ('2-HIGH', 1), ('read it aloud', 2), ('add dates', 3)) v(t, i)),
      f AS (SELECT case_id, title, min({'k': kind, 's': seq}) AS o FROM al GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY o, title) AS place FROM f)
      SELECT case_id, title, CAST(place AS INTEGER) AS place FROM p WHERE (o.k = 0 AND place <= 5) OR (o.k = 1 AND place <= 3)""",
)
@query(
    "ded_07_all_padded",
    """WITH own AS (SELECT o_custkey AS case_id, o_orderpriority AS title, min(o_orderkey) AS seq FROM orders GROUP BY ALL),
      al AS (SELECT case_id, title, 0 AS kind, seq FROM own UNION ALL SELECT case_id, t, 1, i FROM (SELECT DISTINCT case_id FROM own), (VALUES ('2-HIGH', 1), ('read it aloud', 2), ('add dates', 3)) v(t, i)),
      f AS (SELECT case_id, title, min({'k': kind, 's': seq}) AS o FROM al GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY o, title) AS place FROM f)
      SELECT case_id, title, CAST(place AS INTEGER) AS place FROM p WHERE (o.k = 0 AND place <= 5) OR (o.k = 1 AND place <= 3)""",
)
def ded_07_all_padded(spark, sf):
    own = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("seq"))
    more = spark.createDataFrame([("2-HIGH", 1), ("read it aloud", 2), ("add dates", 3)], "title string, seq long")
    return linking.padded(own, more, "case_id")


@query(
    "ded_08_merged_states",
    "SELECT lang, CAST(sum(r) AS BIGINT) AS readable, count(*) AS parts, array_to_string(list_sort(list_distinct(flatten(list(c)))), ',') AS conditions, round_even(sum(r) / sum(t)::DOUBLE, 4) AS coverage FROM (SELECT lang, source, count(*) FILTER (n_chars > 200) AS r, count(*) AS t, [source, lang] AS c FROM documents GROUP BY 1, 2) GROUP BY 1",
)
def ded_08_merged_states(spark, sf):
    parts = tables.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count_if(F.col("n_chars") > 200).alias("readable"), F.count("*").alias("total"))
    parts = parts.withColumn("conditions", F.array("source", "lang")).withColumn("files", F.array("source"))
    return linking.merged_states(parts, "lang").select("lang", "readable", "parts", F.array_join("conditions", ",").alias("conditions"), "coverage")


@query(
    "ded_10_feature_difference",
    r"""SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))), ',') AS added, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), ',') AS missing
      FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(replace(text, 'a', 'e')), '[\p{L}\p{N}]+') AS b FROM benchmark)""",
)
def ded_10_feature_difference(spark, sf):
    b = tables.table(spark, sf, "benchmark").select("item_id", search.tokens(F.col("text")).alias("was"), search.tokens(F.replace("text", F.lit("a"), F.lit("e"))).alias("now"))
    return linking.feature_difference(b, "was", "now").select("item_id", F.array_join("added", ",").alias("added"), F.array_join("missing", ",").alias("missing"))


@query("agg_13_file_coverage", "SELECT source, count(*) AS total, round(least(1.0::DOUBLE, count(*) FILTER (n_chars >= 300) / count(*)), 6) AS ratio FROM documents GROUP BY 1")
def agg_13_file_coverage(spark, sf):
    return tables.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.round(F.least(F.lit(1.0), F.count_if(F.col("n_chars") >= 300) / F.count("*")), 6).alias("ratio"))


@query("agg_06_rubric_component", "SELECT o_custkey, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, avg(o_orderkey % 11) * 10)), 6) AS part FROM orders GROUP BY 1")
def agg_06_rubric_component(spark, sf):
    return tables.table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.avg(F.col("o_orderkey") % 11) * 10)), 6).alias("part"))


@query("agg_26_disposition", "SELECT l_orderkey, count(*) FILTER (CASE WHEN l_linenumber % 2 = l_suppkey % 2 THEN l_linenumber % 2 ELSE l_partkey % 2 END = 1) AS failures, CASE WHEN count(*) FILTER (CASE WHEN l_linenumber % 2 = l_suppkey % 2 THEN l_linenumber % 2 ELSE l_partkey % 2 END = 1) = 0 THEN 'REVIEW_READY' ELSE 'FAILED' END AS disposition FROM lineitem GROUP BY 1")
def agg_26_disposition(spark, sf):
    a, b = F.col("l_linenumber") % 2, F.col("l_suppkey") % 2
    bad = F.count_if(F.when(a == b, a).otherwise(F.col("l_partkey") % 2) == 1)
    return tables.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(bad.alias("failures"), F.when(bad == 0, "REVIEW_READY").otherwise("FAILED").alias("disposition"))


@query("agg_27_completed_answers", "SELECT user_id, count(*) FILTER (trim(a) NOT IN ('', 'none')) AS answered FROM (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN 'none' WHEN event_id % 4 = 1 THEN ' ' ELSE event_type END AS a FROM events) GROUP BY 1")
def agg_27_completed_answers(spark, sf):
    k = F.col("event_id") % 4
    a = F.when(k == 0, "none").when(k == 1, " ").otherwise(F.col("event_type"))
    return tables.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(~F.trim(a).isin("", "none")).alias("answered"))


@query("src_23_document_specs", "SELECT document, count(DISTINCT page) = max(page) AND count(*) = max(page) AS complete FROM facts GROUP BY 1", F_)
def src_23_document_specs(spark, sf):
    return tables.facts(spark, sf).groupBy("document").agg(((F.countDistinct("page") == F.max("page")) & (F.count("*") == F.max("page"))).alias("complete"))


@query("src_21_json_round_trip", "SELECT doc_id, sha256(text) AS sha, n_chars FROM documents")
def src_21_json_round_trip(spark, sf):
    d = tables.table(spark, sf, "documents")
    back = F.from_json(F.to_json(F.struct("doc_id", "text", "n_chars")), "doc_id long, text string, n_chars long", {"mode": "FAILFAST"})
    return d.select(back.alias("j")).select("j.doc_id", F.sha2("j.text", 256).alias("sha"), "j.n_chars")


@query("src_02_decoded", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 9 <> 0")
def src_02_decoded(spark, sf):
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 9 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    d = tables.table(spark, sf, "documents").select("doc_id", content.alias("c"))
    return d.where(F.is_valid_utf8(F.col("c").cast("string"))).select("doc_id", F.length(F.decode("c", "UTF-8")).cast("long").alias("n"))


@query("rnk_04_ranked_facts", None)
def rnk_04_ranked_facts(spark, sf):
    f = tables.facts(spark, sf).select(F.col("seq").alias("para_seq"), F.concat_ws(" ", "date", "description").alias("text"), "type", "case_id")
    q = spark.createDataFrame([(1, "status F near March 1997 orders")], "query_id long, query string")
    hit = shaping.ranked_evidence(f, q).select("para_seq", "overlap")
    floor = F.when(F.col("type").isin("in_service_event", "hospitalization"), F.lit(0.05)).otherwise(F.lit(0.0))
    # A row for most facts: never to be broadcast, however small its shuffle files are.
    scored = f.join(hit.hint("merge"), "para_seq", "left").withColumn("score", F.greatest(F.coalesce("overlap", F.lit(0.0)), floor))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "para_seq"))
    return scored.select("case_id", "para_seq", "score", place.alias("place"))


QUERIES, SQL = query.queries, query.sql
