"""The given tables as the entities that operators work on.

Every entity has an explicit seq (or an equivalent key), as ties go by input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stripped(text: Column | str) -> Column:
    """Without white space (ASCII) at both ends."""
    return F.regexp_replace(text, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, para_seq, label and text: the non-blank lines of documents. para_seq is a number of
    its own for each line: a text has fewer than 2**31 of them, and doc_id is below 2**32."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    ord_ = F.col("at") + 1
    return (
        lines.select("doc_id", ord_.cast("long").alias("ord"), stripped("line").alias("text"))
        .where("text <> ''")
        .select("doc_id", "ord", (F.shiftleft("doc_id", 31) + F.col("ord")).alias("para_seq"), F.concat(F.lit("doc_"), "doc_id", F.lit(" p."), "ord").alias("label"), "text")
    )


PARAGRAPHS_SQL = r"""paragraphs AS (
  SELECT doc_id, ord, doc_id * 2147483648 + ord AS para_seq, 'doc_' || doc_id || ' p.' || ord AS label, text FROM (
    SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS ord,
      regexp_replace(unnest(string_split(text, chr(10))), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS text FROM documents) WHERE text <> '')"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, case_id, date (as printed, in eight spellings), type, description, source, document, page and day of orders."""
    o, day = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 8
    spelt = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(day, "yyyy-MM"))
        .when(k == 2, F.date_format(day, "MMMM d, yyyy"))
        .when(k == 3, F.date_format(day, "M/d/yyyy"))
        .when(k == 4, F.concat(F.lit("circa "), F.date_format(day, "yyyy")))
        .when(k == 5, F.date_format(day, "MMMM yyyy"))
        .when(k == 6, F.lit("unknown"))
        .otherwise(F.concat(F.lit("around "), F.date_format(day, "yyyy-MM-dd")))
    )
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "hospitalization").when(p == "2-HIGH", "diagnosis").when(p == "3-MEDIUM", "medication").when(p == "4-NOT SPECIFIED", "symptom").otherwise("other")
    page = F.col("o_orderkey") % 50 + 1
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("case_id"),
        spelt.alias("date"),
        kind.alias("type"),
        F.concat(F.lit("status "), "o_orderstatus", F.lit(" near "), F.floor(F.col("o_totalprice") / 10000).cast("string")).alias("description"),
        F.concat(F.lit("cust_"), F.col("o_custkey"), F.lit(" p."), page).alias("source"),
        F.concat(F.lit("cust_"), F.col("o_custkey")).alias("document"),
        page.alias("page"),
    )


FACTS_SQL = """facts AS (
  SELECT o_orderkey AS seq, o_custkey AS case_id,
    CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y')
      WHEN 3 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 4 THEN 'circa ' || strftime(o_orderdate, '%Y') WHEN 5 THEN strftime(o_orderdate, '%B %Y')
      WHEN 6 THEN 'unknown' ELSE 'around ' || strftime(o_orderdate, '%Y-%m-%d') END AS date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'hospitalization' WHEN '2-HIGH' THEN 'diagnosis' WHEN '3-MEDIUM' THEN 'medication' WHEN '4-NOT SPECIFIED' THEN 'symptom' ELSE 'other' END AS type,
    'status ' || o_orderstatus || ' near ' || CAST(floor(o_totalprice / 10000) AS BIGINT) AS description,
    'cust_' || o_custkey || ' p.' || (o_orderkey % 50 + 1) AS source, 'cust_' || o_custkey AS document, o_orderkey % 50 + 1 AS page
  FROM orders)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, id, text and type of a claim for every labelled document."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "MRI scan confirmed the diagnosis").when(k == 1, "was prescribed 20 mg of a drug").when(k == 2, "has knee pain and headaches").otherwise("moved to another town")
    kind = F.when(k == 0, "Medical Diagnosis").when(k == 1, "imaging|scan").when(k == 2, "pain").otherwise("unheard of")
    return d.select(F.col("source").alias("case_id"), F.col("doc_id").alias("id"), text.alias("text"), kind.alias("type"), "n_chars")


CLAIMS_SQL = """claims AS (
  SELECT source AS case_id, doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'MRI scan confirmed the diagnosis' WHEN 1 THEN 'was prescribed 20 mg of a drug' WHEN 2 THEN 'has knee pain and headaches' ELSE 'moved to another town' END AS text,
    CASE doc_id % 4 WHEN 0 THEN 'Medical Diagnosis' WHEN 1 THEN 'imaging|scan' WHEN 2 THEN 'pain' ELSE 'unheard of' END AS type, n_chars
  FROM documents JOIN labels USING (doc_id))"""


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, id, verdict and record_reference (blank for every fifth) of labelled documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    verdict = F.when(q & ~t, "SUPPORTED").when(q, "PARTIALLY SUPPORTED").when(t, "CONTRADICTED").otherwise("NOT FOUND")
    ref = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("doc_"), "doc_id", F.lit(" p.1")))
    return d.select(F.col("source").alias("case_id"), F.col("doc_id").alias("id"), verdict.alias("verdict"), ref.alias("record_reference"))


VERIFICATIONS_SQL = """verifications AS (
  SELECT source AS case_id, doc_id AS id, CASE WHEN quality = 1 AND toxic <> 1 THEN 'SUPPORTED' WHEN quality = 1 THEN 'PARTIALLY SUPPORTED' WHEN toxic = 1 THEN 'CONTRADICTED' ELSE 'NOT FOUND' END AS verdict,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'doc_' || doc_id || ' p.1' END AS record_reference
  FROM documents JOIN labels USING (doc_id))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, user_id, phase, model, prompt_tokens and completion_tokens of events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), "ts", "user_id", F.col("event_type").alias("phase"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        F.floor(F.col("value") * 10).cast("long").alias("prompt_tokens"), (F.col("event_id") % 97).alias("completion_tokens"), "value",
    )


USAGE_SQL = """usage AS (
  SELECT event_id AS seq, ts, user_id, event_type AS phase, 'm' || (user_id % 3) AS model, CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, event_id % 97 AS completion_tokens, value FROM events)"""
