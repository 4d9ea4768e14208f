"""Text shaping, evidence ranking, sanitising and keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import search, shaping
from quillspark.plans.registry import Registry
from quillspark.sources import tables

query = Registry()
P = tables.PARAGRAPHS_SQL
TRIM = r"regexp_replace({}, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')"


@query("txt_01_clean_text", "SELECT doc_id, " + TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS text FROM documents")
def txt_01_clean_text(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", shaping.clean_text(F.col("text")).alias("text"))


@query("src_05_dehyphenate", r"SELECT doc_id, regexp_replace(replace(text, 'in ', 'in-' || chr(10)), '([A-Za-z])-\n([a-z])', '\1\2', 'g') AS text FROM documents WHERE NOT regexp_matches(replace(text, 'in ', 'in-' || chr(10)), '-\n[a-z]-\n')")
def src_05_dehyphenate(spark, sf):
    broken = F.replace("text", F.lit("in "), F.lit("in-\n"))
    return tables.table(spark, sf, "documents").select("doc_id", shaping.dehyphenate(broken).alias("text"))


@query(
    "src_06_tabular_rows",
    r"""SELECT event_id, CASE WHEN len(f) BETWEEN 3 AND 8 AND length(s) <= 200 AND NOT ends_with(s, '.') AND regexp_matches(s, '\d') THEN array_to_string(f, ' | ') ELSE line END AS line FROM (
      SELECT event_id, line, trim(line) AS s, list_filter(string_split_regex(trim(line), '\s{2,}'), lambda x: x <> '') AS f FROM (SELECT event_id, event_type || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '   ' END || user_id || '  ' || (event_id % 10) || CASE WHEN event_id % 7 = 0 THEN '.' ELSE '' END AS line FROM events))""",
)
def src_06_tabular_rows(spark, sf):
    e = tables.table(spark, sf, "events")
    line = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, " ").otherwise("   "), "user_id", F.lit("  "), F.col("event_id") % 10, F.when(F.col("event_id") % 7 == 0, ".").otherwise(""))
    return e.select("event_id", shaping.tabular(line).alias("line"))


def _stem_sql(t: str) -> str:
    out = f"CASE WHEN length({t}) <= 4 THEN {t}"
    for suffix, more in shaping.SUFFIXES:
        base = f"substr({t}, 1, length({t}) - {len(suffix)})"
        new = f"{base} || '{more}'"
        if suffix in ("ing", "ed"):
            new = f"CASE WHEN length({base}) > 3 AND right({base}, 1) = substr({base}, length({base}) - 1, 1) THEN substr({base}, 1, length({base}) - 1) ELSE {new} END"
        out += f" WHEN ends_with({t}, '{suffix}') AND length({t}) - {len(suffix)} >= 3 THEN {new}"
    return out + f" ELSE {t} END"


@query("txt_14_stems", r"SELECT DISTINCT token, " + _stem_sql("token") + r" AS stem FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents)")
def txt_14_stems(spark, sf):
    t = tables.table(spark, sf, "documents").select(F.explode(search.tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", shaping.stem(F.col("token")).alias("stem"))


_SYN = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in shaping.SYNONYMS.items()) + ") v(lay, clinical))"
_STOP = ", ".join(f"'{w}'" for w in shaping.STOPWORDS)


def _tokens_sql(name: str, source: str, key: str, text: str) -> str:
    return rf"""{name}_w AS (SELECT DISTINCT {key}, token FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS token FROM {source}) WHERE token NOT IN ({_STOP})),
  {name}_s AS (SELECT {key}, token, {_stem_sql("token")} AS stem FROM {name}_w),
  {name} AS (SELECT {key}, token FROM {name}_s UNION SELECT {key}, stem FROM {name}_s UNION SELECT {key}, coalesce(a.clinical, b.clinical) FROM {name}_s LEFT JOIN syn a ON a.lay = token LEFT JOIN syn b ON b.lay = stem WHERE coalesce(a.clinical, b.clinical) IS NOT NULL)"""


_Q = "asks AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:12], ' ') || ' neck pain sleeping' AS query FROM benchmark)"


def _asks(spark, sf):
    b = tables.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.array_join(F.slice(F.split("text", " "), 1, 12), " "), F.lit(" neck pain sleeping")).alias("query"))


@query("txt_15_content_tokens", "SELECT query_id, token FROM toks", _SYN, _Q, _tokens_sql("toks", "asks", "query_id", "query"))
def txt_15_content_tokens(spark, sf):
    return _asks(spark, sf).select("query_id", F.explode(shaping.content_tokens(F.col("query"))).alias("token"))


_RANK = """wt AS (SELECT token, ln(((SELECT count(DISTINCT para_seq) FROM p) + 1) / (coalesce(df, 0) + 1)) + 1.0 AS w FROM (SELECT DISTINCT token FROM q) LEFT JOIN (SELECT token, count(*) AS df FROM p GROUP BY 1) USING (token)),
  whole AS (SELECT query_id, sum(w) AS al FROM q JOIN wt USING (token) GROUP BY 1),
  ovl AS (SELECT query_id, para_seq, round(sum(w) / any_value(al), 6) AS overlap FROM q JOIN wt USING (token) JOIN p USING (token) JOIN whole USING (query_id) GROUP BY 1, 2)"""


@query(
    "rnk_02_evidence_top",
    "SELECT query_id, para_seq, overlap, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, para_seq) AS place FROM ovl) WHERE place <= 8",
    P,
    _SYN,
    _Q,
    _tokens_sql("p", "paragraphs", "para_seq", "text"),
    _tokens_sql("q", "asks", "query_id", "query"),
    _RANK,
)
def rnk_02_evidence_top(spark, sf):
    return shaping.top_per(shaping.ranked_evidence(tables.paragraphs(spark, sf), _asks(spark, sf)), "query_id", "overlap", "para_seq", 8)


@query("rnk_03_weak_queries", "SELECT query_id, max(overlap) AS best, max(overlap) < 0.3 AS weak FROM ovl GROUP BY 1", P, _SYN, _Q, _tokens_sql("p", "paragraphs", "para_seq", "text"), _tokens_sql("q", "asks", "query_id", "query"), _RANK)
def rnk_03_weak_queries(spark, sf):
    r = shaping.ranked_evidence(tables.paragraphs(spark, sf), _asks(spark, sf))
    return r.groupBy("query_id").agg(F.max("overlap").alias("best"), (F.max("overlap") < 0.3).alias("weak"))


@query("txt_02_blocks")
def txt_02_blocks(spark, sf):
    return shaping.blocks(tables.table(spark, sf, "documents"), 4000).select("doc_id", "block", "start", "end", F.sha2("text", 256).alias("sha"))


@query("txt_03_broken_spans", "SELECT CAST(0 AS BIGINT) AS broken")
def txt_03_broken_spans(spark, sf):
    b = shaping.blocks(tables.table(spark, sf, "documents"), 4000).where("block > 0").withColumnRenamed("block", "page")
    return shaping.broken_spans(b, "doc_id").agg(F.count("*").alias("broken"))


@query("txt_04_full_text", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE text <> ''")
def txt_04_full_text(spark, sf):
    b = shaping.blocks(tables.table(spark, sf, "documents"), 4000).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("b"))
    return b.select("doc_id", F.sha2(F.array_join(F.transform("b", lambda x: x["text"]), ""), 256).alias("sha"))


@query("txt_06_chunks")
def txt_06_chunks(spark, sf):
    return shaping.chunks(tables.table(spark, sf, "documents")).select("doc_id", "chunk", "chunks", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))


@query("txt_05_labelled_text", "SELECT doc_id // 10 AS file, sha256(string_agg('[doc_' || doc_id || ' — page 1]' || chr(10) || t, chr(10) || chr(10) ORDER BY doc_id)) AS sha FROM (SELECT doc_id, " + TRIM.format("text") + " AS t FROM documents) WHERE t <> '' GROUP BY 1")
def txt_05_labelled_text(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", tables.stripped("text").alias("t")).where("t <> ''")
    page = F.struct("doc_id", F.concat(F.lit("[doc_"), "doc_id", F.lit(" — page 1]\n"), "t").alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["x"]), "\n\n")
    return d.groupBy(F.floor(F.col("doc_id") / 10).alias("file")).agg(F.sha2(joined, 256).alias("sha"))


_MARK = r"\[([^\[\]]+) — (page|block) (\d+)\]"


@query("txt_08_page_markers", rf"SELECT query_id, len(regexp_extract_all(t, '{_MARK}')) AS n, array_to_string(regexp_extract_all(t, '{_MARK}', 3), ',') AS pages FROM (SELECT query_id, '[a.pdf — page ' || query_id || '] ' || query || ' [b.md — block 7]' AS t FROM asks)", _Q)
def txt_08_page_markers(spark, sf):
    t = F.concat(F.lit("[a.pdf — page "), "query_id", F.lit("] "), "query", F.lit(" [b.md — block 7]"))
    found = F.regexp_extract_all(t, F.lit(_MARK), F.lit(3))
    return _asks(spark, sf).select("query_id", F.size(found).cast("long").alias("n"), F.array_join(found, ",").alias("pages"))


@query(
    "txt_09_page_runs",
    """SELECT o_custkey AS grp, string_agg(file || ' p.' || a || CASE WHEN a = b THEN '' ELSE '-p.' || b END, '; ' ORDER BY run) AS hint FROM (SELECT o_custkey, run, any_value(file) AS file, min(n) AS a, max(n) AS b FROM (
      SELECT *, sum(CASE WHEN lag_f = file AND lag_n + 1 = n THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT o_custkey, o_orderkey, o_orderstatus AS file, o_orderkey % 4 AS n, lag(o_orderstatus) OVER w AS lag_f, lag(o_orderkey % 4) OVER w AS lag_n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))) GROUP BY 1, 2) GROUP BY 1""",
)
def txt_09_page_runs(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("file"), (F.col("o_orderkey") % 4).alias("n"))
    return shaping.page_runs(o, "grp")


@query("txt_16_carried_headings", "SELECT event_id, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS heading FROM (SELECT *, CASE WHEN event_type IN ('signup', 'purchase') THEN upper(event_type) END AS h FROM events)")
def txt_16_carried_headings(spark, sf):
    e = tables.table(spark, sf, "events")
    h = F.when(F.col("event_type").isin("signup", "purchase"), F.upper("event_type"))
    return shaping.carried(e, "user_id", "event_id", h, "heading").select("event_id", "heading")


@query("txt_19_truncated", "SELECT doc_id, substr(text, 1, 2000) AS head, greatest(length(text) - 2000, 0) AS removed FROM documents")
def txt_19_truncated(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 2000).alias("head"), F.greatest(F.length("text") - 2000, F.lit(0)).cast("long").alias("removed"))


@query("txt_11_excerpts")
def txt_11_excerpts(spark, sf):
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shaping.excerpt(t, {"the", "und", "de"}, 400))

    return tables.paragraphs(spark, sf).select("para_seq", cut("text").alias("excerpt"))


@query("snk_01_guarded_csv", "SELECT user_id, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') THEN '''' || v ELSE v END AS v, count(*) AS n FROM (SELECT user_id, CASE event_type WHEN 'view' THEN '=' WHEN 'click' THEN '-' WHEN 'error' THEN '@' ELSE '' END || event_type AS v FROM events) GROUP BY 1, 2")
def snk_01_guarded_csv(spark, sf):
    k = F.col("event_type")
    v = F.concat(F.when(k == "view", "=").when(k == "click", "-").when(k == "error", "@").otherwise(""), k)
    return tables.table(spark, sf, "events").groupBy("user_id", shaping.formula_guarded(v).alias("v")).agg(F.count("*").alias("n"))


@query("pii_redacted_secrets", None)
def pii_redacted_secrets(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "text", shaping.redacted(F.col("text")).alias("clean"))
    return d.select("doc_id", (F.col("clean") != F.col("text")).alias("changed"), F.length("clean").alias("n"))


_KEYS = "keys AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'audit/2024/01/0' || (event_id % 9 + 1) || '/rotated-audit-' || user_id || '-' || event_id || '-0123456789ab.jsonl' WHEN 1 THEN 'audit/2024/02/03/live-a.log-g' || (event_id % 9) || 'f-' || event_id || '-' || (event_id + user_id) || '-ba9876543210.jsonl' ELSE 'other/' || event_id END AS key FROM events)"


@query(
    "src_22_object_keys",
    r"""SELECT event_id, CASE WHEN r THEN 'rotated' WHEN l THEN 'live' END AS kind, CASE WHEN r THEN CAST(regexp_extract(key, '^audit/(\d{4}/\d{2}/\d{2})/rotated-(.+)-(\d+)-([0-9a-f]{12})\.jsonl$', 3) AS BIGINT)
      WHEN l THEN CAST(regexp_extract(key, '-g([0-9a-f]+)-(\d+)-(\d+)-([0-9a-f]{12})\.jsonl$', 3) AS BIGINT) END AS "end",
      CASE WHEN r THEN 'unknown' WHEN l THEN regexp_extract(key, '-g([0-9a-f]+)-(\d+)-(\d+)-', 1) END AS generation
      FROM (SELECT *, regexp_matches(key, '/rotated-') AS r, regexp_matches(key, '/live-') AS l FROM keys)""",
    _KEYS,
)
def src_22_object_keys(spark, sf):
    e, i = tables.table(spark, sf, "events"), F.col("event_id")
    key = (
        F.when(i % 3 == 0, F.concat(F.lit("audit/2024/01/0"), i % 9 + 1, F.lit("/rotated-audit-"), "user_id", F.lit("-"), i, F.lit("-0123456789ab.jsonl")))
        .when(i % 3 == 1, F.concat(F.lit("audit/2024/02/03/live-a.log-g"), i % 9, F.lit("f-"), i, F.lit("-"), i + F.col("user_id"), F.lit("-ba9876543210.jsonl")))
        .otherwise(F.concat(F.lit("other/"), i))
    )
    return e.select("event_id", shaping.object_key(key).alias("k")).select("event_id", "k.kind", "k.end", "k.generation")


@query("src_18_split_parts", "SELECT doc_id, (ord - 1) // 5 AS part, count(*) AS lines FROM paragraphs GROUP BY 1, 2", P)
def src_18_split_parts(spark, sf):
    return tables.paragraphs(spark, sf).groupBy("doc_id", F.floor((F.col("ord") - 1) / 5).alias("part")).agg(F.count("*").alias("lines"))


@query("src_15_discovered", "SELECT min(doc_id) AS doc_id, lang || '/' || source AS path FROM documents GROUP BY 2")
def src_15_discovered(spark, sf):
    return tables.table(spark, sf, "documents").groupBy(F.concat("lang", F.lit("/"), "source").alias("path")).agg(F.min("doc_id").alias("doc_id"))


@query("src_19_unreadable_pages", "SELECT lang, count(*) AS pages, coalesce(string_agg(CASE WHEN n_chars < 100 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id), '') AS short FROM documents GROUP BY 1")
def src_19_unreadable_pages(spark, sf):
    short = F.array_sort(F.collect_list(F.when(F.col("n_chars") < 100, F.col("doc_id"))))
    return tables.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("pages"), F.array_join(F.transform(short, lambda i: i.cast("string")), ",").alias("short"))


@query("src_04_page_text", "SELECT l_orderkey, max_by(CAST(l_linenumber AS BIGINT), (l_quantity * 100 + l_linenumber)) AS best FROM lineitem GROUP BY 1")
def src_04_page_text(spark, sf):
    # The candidate with most dates, then the longest: the greatest struct.
    return tables.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by(F.col("l_linenumber").cast("long"), F.struct("l_quantity", "l_linenumber")).alias("best"))


@query("flt_07_content_words", "SELECT query_id, count(token) > 0 AS some FROM asks LEFT JOIN toks USING (query_id) GROUP BY 1", _SYN, _Q, _tokens_sql("toks", "asks", "query_id", "query"))
def flt_07_content_words(spark, sf):
    return _asks(spark, sf).select("query_id", (F.size(shaping.content_tokens(F.col("query"))) > 0).alias("some"))


@query("agg_25_keyword_overlap", "SELECT query_id, round(count(t.token) FILTER (t.token IN (SELECT token FROM p)) / count(*), 6) AS share FROM q t GROUP BY 1", P, _SYN, _Q, _tokens_sql("p", "paragraphs", "para_seq", "text"), _tokens_sql("q", "asks", "query_id", "query"))
def agg_25_keyword_overlap(spark, sf):
    q = _asks(spark, sf).select("query_id", F.explode(shaping.content_tokens(F.col("query"))).alias("token"))
    have = tables.paragraphs(spark, sf).select(F.explode(shaping.content_tokens(F.col("text"))).alias("token")).distinct().withColumn("there", F.lit(1))
    return q.join(have, "token", "left").groupBy("query_id").agg(F.round(F.count("there") / F.count("*"), 6).alias("share"))


@query("agg_29_pattern_counts", r"SELECT doc_id, len(regexp_extract_all(text, '\bth\w+')) AS th, len(regexp_extract_all(text, '[.!?]')) AS stops FROM documents")
def agg_29_pattern_counts(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\bth\w+")).cast("long").alias("th"), F.regexp_count("text", F.lit(r"[.!?]")).cast("long").alias("stops"))


@query("hash_fingerprints", "SELECT doc_id, substr(sha256(text), 1, 12) AS sha12, 'fact-' || sha256(lang || '|' || source) AS fact_id FROM documents")
def hash_fingerprints(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("sha12"), F.concat(F.lit("fact-"), F.sha2(F.concat_ws("|", "lang", "source"), 256)).alias("fact_id"))


@query("src_10_size_budget", "SELECT lang, source, count(*) AS n FROM (SELECT lang, source, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 100000 GROUP BY 1, 2")
def src_10_size_budget(spark, sf):
    # Smallest first: once one doesn't fit, no larger one does, so the greedy fold is a running sum.
    used = F.sum("n_chars").over(Window.partitionBy("lang").orderBy("n_chars", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return tables.table(spark, sf, "documents").withColumn("used", used).where("used <= 100000").groupBy("lang", "source").agg(F.count("*").alias("n"))


QUERIES, SQL = query.queries, query.sql
