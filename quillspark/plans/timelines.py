"""Search, dates and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import search, timeline
from quillspark.plans.registry import Registry
from quillspark.sources import tables

query = Registry()
TEXT_QUERY = "the and nicht of heard"
P = tables.PARAGRAPHS_SQL


def _ranked_sql(words: str) -> str:
    return rf"""post AS (SELECT para_seq, token, count(*) AS tf FROM (SELECT para_seq, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS token FROM paragraphs)
      WHERE token IN (SELECT unnest(regexp_extract_all(lower('{words}'), '[\p{{L}}\p{{N}}]+'))) GROUP BY ALL),
    idf AS (SELECT token, ln(((SELECT count(*) FROM paragraphs) + 1) / (count(*) + 1)) + 1.0 AS idf FROM post GROUP BY token),
    ranked AS (SELECT para_seq, round(sum(tf * idf), 6) AS score FROM post JOIN idf USING (token) GROUP BY para_seq)"""


@query("rnk_01_search", "SELECT label, doc_id, score FROM ranked JOIN paragraphs USING (para_seq) ORDER BY score DESC, para_seq LIMIT 20", P, _ranked_sql(TEXT_QUERY))
def rnk_01_search(spark, sf):
    return search.search(tables.paragraphs(spark, sf), TEXT_QUERY).select("label", "doc_id", "score")


@query("rnk_01_ranked_all", "SELECT para_seq, score FROM ranked", P, _ranked_sql(TEXT_QUERY))
def rnk_01_ranked_all(spark, sf):
    return search.ranked(tables.paragraphs(spark, sf), TEXT_QUERY)


@query("flt_03_provider_filter", "SELECT label, score FROM ranked JOIN paragraphs USING (para_seq) WHERE contains(lower(text), 'nicht') ORDER BY score DESC, para_seq LIMIT 20", P, _ranked_sql("der und Nicht"))
def flt_03_provider_filter(spark, sf):
    return search.search(tables.paragraphs(spark, sf), "der und Nicht", provider="NICHT").select("label", "score")


@query("txt_13_postings", r"SELECT para_seq, token, count(*) AS tf FROM (SELECT para_seq, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM paragraphs) GROUP BY ALL", P)
def txt_13_postings(spark, sf):
    return search.postings(tables.paragraphs(spark, sf))


MONTH = dates.MONTH


def _made(y: str, m: str, d: str) -> str:
    return f"strftime(try_cast({y} || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0') AS DATE), '%Y-%m-%d')"


def _month(name: str) -> str:
    return f"CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr({name}, 1, 3))) + 2) // 3 AS INTEGER)"


def parsed_sql(col: str) -> tuple[str, str]:
    """iso and precision of a printed date, in DuckDB."""
    named, my = rf"(?i)\b({MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", rf"(?i)\b({MONTH})\.?\s+(\d{{4}})\b"
    slash, iso, im, y = r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{4})-(\d{1,2})\b", r"\b(\d{4})\b"

    def x(p: str, g: int) -> str:
        return f"regexp_extract({col}, '{p}', {g})"

    a, b = f"try_cast({x(slash, 1)} AS INTEGER)", f"try_cast({x(slash, 2)} AS INTEGER)"
    year = _made(x(y, 1), "'01'", "'01'")
    month_year = _made(x(my, 2), _month(x(my, 1)), "'01'")
    cases = [
        (f"regexp_matches({col}, '{named}')", _made(x(named, 3), _month(x(named, 1)), x(named, 2)), "'day'"),
        (f"regexp_matches({col}, '{slash}')", f"CASE WHEN length({x(slash, 3)}) <> 4 OR ({a} <= 12 AND {b} <= 12 AND {a} <> {b}) THEN NULL ELSE {_made(x(slash, 3), f'CASE WHEN {a} > 12 THEN {b} ELSE {a} END', f'CAST(CASE WHEN {a} > 12 THEN {a} ELSE {b} END AS VARCHAR)')} END", "'day'"),
        (f"regexp_matches({col}, '{iso}')", _made(x(iso, 1), x(iso, 2), x(iso, 3)), "'day'"),
        (f"regexp_matches({col}, '{im}')", _made(x(im, 1), x(im, 2), "'01'"), "'month'"),
        (f"regexp_matches({col}, '{my}')", f"coalesce({month_year}, {year})", f"CASE WHEN {month_year} IS NOT NULL THEN 'month' ELSE 'year' END"),
        (f"regexp_matches({col}, '{y}')", year, "'year'"),
    ]
    value = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v, _ in cases) + " END"
    kind = "CASE " + " ".join(f"WHEN {c} THEN {p}" for c, _, p in cases) + " END"
    rough = rf"regexp_matches({col}, '(?i)^\s*(?:circa|c\.|around|approx\.?|approximately)\s')"
    return value, f"CASE WHEN ({value}) IS NULL THEN NULL WHEN ({kind}) <> 'year' AND {rough} THEN 'approximate-' || ({kind}) ELSE ({kind}) END"


_iso, _precision = parsed_sql("date")
EVENTS_SQL = f"""parsed AS (SELECT *, {_iso} AS iso, {_precision} AS precision FROM facts),
  sortable AS (SELECT * EXCLUDE (iso), CASE WHEN iso IS NULL THEN '9999-99-99' WHEN precision = 'year' THEN substr(iso, 1, 4) || '-06-15' WHEN precision = 'month' THEN substr(iso, 1, 7) || '-01' ELSE iso END AS date_sortable,
    CASE WHEN type IN ('diagnosis', 'test_result', 'symptom', 'provider_visit') THEN 'diagnostic' WHEN type IN ('treatment', 'medication', 'hospitalization') THEN 'treatment' ELSE 'other' END AS category, iso FROM parsed),
  events_tl AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY date_sortable, seq) AS place FROM sortable)"""
F_ = tables.FACTS_SQL


@query("dat_01_printed_dates", "SELECT seq, date, iso, precision FROM parsed", F_, EVENTS_SQL.split(",\n  sortable")[0])
def dat_01_printed_dates(spark, sf):
    f = tables.facts(spark, sf)
    return f.withColumn("p", dates.printed_date(F.col("date"))).select("seq", "date", "p.iso", "p.precision")


@query("win_03_timeline_order", "SELECT case_id, seq, date_sortable, category, place FROM events_tl", F_, EVENTS_SQL)
def win_03_timeline_order(spark, sf):
    return timeline.events(tables.facts(spark, sf)).select("case_id", "seq", "date_sortable", "category", "place")


@query("dat_03_sort_keys", "SELECT date_sortable, count(*) AS n FROM events_tl GROUP BY 1", F_, EVENTS_SQL)
def dat_03_sort_keys(spark, sf):
    return tables.facts(spark, sf).groupBy(dates.sort_key(F.col("date")).alias("date_sortable")).agg(F.count("*").alias("n"))


@query(
    "win_01_timeline_gaps",
    """SELECT case_id, date, end_date, CAST(d // 30 AS INTEGER) AS months FROM (
      SELECT case_id, date, n_date AS end_date, datediff('day', try_cast(date_sortable AS DATE), try_cast(n_sort AS DATE)) AS d FROM (
        SELECT *, lead(date) OVER w AS n_date, lead(date_sortable) OVER w AS n_sort, lead(precision) OVER w AS n_p FROM events_tl WINDOW w AS (PARTITION BY case_id ORDER BY date_sortable, seq))
      WHERE precision = 'day' AND n_p = 'day') WHERE d // 30 >= 6""",
    F_,
    EVENTS_SQL,
)
def win_01_timeline_gaps(spark, sf):
    return timeline.gaps(timeline.events(tables.facts(spark, sf)))


@query(
    "win_02_day_gaps",
    """SELECT case_id, start, "end", CAST(days AS INTEGER) AS days FROM (SELECT case_id, lag(day) OVER w AS start, day AS "end", datediff('day', CAST(lag(day) OVER w AS DATE), CAST(day AS DATE)) AS days
      FROM (SELECT DISTINCT case_id, date_sortable AS day FROM events_tl WHERE precision = 'day') WINDOW w AS (PARTITION BY case_id ORDER BY day)) WHERE days > 180""",
    F_,
    EVENTS_SQL,
)
def win_02_day_gaps(spark, sf):
    return timeline.day_gaps(timeline.events(tables.facts(spark, sf)))


@query("flt_01_filtered_timeline", "SELECT case_id, seq FROM events_tl WHERE (date_sortable = '9999-99-99' OR (date_sortable >= '1997-01-01' AND date_sortable <= '1999-12-31')) AND type IN ('diagnosis', 'symptom')", F_, EVENTS_SQL)
def flt_01_filtered_timeline(spark, sf):
    return timeline.filtered(timeline.events(tables.facts(spark, sf)), "1997-01-01", "1999-12-31", ("diagnosis", "symptom")).select("case_id", "seq")


@query("agg_02_type_counts", "SELECT type, count(*) AS n FROM facts GROUP BY 1", F_)
def agg_02_type_counts(spark, sf):
    return tables.facts(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query("dat_07_categories", "SELECT category, count(*) AS n FROM events_tl GROUP BY 1", F_, EVENTS_SQL)
def dat_07_categories(spark, sf):
    return tables.facts(spark, sf).groupBy(dates.category(F.col("type")).alias("category")).agg(F.count("*").alias("n"))


@query(
    "dat_06_timeline_buckets",
    "SELECT case_id, coalesce(iso, 'undated') AS bucket, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs FROM events_tl GROUP BY 1, 2",
    F_,
    EVENTS_SQL,
)
def dat_06_timeline_buckets(spark, sf):
    t = tables.facts(spark, sf).withColumn("bucket", F.coalesce(dates.printed_date(F.col("date"))["iso"], F.lit("undated")))
    seqs = F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda s: s.cast("string")), ",")
    return t.groupBy("case_id", "bucket").agg(F.count("*").alias("n"), seqs.alias("seqs"))


@query("win_10_year_sections", "SELECT case_id, substr(date_sortable, 1, 4) AS year, count(*) AS n, min(place) AS first, max(place) AS last FROM events_tl GROUP BY 1, 2", F_, EVENTS_SQL)
def win_10_year_sections(spark, sf):
    t = timeline.events(tables.facts(spark, sf))
    return t.groupBy("case_id", F.substring("date_sortable", 1, 4).alias("year")).agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


@query(
    "rnk_07_condensed",
    """SELECT case_id, seq FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM events_tl) e
      WHERE n <= 5 OR place = n OR EXISTS (SELECT 1 FROM range(5) k(i) WHERE (k.i * n) // 5 = place - 1)""",
    F_,
    EVENTS_SQL,
)
def rnk_07_condensed(spark, sf):
    return timeline.condensed(timeline.events(tables.facts(spark, sf)), 5).select("case_id", "seq")


@query(
    "txt_18_shortened",
    "SELECT para_seq, CASE WHEN length(trim(text)) <= 100 THEN trim(text) ELSE regexp_replace(substr(trim(text), 1, 97), ' [^ ]*$', '') || '...' END AS short FROM paragraphs",
    P,
)
def txt_18_shortened(spark, sf):
    return tables.paragraphs(spark, sf).select("para_seq", timeline.shortened(F.col("text"), 100).alias("short"))


@query(
    "dat_05_search_dates",
    r"""SELECT seq, len(list_filter(list_transform(regexp_extract_all(date || ' ' || alt, '\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b'), lambda r: coalesce(try_cast(r AS DATE), CASE WHEN regexp_matches(r, '/\d{4}$') THEN CAST(try_strptime(r, '%m/%d/%Y') AS DATE) ELSE CAST(try_strptime(r, '%m/%d/%y') AS DATE) END)), lambda d: d BETWEEN DATE '1996-01-01' AND DATE '1998-06-30')) > 0 AS inside
      FROM (SELECT *, '3/9/97' AS alt FROM facts WHERE seq % 3 = 0 UNION ALL SELECT *, '' AS alt FROM facts WHERE seq % 3 <> 0)""",
    F_,
)
def dat_05_search_dates(spark, sf):
    f = tables.facts(spark, sf).withColumn("alt", F.when(F.col("seq") % 3 == 0, "3/9/97").otherwise(""))
    return f.select("seq", dates.any_date_between(F.concat_ws(" ", "date", "alt"), "1996-01-01", "1998-06-30").alias("inside"))


QUERIES, SQL = query.queries, query.sql
