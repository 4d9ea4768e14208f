"""Dedup, citations, claims, verdicts and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import quotes, review
from quillspark.plans.registry import Registry
from quillspark.sources import tables

query = Registry()
P, F_, C, V = tables.PARAGRAPHS_SQL, tables.FACTS_SQL, tables.CLAIMS_SQL, tables.VERIFICATIONS_SQL
KEY = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query("ded_01_duplicate_pages", "SELECT doc_id AS seq, 'doc_' || doc_id || ' p.1' AS label, 'doc_' || f || ' p.1' AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY regexp_replace(text, '\\r\\n|\\r', chr(10), 'g')) AS f FROM documents) WHERE doc_id > f")
def ded_01_duplicate_pages(spark, sf):
    d = tables.table(spark, sf, "documents")
    return review.duplicate_pages(d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc_"), "doc_id", F.lit(" p.1")).alias("label"), "text"))


@query("join_13_corroborations", "SELECT a.doc_id AS seq, f AS also_in FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) a JOIN documents o ON o.doc_id = f WHERE a.source <> o.source")
def join_13_corroborations(spark, sf):
    d = tables.table(spark, sf, "documents")
    dup = review.duplicate_pages(d.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("label"), "text"))
    of = d.select(F.col("doc_id").alias("duplicate_of"), F.col("source").alias("origin"))
    return dup.join(d.select(F.col("doc_id").alias("seq"), "source"), "seq").join(of, "duplicate_of").where("source <> origin").select("seq", F.col("duplicate_of").alias("also_in"))


@query("ded_02_exact_evidence", "SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY date, type, description, document ORDER BY seq) AS k FROM facts) WHERE k = 1", F_)
def ded_02_exact_evidence(spark, sf):
    return review.first_of(tables.facts(spark, sf), ["date", "type", "description", "document"]).select("seq")


@query("ded_03_repeated_facts", f"SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY {KEY.format('date')}, {KEY.format('description')} ORDER BY seq) AS k FROM facts) WHERE k = 1", F_)
def ded_03_repeated_facts(spark, sf):
    return review.first_of(tables.facts(spark, sf), [review.norm_key(F.col("date")).alias("d"), review.norm_key(F.col("description")).alias("t")]).select("seq")


@query("ded_06_distinct_excerpts", f"SELECT min(para_seq) AS para_seq, count(*) AS n FROM paragraphs GROUP BY {KEY.format('text')}", P)
def ded_06_distinct_excerpts(spark, sf):
    return tables.paragraphs(spark, sf).groupBy(review.norm_key(F.col("text")).alias("k")).agg(F.min("para_seq").alias("para_seq"), F.count("*").alias("n")).drop("k")


@query("txt_21_norm_keys", f"SELECT para_seq, {KEY.format('text')} AS k FROM paragraphs", P)
def txt_21_norm_keys(spark, sf):
    return tables.paragraphs(spark, sf).select("para_seq", review.norm_key(F.col("text")).alias("k"))


_ELEMENT = " ".join(f"WHEN type = '{k}' THEN '{e}'" for k, e in review.ELEMENT_OF.items())
_ALL = " UNION ALL ".join(f"SELECT '{e}' AS element" for e in review.ELEMENTS)


@query("agg_01_element_coverage", f"SELECT element, coalesce(n, 0) AS n FROM ({_ALL}) LEFT JOIN (SELECT CASE WHEN regexp_matches(description, '{review.NEXUS}') THEN 'nexus' {_ELEMENT} ELSE 'other' END AS element, count(*) AS n FROM facts GROUP BY 1) USING (element)", F_)
def agg_01_element_coverage(spark, sf):
    return review.element_coverage(tables.facts(spark, sf))


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in review.RECORD_TYPES) + " ELSE 'Other' END"
_PIVOT = ", ".join(f"count(*) FILTER (verdict = '{v}') AS \"{v}\"" for v in review.VERDICTS)


@query("agg_04_evidence_dashboard", f"SELECT {_TYPE} AS record_type, {_PIVOT} FROM verifications v LEFT JOIN claims c USING (id) GROUP BY 1", V, C)
def agg_04_evidence_dashboard(spark, sf):
    return review.dashboard(tables.verifications(spark, sf), tables.claims(spark, sf))


@query(
    "agg_05_dashboard_totals",
    f"""SELECT coalesce(t, 'all') AS record_type, count(*) AS n, round(100.0 * count(*) FILTER (verdict = 'SUPPORTED') / count(*), 6) AS supported, round(100.0 * count(*) FILTER (verdict = 'CONTRADICTED') / count(*), 6) AS contradicted
      FROM (SELECT {_TYPE} AS t, verdict FROM verifications LEFT JOIN claims c USING (id)) GROUP BY ROLLUP (t)""",
    V,
    C,
)
def agg_05_dashboard_totals(spark, sf):
    j = tables.verifications(spark, sf).join(tables.claims(spark, sf).select("id", "text"), "id", "left").select(review.record_type(F.coalesce("text", F.lit(""))).alias("t"), "verdict")
    share = lambda v: F.round(F.count_if(F.col("verdict") == v) * 100.0 / F.count("*"), 6)
    return j.rollup("t").agg(F.count("*").alias("n"), share("SUPPORTED").alias("supported"), share("CONTRADICTED").alias("contradicted")).select(F.coalesce("t", F.lit("all")).alias("record_type"), "n", "supported", "contradicted")


@query("agg_12_contradictions", "SELECT case_id, count(*) FILTER (verdict = 'CONTRADICTED') AS n FROM verifications GROUP BY 1", V)
def agg_12_contradictions(spark, sf):
    return tables.verifications(spark, sf).groupBy("case_id").agg(F.count_if(F.col("verdict") == "CONTRADICTED").alias("n"))


_SCORES = """scored AS (SELECT case_id, least(100.0, greatest(0.0, (avg(CASE verdict WHEN 'SUPPORTED' THEN 1.0::DOUBLE WHEN 'PARTIALLY SUPPORTED' THEN 0.5::DOUBLE WHEN 'CONTRADICTED' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END) + 1.0::DOUBLE) * 50.0::DOUBLE)) AS verdict,
    least(100.0::DOUBLE, count(*) FILTER (trim(record_reference) <> '') / count(*) * 100.0::DOUBLE) AS density, max(n_chars) AS chars, count(*) AS n FROM verifications JOIN claims USING (case_id, id) GROUP BY 1),
  parts AS (SELECT *, (n % 11) * 10.0::DOUBLE AS rubric, CASE WHEN chars <= 0 THEN 0.0 WHEN chars < 300 THEN chars / 300 * 60.0 WHEN chars > 40000 THEN 70.0 ELSE 100.0 END::DOUBLE AS len FROM scored)"""


def _scored(spark, sf):
    j = tables.verifications(spark, sf).join(tables.claims(spark, sf).drop("case_id"), "id")
    s = j.groupBy("case_id").agg(review.verdict_component(F.col("verdict")).alias("verdict"), review.density_component(F.col("record_reference"), F.count("*")).alias("density"), F.max("n_chars").alias("chars"), F.count("*").alias("n"))
    return s.withColumn("rubric", (F.col("n") % 11) * 10.0).withColumn("len", review.length_component(F.col("chars")))


@query("agg_07_verdict_component", "SELECT case_id, round(verdict, 6) AS verdict, round(density, 6) AS density FROM scored", V, C, _SCORES)
def agg_07_verdict_component(spark, sf):
    return _scored(spark, sf).select("case_id", F.round("verdict", 6).alias("verdict"), F.round("density", 6).alias("density"))


@query(
    "agg_10_effectiveness",
    """SELECT case_id, score, CASE WHEN score > 75 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'red' END AS band FROM (
      SELECT case_id, CAST(round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, rubric * 0.40::DOUBLE + verdict * 0.30::DOUBLE + density * 0.20::DOUBLE + len * 0.10::DOUBLE)), 0) AS INTEGER) AS score FROM parts)""",
    V,
    C,
    _SCORES,
)
def agg_10_effectiveness(spark, sf):
    s = _scored(spark, sf).withColumn("score", review.effectiveness(*[F.col(c) for c in ("rubric", "verdict", "density", "len")]))
    return s.select("case_id", "score", review.band(F.col("score")).alias("band"))


@query("agg_09_length_component", "SELECT doc_id, round(CASE WHEN n_chars <= 0 THEN 0.0 WHEN n_chars < 300 THEN n_chars / 300 * 60.0 WHEN n_chars > 40000 THEN 70.0 ELSE 100.0 END::DOUBLE, 6) AS part FROM documents")
def agg_09_length_component(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.round(review.length_component(F.col("n_chars")), 6).alias("part"))


@query("agg_11_rating", "SELECT c_custkey AS id, CASE WHEN m >= 8.5 THEN 'Excellent' WHEN m >= 7.0 THEN 'Strong' WHEN m >= 5.0 THEN 'Adequate' ELSE 'Needs Substantial Work' END AS rating FROM (SELECT c_custkey, ((c_custkey % 81) + (c_custkey % 11) * 0.5::DOUBLE) / 8.5::DOUBLE AS m FROM customer)")
def agg_11_rating(spark, sf):
    c = tables.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), review.rating(F.col("c_custkey") % 81, F.col("c_custkey") % 11).alias("rating"))


_ALIAS = " ".join(f"WHEN c IN ({', '.join(repr(a) for a in names)}) THEN '{k}'" for k, names in review.CLAIM_ALIASES.items())


@query(
    "pred_07_claim_types",
    f"""SELECT id, coalesce(first(t ORDER BY k) FILTER (t IS NOT NULL), 'other') AS type FROM (SELECT id, k, CASE WHEN c IN {review.CLAIM_TYPES!r} THEN c {_ALIAS} END AS t FROM (
      SELECT id, 0 AS k, regexp_replace(lower(trim(type)), '[\\s\\-]+', '_', 'g') AS c FROM claims UNION ALL
      SELECT id, generate_subscripts(string_split_regex(lower(trim(type)), '[|/]'), 1), regexp_replace(trim(unnest(string_split_regex(lower(trim(type)), '[|/]'))), '[\\s\\-]+', '_', 'g') FROM claims)) GROUP BY id""",
    C,
)
def pred_07_claim_types(spark, sf):
    return tables.claims(spark, sf).select("id", review.claim_type(F.col("type")).alias("type"))


@query("pred_02_citations", r"SELECT seq, regexp_extract(source, '(?i)^(.+?)\s+[pb]\.(\d+)(?:\s*[-–]\s*[pb]\.\d+)?$', 1) AS document, CAST(regexp_extract(source, '(?i)^(.+?)\s+[pb]\.(\d+)(?:\s*[-–]\s*[pb]\.\d+)?$', 2) AS INTEGER) AS page FROM facts", F_)
def pred_02_citations(spark, sf):
    return tables.facts(spark, sf).select("seq", review.citation(F.col("source")).alias("c")).select("seq", "c.document", "c.page")


_UNITS = "units AS (SELECT DISTINCT document, page, (page % 7 <> 0) AS readable FROM facts)"


def _units(spark, sf):
    return tables.facts(spark, sf).select("document", "page", (F.col("page") % 7 != 0).alias("readable")).distinct()


@query("join_02_resolved_references", "SELECT seq, reference, u.document AS document, u.page AS page FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN source ELSE upper(document) || ' — Page ' || page END AS reference FROM facts) r LEFT JOIN units u ON u.readable AND (lower(reference) = u.document || ' p.' || u.page OR lower(reference) = u.document || ' — page ' || u.page)", F_, _UNITS)
def join_02_resolved_references(spark, sf):
    f = tables.facts(spark, sf)
    r = f.select("seq", F.when(F.col("seq") % 2 == 0, F.col("source")).otherwise(F.concat(F.upper("document"), F.lit(" — Page "), "page")).alias("reference"))
    return review.resolved(r, _units(spark, sf)).select("seq", "reference", "document", "page")


@query("flt_06_unresolved", "SELECT count(*) AS n FROM facts f LEFT JOIN units u ON u.readable AND f.source = u.document || ' p.' || u.page WHERE u.page IS NULL", F_, _UNITS)
def flt_06_unresolved(spark, sf):
    r = tables.facts(spark, sf).select("seq", F.col("source").alias("reference"))
    return review.resolved(r, _units(spark, sf)).where("page is null").agg(F.count("*").alias("n"))


#: Quotes that borders decide, each with its page: cut numbers, terms and words, and some that stand whole.
_CASES = (
    ("5 mg orally daily", "takes 1.5 mg orally daily"), ("1.5 mg orally daily", "takes 1.5 mg orally daily"), ("weight bearing on left", "non-weight bearing on left"),
    ("non-weight bearing on left", "is Non-weight  bearing on left."), ("oxygen was at 95", "oxygen was at 95%"), ("oxygen was at 95%", "oxygen was at 95%, then"),
    ("edema was rated 3", "edema was rated 3+ today"), ("temperature was about 37°", "temperature was about 37°C"), ("seen on 2024-01-0 again", "seen on 2024-01-02 again"),
    ("range of motion 10", "range of motion 10-20 degrees"), ("the patient did well", "the patients did well"), ("patient could not walk", "patient could not walk'n"),
    ("had pain at rest", "had pain at rest; had pain at resting"), ("pain at rest today", "xpain at rest today, pain at rest today"), ("operative pain was mild", "post—operative pain was mild"),
    ("only three words", "only three words"), ("blood pressure was 120", "blood pressure was 120/80"), ("score was -5 points", "score was -5 points"), ("5 points in all", "score -5 points in all"),
)


def _cases(spark):
    return spark.createDataFrame([(-k, f"case_{k}", 1, q, t) for k, (q, t) in enumerate(_CASES, 1)], "seq long, document string, page int, quote string, text string")


_CASES_SQL = "cases AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(-k, q.replace("'", "''"), t.replace("'", "''")) for k, (q, t) in enumerate(_CASES, 1)) + ") v(seq, quote, t))"


def _bars(rules, side):
    """SQL: no rule bars what stands on this side of the quote."""
    edge = "regexp_matches({b}, '(?:{x})$')" if side == "b" else "regexp_matches({b}, '^(?:{x})')"
    return " AND ".join("NOT (regexp_matches(q, '{}') AND {})".format(own.replace("'", "''"), edge.format(b=side, x=barred.replace("'", "''"))) for own, barred in rules)


_STANDS_SQL = f"""stands AS (
  SELECT seq, bool_or({_bars(quotes.BEFORE, "b")} AND {_bars(quotes.BEHIND, "f")}) AS found FROM (
    SELECT seq, q, right(CASE WHEN i > 1 THEN q ELSE '' END || parts[i], 40) AS b, left(parts[i + 1] || CASE WHEN i + 1 < len(parts) THEN q ELSE '' END, 4) AS f
    FROM (SELECT seq, q, parts, unnest(range(1, len(parts))) AS i FROM (SELECT seq, q, string_split(t, q) AS parts FROM asked WHERE long AND contains(t, q)))) GROUP BY seq)"""
_LONG = r"len(list_filter(string_split_regex(trim(quote), '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))) >= 4"


@query(
    "join_01_verified_quotes",
    "SELECT seq, coalesce(found, false) AND unique_page AS found FROM asked LEFT JOIN stands USING (seq)",
    P,
    _CASES_SQL,
    f"""asked AS (SELECT doc_id * 2147483648 + ord AS seq, {_LONG} AS long, {KEY.format("quote")} AS q, {KEY.format("d.text")} AS t, doc_id % 3 <> 0 AS unique_page
      FROM (SELECT doc_id, ord, replace(text, ' ', '  ') AS quote FROM paragraphs) JOIN documents d USING (doc_id)
      UNION ALL SELECT seq, {_LONG}, {KEY.format("quote")}, {KEY.format("t")}, true FROM cases)""",
    _STANDS_SQL,
)
def join_01_verified_quotes(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("document"), F.lit(1).alias("page"), "text", "doc_id")
    pages = d.unionByName(d.where("doc_id % 3 = 0")).drop("doc_id").unionByName(_cases(spark).select("document", "page", "text"))
    q = tables.paragraphs(spark, sf).select(F.col("para_seq").alias("seq"), F.concat(F.lit("doc_"), "doc_id").alias("document"), F.lit(1).alias("page"), F.replace("text", F.lit(" "), F.lit("  ")).alias("quote"))
    return quotes.quotes_present(q.unionByName(_cases(spark).select("seq", "document", "page", "quote")), pages)


@query(
    "join_01_whole_quotes",
    rf"""SELECT doc_id * 2147483648 + ord AS seq, len(list_filter(string_split_regex(trim(quote), '\s+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) >= 4 AND contains({KEY.format('d.text')}, {KEY.format('quote')}) AND (doc_id % 3 <> 0) AS found
      FROM (SELECT doc_id, ord, replace(text, ' ', '  ') AS quote FROM paragraphs) JOIN documents d USING (doc_id)""",
    P,
)
def join_01_whole_quotes(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("document"), F.lit(1).alias("page"), "text", "doc_id")
    pages = d.unionByName(d.where("doc_id % 3 = 0"))
    q = tables.paragraphs(spark, sf).select(F.col("para_seq").alias("seq"), F.concat(F.lit("doc_"), "doc_id").alias("document"), F.lit(1).alias("page"), F.replace("text", F.lit(" "), F.lit("  ")).alias("quote"))
    return quotes.quotes_present(q, pages)


#: Pages are paragraphs, five of a document a chunk; facts cite the page behind the one that they quote.
_CHUNKS = "pages AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS page, text FROM paragraphs), facts_ AS (SELECT doc_id * 2147483648 + ord AS seq, doc_id, page, (page - 1) // 5 AS chunk, text AS quote FROM pages)"


@query(
    "join_08_relocated_citations",
    "SELECT f.seq AS seq, 'doc_' || f.doc_id AS document, CASE WHEN n = 1 AND NOT own THEN found_at ELSE f.page + 1 END AS page, coalesce(n = 1 AND NOT own, false) AS moved FROM facts_ f LEFT JOIN held USING (seq)",
    P,
    _CHUNKS,
    f"asked AS (SELECT f.seq * 1000 + p.page AS seq, f.seq AS fact, f.page AS cited, p.page AS found_at, {_LONG} AS long, {KEY.format('quote')} AS q, {KEY.format('p.text')} AS t FROM facts_ f JOIN pages p ON p.doc_id = f.doc_id AND (p.page - 1) // 5 = f.chunk)",
    _STANDS_SQL,
    "held AS (SELECT fact AS seq, count(*) AS n, any_value(found_at) AS found_at, bool_or(found_at = cited + 1) AS own FROM asked JOIN stands USING (seq) WHERE found GROUP BY 1)",
)
def join_08_relocated_citations(spark, sf):
    page = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("long")
    p = tables.paragraphs(spark, sf).withColumn("page", page).withColumn("chunk", F.concat_ws(":", "doc_id", F.floor((F.col("page") - 1) / 5))).withColumn("document", F.concat(F.lit("doc_"), "doc_id"))
    facts = p.select(F.col("para_seq").alias("seq"), "chunk", "document", (F.col("page") + 1).alias("page"), F.col("text").alias("quote"))
    return quotes.relocated(facts, p.select("chunk", "document", "page"), p.select("document", "page", "text"))


@query("join_05_verdict_lines", "SELECT id, '- Claim ' || id || ': ' || coalesce(text, '') || ' => ' || verdict || ' | ref: ' || record_reference AS line FROM verifications v LEFT JOIN claims c USING (id)", V, C)
def join_05_verdict_lines(spark, sf):
    v = tables.verifications(spark, sf).join(tables.claims(spark, sf).select("id", "text"), "id", "left")
    return v.select("id", F.concat(F.lit("- Claim "), "id", F.lit(": "), F.coalesce("text", F.lit("")), F.lit(" => "), "verdict", F.lit(" | ref: "), "record_reference").alias("line"))


@query("flt_14_downgrades", "SELECT id, CASE WHEN verdict <> 'CONTRADICTED' THEN '' WHEN id % 7 = 0 THEN 'no matching record text' WHEN trim(record_reference) = '' THEN 'no entry cited' ELSE '' END AS reason FROM verifications", V)
def flt_14_downgrades(spark, sf):
    absent = F.col("id") % 7 == 0
    return tables.verifications(spark, sf).select("id", F.when(F.col("verdict") != "CONTRADICTED", "").when(absent, "no matching record text").when(F.trim("record_reference") == "", "no entry cited").otherwise("").alias("reason"))


_WITNESS, _PATIENT = (x.replace("'", "''") for x in (review.WITNESS, review.PATIENT))


@query(
    "flt_14_contradictions",
    f"""SELECT id, CASE WHEN id % 5 > 2 AND verdict <> 'CONTRADICTED' THEN '' WHEN k IS NULL THEN 'no matching record text' WHEN trim(record_reference) = '' THEN 'no entry cited'
      WHEN regexp_matches(claim, '{_WITNESS}') AND regexp_matches(note, '{_PATIENT}') THEN 'names the patient only' ELSE '' END AS reason FROM (
        SELECT v.*, k, CASE id % 3 WHEN 0 THEN 'My  name is Al' WHEN 1 THEN 'The writer''s name is Al' ELSE 'He fell' END AS claim,
          CASE id % 4 WHEN 0 THEN 'The Veteran is Bo' || chr(10) || 'not Al' WHEN 1 THEN 'The patient is Bo, whereas Al wrote' WHEN 2 THEN 'It identifies the veteran/patient as Bo' END AS note
        FROM verifications v LEFT JOIN (SELECT DISTINCT doc_id AS k FROM documents WHERE contains(text, 'ing ')) ON k = id)""",
    V,
)
def flt_14_contradictions(spark, sf):
    """Record text for a claim is a document with a word in ing; witnesses, patients and notes by id."""
    i = F.col("id")
    held = tables.table(spark, sf, "documents").where(F.contains("text", F.lit("ing "))).select(F.col("doc_id").alias("k")).distinct()
    v = tables.verifications(spark, sf).join(held, F.col("k") == i, "left")
    claim = F.when(i % 3 == 0, "My  name is Al").when(i % 3 == 1, "The writer's name is Al").otherwise("He fell")
    note = F.when(i % 4 == 0, "The Veteran is Bo\nnot Al").when(i % 4 == 1, "The patient is Bo, whereas Al wrote").when(i % 4 == 2, "It identifies the veteran/patient as Bo")
    return v.select("id", review.downgrade(F.when(i % 5 < 3, "Contradicted").otherwise(F.col("verdict")), F.col("k").isNull(), F.col("record_reference"), claim, note).alias("reason"))


@query("agg_03_providers", r"SELECT DISTINCT case_id, source AS provider FROM verifications v JOIN documents d ON d.doc_id = v.id WHERE NOT regexp_matches(source, '(?i)\b[pb]\.\d')", V)
def agg_03_providers(spark, sf):
    v = tables.verifications(spark, sf)
    return v.select("case_id", F.col("case_id").alias("provider")).where(~F.col("provider").rlike(r"(?i)\b[pb]\.\d")).distinct()


@query(
    "agg_14_top_conditions",
    "SELECT condition, n FROM (SELECT description AS condition, count(*) AS n, min(seq) AS f FROM facts GROUP BY 1 ORDER BY n DESC, f LIMIT 40) WHERE trim(condition) <> ''",
    F_,
)
def agg_14_top_conditions(spark, sf):
    top = tables.facts(spark, sf).groupBy(F.col("description").alias("condition")).agg(F.count("*").alias("n"), F.min("seq").alias("f")).orderBy(F.desc("n"), "f").limit(40)
    return top.where(F.trim("condition") != "").select("condition", "n")


@query("agg_24_year_span", r"SELECT case_id, min(y) AS low, max(y) AS high, count(DISTINCT seq) AS n FROM (SELECT case_id, seq, unnest(regexp_extract_all(date, '\b(19|20)\d{2}\b')) AS y FROM facts) GROUP BY 1", F_)
def agg_24_year_span(spark, sf):
    f = tables.facts(spark, sf).select("case_id", "seq", F.explode(F.regexp_extract_all("date", F.lit(r"\b(19|20)\d{2}\b"), F.lit(0))).alias("y"))
    return f.groupBy("case_id").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.countDistinct("seq").alias("n"))


QUERIES, SQL = query.queries, query.sql
