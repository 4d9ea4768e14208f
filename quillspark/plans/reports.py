"""Oversized paragraphs, highlights, mentions, printed dates, sections, reports and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import reporting
from quillspark.plans.registry import Registry
from quillspark.sources import tables

query = Registry()
F_, P = tables.FACTS_SQL, tables.PARAGRAPHS_SQL


@query("txt_10_grouped_lines")
def txt_10_grouped_lines(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", F.posexplode(reporting.grouped_lines(F.col("text"))).alias("part", "text"))
    return d.select("doc_id", "part", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))


_EDGE = r"[^\p{L}\p{N}_*]"


@query("txt_12_highlighted", rf"SELECT para_seq, regexp_replace(regexp_replace(text, '(?i)(^|{_EDGE.replace('*', '')})(the)($|{_EDGE.replace('*', '')})', '\1**\2**\3', 'g'), '(?i)(^|{_EDGE})(the)($|{_EDGE})', '\1**\2**\3', 'g') AS text FROM paragraphs", P)
@query("txt_12_all_highlighted")
def txt_12_all_highlighted(spark, sf):
    return tables.paragraphs(spark, sf).select("para_seq", reporting.highlighted(F.col("text"), ["the", "a"]).alias("text"))


@query("txt_17_exports", "SELECT doc_id, regexp_matches(substr(text, 1, 8000), '\\bthe\\b') AND (regexp_matches(substr(text, 1, 8000), '\\bof\\b') OR source = 'src1') AS export FROM documents")
def txt_17_exports(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", reporting.is_export(F.substring("text", 1, 8000), F.col("source"), r"\bthe\b", r"\bof\b", "^src1$").alias("export"))


@query("flt_08_visible", "SELECT doc_id, doc_id % 3 <> 0 AS visible FROM documents")
def flt_08_visible(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.lit(" ​\n")).otherwise(F.concat(F.lit("x"), "text"))
    return tables.table(spark, sf, "documents").select("doc_id", reporting.visible(t).alias("visible"))


@query("join_10_mentions", "SELECT c AS condition, count(f.seq) AS n FROM (VALUES ('status F near 5'), ('near status'), ('nothing of it')) v(c) LEFT JOIN facts f ON contains(lower(description), lower(c)) OR (c <> 'nothing of it' AND contains(description, 'near') AND contains(description, 'status')) GROUP BY 1", F_)
def join_10_mentions(spark, sf):
    c = spark.createDataFrame([("status F near 5",), ("near status",), ("nothing of it",)], "condition string")
    return reporting.mentions(c, tables.facts(spark, sf).select(F.col("description").alias("text")))


@query("dat_04_printed_dates", "SELECT seq, CASE WHEN date = 'unknown' THEN 0 ELSE 1 END AS n FROM facts", F_)
def dat_04_printed_dates(spark, sf):
    return tables.facts(spark, sf).select("seq", F.size(reporting.printed_dates(F.concat_ws(" ", "date", "date"))).alias("n"))


@query("src_24_sections", "SELECT doc_id, 2 AS n, 'A' AS letter, 'title ' || doc_id AS title FROM documents")
def src_24_sections(spark, sf):
    t = F.concat(F.lit("intro\n## A. title "), "doc_id", F.lit("\nbody ## no\n## B. next\nmore\n"))
    s = tables.table(spark, sf, "documents").select("doc_id", reporting.sections(t).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.col("s")[0]["letter"].alias("letter"), F.col("s")[0]["title"].alias("title"))


@query("snk_03_report", "SELECT case_id, '## Case ' || case_id || chr(10) || chr(10) || string_agg('- [' || date || '] (' || type || ') ' || description || ' — ' || source, chr(10) ORDER BY seq) AS text FROM facts GROUP BY 1", F_)
def snk_03_report(spark, sf):
    line = F.concat(F.lit("- ["), "date", F.lit("] ("), "type", F.lit(") "), "description", F.lit(" — "), "source")
    return reporting.report(tables.facts(spark, sf), "case_id", "seq", line, F.concat(F.lit("Case "), "case_id"))


@query("str_09_ledger")
def str_09_ledger(spark, sf):
    k = F.col("event_type")
    kind = F.when(k == "signup", "reserve").when(k.isin("view", "click"), "attempt").when(k == "purchase", "finish").otherwise("reserve")
    e = tables.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), F.floor("value").alias("amount"))
    return reporting.ledger(e, 500)


#: What becomes of a text in eight ways.
_HEAD, _TAIL = "# Head\n[Confirm  date] Intro line\n**Facts:**\n", "\n\n3. Wishes\nnone\nClosing\nI hereby certify\tthis.\n[Name]"


def _rejections(documents):
    before, k = F.concat(F.lit(_HEAD), "text", F.lit(_TAIL)), F.col("doc_id") % 8
    after = (
        F.when(k == 0, F.replace(before, F.lit("[Confirm  date]"), F.lit("May")))
        .when(k == 1, F.replace(before, F.lit("**Facts:**"), F.lit("Facts")))
        .when(k == 2, F.replace(before, F.lit("\nnone\n"), F.lit("\n")))
        .when(k == 3, F.concat(before, F.lit(" more")))
        .when(k == 4, F.replace(before, F.lit("Intro line"), F.lit("Intro lines")))
        .when(k == 5, F.concat(F.substring(before, 1, 150), F.repeat(F.lit("\n"), F.lit(500))))
        .when(k == 6, F.replace(F.replace(before, F.lit("  date]"), F.lit(" date]")), F.lit("\n\n"), F.lit(" \r\n")))
    )
    return documents.select("doc_id", reporting.rejected(before, after).alias("reason"))


_W = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _text_sql(s):
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '") + "'"


def _plain_sql(x):
    return rf"regexp_replace(regexp_replace({x}, '{_W}+', ' ', 'g'), '^ +| +$', '', 'g')"


def _lines_sql(x):
    """Lines without blank ones, and the label of each that is a heading."""
    lines = rf"list_filter(list_transform(string_split_regex({x}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: regexp_replace(l, '^{_W}+|{_W}+$', '', 'g')), lambda l: l <> '')"
    name = "lower(" + _plain_sql(r"regexp_replace(regexp_replace(l, '^(?:#{1,6}\s+|\d+[.)]\s+)', ''), '^[*_#: ]+|[*_#: ]+$', '', 'g')") + ")"
    known = ", ".join(f"'{h}'" for h in reporting.PLAIN_HEADINGS)
    return rf"list_transform({lines}, lambda l: CASE WHEN {name} <> '' AND (l[1] = '#' OR (l[1:2] = '**' AND regexp_matches(l, '\*\*:*$')) OR (regexp_matches(l, '^\d+[.)]\s+') AND length({name}) <= 120) OR {name} IN ({known})) THEN {name} END)"


def _lost_sql(a, b):
    return f"len(list_filter(list_distinct({a}), lambda p: len(list_filter({a}, lambda x: x = p)) > len(list_filter({b}, lambda x: x = p)))) > 0"


def _held_sql(x):
    return rf"list_transform(regexp_extract_all({x}, '\[[^\[\]]+\]'), lambda h: {_plain_sql('h')})"


def _filled_sql(x):
    return f"list_filter(list_transform({x}, lambda y, i: CASE WHEN i < len({x}) AND {x}[i + 1] IS NULL THEN y END), lambda y: y IS NOT NULL)"


_REJECTED = rf"""SELECT doc_id, CASE WHEN after IS NULL THEN 'no statement' WHEN length(regexp_replace(after, '^{_W}+|{_W}+$', '', 'g')) <= greatest(200, floor(length(before) * 0.4)) THEN 'too short'
    WHEN {_lost_sql('hb', 'ha')} THEN 'placeholder lost' WHEN {_lost_sql('list_filter(lb, lambda y: y IS NOT NULL)', 'list_filter(la, lambda y: y IS NOT NULL)')} THEN 'heading lost'
    WHEN {_lost_sql(_filled_sql('lb'), _filled_sql('la'))} THEN 'section emptied'
    WHEN NOT suffix(pa, {_plain_sql("regexp_extract(before, '(?is)\\bI\\s+(?:(?:hereby|solemnly)\\s+)?(?:certify|declare|affirm|attest)\\b.*')")}) THEN 'closing changed'
    WHEN pa <> {_plain_sql('before')} THEN 'text changed' ELSE '' END AS reason
  FROM (SELECT *, {_held_sql('before')} AS hb, {_held_sql('after')} AS ha, {_lines_sql('before')} AS lb, {_lines_sql('after')} AS la, {_plain_sql('after')} AS pa FROM (
    SELECT doc_id, before, CASE doc_id % 8 WHEN 0 THEN replace(before, '[Confirm  date]', 'May') WHEN 1 THEN replace(before, '**Facts:**', 'Facts') WHEN 2 THEN replace(before, {_text_sql(chr(10) + 'none' + chr(10))}, chr(10))
      WHEN 3 THEN before || ' more' WHEN 4 THEN replace(before, 'Intro line', 'Intro lines') WHEN 5 THEN before[1:150] || repeat(chr(10), 500) WHEN 6 THEN replace(replace(before, '  date]', ' date]'), chr(10) || chr(10), ' ' || chr(13) || chr(10)) END AS after
    FROM (SELECT doc_id, {_text_sql(_HEAD)} || text || {_text_sql(_TAIL)} AS before FROM documents)))"""


@query("pred_06_rejections", _REJECTED)
@query("pred_06_all_rejections", _REJECTED)
def pred_06_all_rejections(spark, sf):
    return _rejections(tables.table(spark, sf, "documents"))


QUERIES, SQL = query.queries, query.sql
