"""Usage, latencies, histograms, intervals, retention and leases."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import intervals
from quillspark.operators import operations as ops
from quillspark.plans.registry import Registry
from quillspark.sources import tables

query = Registry()
U = tables.USAGE_SQL


@query("agg_15_usage_by_phase", "SELECT phase, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion, min(seq) AS first FROM usage GROUP BY 1", U)
def agg_15_usage_by_phase(spark, sf):
    return tables.usage(spark, sf).groupBy("phase").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"), F.min("seq").alias("first"))


@query("agg_15_usage_rollup", "SELECT coalesce(model, 'all') AS model, coalesce(phase, 'all') AS phase, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens FROM usage GROUP BY ROLLUP (model, phase)", U)
def agg_15_usage_rollup(spark, sf):
    r = tables.usage(spark, sf).rollup("model", "phase").agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    return r.select(F.coalesce("model", F.lit("all")).alias("model"), F.coalesce("phase", F.lit("all")).alias("phase"), "calls", "tokens")


@query("agg_15_usage_by_role", "SELECT CASE WHEN phase IN ('view', 'click') THEN 'fast' ELSE 'main' END AS role, CAST(sum(prompt_tokens) AS BIGINT) AS prompt FROM usage GROUP BY 1", U)
def agg_15_usage_by_role(spark, sf):
    return tables.usage(spark, sf).groupBy(F.when(F.col("phase").isin("view", "click"), "fast").otherwise("main").alias("role")).agg(F.sum("prompt_tokens").alias("prompt"))


@query("agg_16_token_estimates", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def agg_16_token_estimates(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", ops.estimated_tokens(F.length("text")).alias("tokens"))


@query("agg_17_credits", "SELECT phase, CASE WHEN count(*) FILTER (model = 'm2' AND phase = 'error') > 0 THEN NULL ELSE round(sum((prompt_tokens + completion_tokens) / 1000000.0::DOUBLE * CASE model WHEN 'm0' THEN 3.0::DOUBLE ELSE 15.0::DOUBLE END), 6) END AS credits FROM usage GROUP BY 1", U)
def agg_17_credits(spark, sf):
    rate = F.when((F.col("model") == "m2") & (F.col("phase") == "error"), F.lit(None)).when(F.col("model") == "m0", 3.0).otherwise(15.0)
    u = tables.usage(spark, sf).withColumn("rate", rate)
    total = F.round(F.sum((F.col("prompt_tokens") + F.col("completion_tokens")) / F.lit(1e6) * F.col("rate")), 6)
    return u.groupBy("phase").agg(F.when(F.count_if(F.col("rate").isNull()) == 0, total).alias("credits"))


@query("agg_18_percentiles", "SELECT phase, v[least(CAST(floor(n * 0.5) AS INTEGER), n - 1) + 1] AS p50, v[least(CAST(floor(n * 0.95) AS INTEGER), n - 1) + 1] AS p95, v[least(CAST(floor(n * 0.99) AS INTEGER), n - 1) + 1] AS p99, CAST(n AS BIGINT) AS n, v[n] AS max FROM (SELECT phase, list_sort(list(value)) AS v, CAST(count(value) AS INTEGER) AS n FROM usage GROUP BY 1)", U)
def agg_18_percentiles(spark, sf):
    return ops.ranks(tables.usage(spark, sf), "phase", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("agg_18_supplier_percentiles", "SELECT l_suppkey, list_sort(list(l_extendedprice))[least(CAST(floor(count(*) * 0.95) AS INTEGER), CAST(count(*) AS INTEGER) - 1) + 1] AS p95 FROM lineitem GROUP BY 1")
def agg_18_supplier_percentiles(spark, sf):
    return ops.ranks(tables.table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", {"p95": 0.95}).select("l_suppkey", "p95")


_BUCKETS = " UNION ALL ".join(f"SELECT phase, '{b}' AS le, count(*) FILTER (greatest(value * 10, 0) <= {b}) AS n FROM usage GROUP BY 1" for b in ops.SHORT_MS)


@query("agg_19_histogram", f"{_BUCKETS} UNION ALL SELECT phase, '+Inf', count(*) FROM usage GROUP BY 1", U)
def agg_19_histogram(spark, sf):
    return ops.histogram(tables.usage(spark, sf), ["phase"], F.col("value") * 10, ops.SHORT_MS)


@query("agg_20_admitted_series", "SELECT user_id, count(*) AS n, dense_rank() OVER (ORDER BY min(event_id)) <= 100 AS admitted FROM events GROUP BY 1")
def agg_20_admitted_series(spark, sf):
    return ops.admitted(tables.table(spark, sf, "events"), "user_id", "event_id", 100)


@query("agg_21_exposition", "SELECT 'calls_total{phase=\"' || phase || '\"} ' || count(*) AS line FROM usage GROUP BY phase", U)
def agg_21_exposition(spark, sf):
    c = tables.usage(spark, sf).groupBy("phase").agg(F.count("*").alias("n"))
    return c.select(F.format_string('calls_total{phase="%s"} %d', "phase", "n").alias("line"))


@query(
    "agg_21_usage_exposition",
    """SELECT 0 AS part, '# HELP tokens_total Tokens of prompts, by "phase" \\\\ model' AS line UNION ALL SELECT 1, '# TYPE tokens_total counter' UNION ALL
    SELECT 2, 'tokens_total{model="' || model || '\\"\\\\",phase="' || phase || '\\n"} ' || CAST(sum(prompt_tokens) AS BIGINT) FROM usage GROUP BY model, phase""",
    U,
)
def agg_21_usage_exposition(spark, sf):
    u = tables.usage(spark, sf).select(F.concat("phase", F.lit("\n")).alias("phase"), F.concat("model", F.lit('"\\')).alias("model"), "prompt_tokens")
    return ops.exposition(u.groupBy("phase", "model").agg(F.sum("prompt_tokens").alias("n")), "tokens_total", "counter", 'Tokens of prompts, by "phase" \\ model', ["phase", "model"], "n")


@query("agg_22_counter_increases", "SELECT user_id, CAST(sum(CASE WHEN b IS NULL THEN 0 WHEN v < b THEN v ELSE v - b END) AS BIGINT) AS increase FROM (SELECT user_id, event_id % 50 AS v, lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1")
def agg_22_counter_increases(spark, sf):
    e = tables.table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_id") % 50).alias("v"))
    return ops.rates(e, ["user_id"], "at", "v").groupBy("user_id").agg(F.sum("increase").alias("increase"))


@query(
    "agg_22_range_functions",
    """SELECT user_id, secs, v, CAST(coalesce(sum(s) OVER w, 0) - coalesce(first_value(s) OVER w, 0) AS BIGINT) AS increase, CAST(coalesce(sum(t) OVER w, 0) - coalesce(first_value(t) OVER w, 0) AS BIGINT) AS changes, max(v) OVER w AS max_over_time,
      (coalesce(sum(s) OVER w, 0) - coalesce(first_value(s) OVER w, 0)) / 86400.0::DOUBLE AS rate
    FROM (SELECT *, CASE WHEN v < b THEN v ELSE v - b END AS s, CASE WHEN v <> b THEN 1 WHEN v = b THEN 0 END AS t FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY secs) AS b FROM (
      SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs, max(event_id % 50) AS v FROM events GROUP BY 1, 2)))
    WINDOW w AS (PARTITION BY user_id ORDER BY secs RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)""",
)
def agg_22_range_functions(spark, sf):
    """Increase, changes, maximum and rate of a counter over the day before each reading."""
    e = tables.table(spark, sf, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("secs"), (F.col("event_id") % 50).alias("v"))
    return ops.over_range(e, ["user_id"], "secs", "v", 86_400)


_LE = (1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0)


@query(
    "agg_22_histogram_quantile",
    f"""SELECT phase, share, round(min(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (n * share - under) / (c - under) END), 9) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY phase, share ORDER BY le) AS k FROM (SELECT *, lag(le) OVER o AS low, coalesce(lag(c) OVER o, 0) AS under, max(c) OVER (PARTITION BY phase) AS n
        FROM (SELECT phase, le, count(*) FILTER (completion_tokens <= le) AS c FROM usage, (VALUES {", ".join(f"({x}::DOUBLE)" for x in _LE)}, ('inf'::DOUBLE)) l(le) GROUP BY 1, 2) WINDOW o AS (PARTITION BY phase ORDER BY le)),
        (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.01::DOUBLE)) q(share) WHERE c >= n * share) WHERE k = 1 GROUP BY 1, 2""",
    U,
)
def agg_22_histogram_quantile(spark, sf):
    u = tables.usage(spark, sf).select("phase", F.explode(F.filter(F.array(*map(F.lit, _LE), F.lit(float("inf"))), lambda x: F.col("completion_tokens") <= x)).alias("le"))
    buckets = u.groupBy("phase", "le").agg(F.count("*").alias("count"))
    every = buckets.select("phase").distinct().select("phase", F.explode(F.array(*map(F.lit, _LE), F.lit(float("inf")))).alias("le")).join(buckets, ["phase", "le"], "left").fillna({"count": 0})
    found = [ops.histogram_quantile(every, ["phase"], q).select("phase", F.lit(q).alias("share"), F.round("value", 9).alias("value")) for q in (0.5, 0.95, 0.01)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "join_15_tokens_of_intervals",
    """SELECT s_suppkey, count(*) AS n, CAST(sum(completion_tokens) AS BIGINT) AS tokens FROM usage JOIN (SELECT s_suppkey, (s_suppkey * 97) % 9000 - 100 AS low, (s_suppkey * 97) % 9000 - 100 + CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 5000 ELSE s_nationkey * 40 + 3 END AS high FROM supplier) ON seq >= low AND seq < high GROUP BY 1""",
    U,
)
def join_15_tokens_of_intervals(spark, sf):
    """Intervals of one step to thousands, that overlap, hold none or begin below all."""
    low, k = (F.col("s_suppkey") * 97) % 9000 - 100, F.col("s_suppkey") % 5
    s = tables.table(spark, sf, "supplier").select("s_suppkey", low.alias("low"), (low + F.when(k == 0, 1).when(k == 1, 0).when(k == 2, 5000).otherwise(F.col("s_nationkey") * 40 + 3)).alias("high"))
    met = intervals.points_in(tables.usage(spark, sf).select("seq", "completion_tokens"), s, at="seq")
    return met.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("completion_tokens").alias("tokens"))


_BACKUP = """backups AS (SELECT event_id AS id, user_id AS file, CASE WHEN (event_id // 2000) % 2 = 0 THEN 'a1' ELSE 'b2' END AS generation, (event_id * 7) % 1000 AS start, 20 + CAST(floor(value) AS BIGINT) % 60 AS n, event_id % 17 <> 0 AS fits FROM events)"""


def _backups(spark, sf):
    """Windows of files' bytes, of which some don't fit their key."""
    e, start = tables.table(spark, sf, "events"), (F.col("event_id") * 7) % 1000
    n = 20 + F.floor("value").cast("long") % 60
    content = F.encode(F.substring(F.repeat(F.concat(F.col("event_id").cast("string"), F.lit("|")), F.lit(80)), F.lit(1), n.cast("int")), "UTF-8")
    sha = F.when(F.col("event_id") % 17 == 0, "0123456789ab").otherwise(F.substring(F.sha2(content, 256), 1, 12))
    tag = F.when(F.floor(F.col("event_id") / 2000) % 2 == 0, "a1").otherwise("b2")
    key = F.concat(F.lit("audit/2024/01/30/live-user_"), "user_id", F.lit("-g"), tag, F.lit("-"), start, F.lit("-"), start + n, F.lit("-"), sha, F.lit(".jsonl"))
    return e.select(F.col("event_id").alias("id"), key.alias("key"), F.col("event_id").alias("uploaded"), content.alias("content"))


@query(
    "str_02_restored_bytes",
    """SELECT file, island, count(*) AS n, sha256(string_agg(c, '' ORDER BY b)) AS sha FROM (
      SELECT 'user_' || file AS file, CAST(island AS BIGINT) AS island, b, arg_max((repeat(id || '|', 80))[b - start + 1], id) AS c FROM (
        SELECT *, unnest(range(start, start + n)) AS b FROM (SELECT *, sum(t) OVER (PARTITION BY file ORDER BY id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM (
          SELECT *, CASE WHEN lag(generation) OVER (PARTITION BY file ORDER BY id) = generation THEN 0 ELSE 1 END AS t FROM backups WHERE fits))) GROUP BY ALL) GROUP BY 1, 2""",
    _BACKUP,
)
def str_02_restored_bytes(spark, sf):
    pieces, _ = intervals.restored(_backups(spark, sf), cell=256)
    each = F.transform(F.array_sort(F.collect_list(F.struct("start", "data"))), lambda x: x["data"].cast("string"))
    return pieces.groupBy("file", "island").agg(F.sum(F.length("data")).alias("n"), F.sha2(F.array_join(each, ""), 256).alias("sha")).withColumn("island", F.col("island").cast("long"))


@query(
    "str_02_restore_report",
    """SELECT 'user_' || file AS file, count(*) AS windows, count(*) FILTER (NOT fits) AS damaged, CAST(sum(gone) AS BIGINT) AS superseded FROM (SELECT file, fits, CASE WHEN fits AND NOT EXISTS (
      SELECT 1 FROM (SELECT unnest(range(a.start, a.start + a.n)) AS b) x WHERE NOT EXISTS (SELECT 1 FROM isl y WHERE y.file = a.file AND y.island = a.island AND y.id > a.id AND x.b >= y.start AND x.b < y.start + y.n)) THEN 1 ELSE 0 END AS gone
      FROM (SELECT b.*, i.island FROM backups b LEFT JOIN isl i USING (id)) a) GROUP BY 1""",
    _BACKUP,
    "isl AS (SELECT *, sum(t) OVER (PARTITION BY file ORDER BY id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM (SELECT *, CASE WHEN lag(generation) OVER (PARTITION BY file ORDER BY id) = generation THEN 0 ELSE 1 END AS t FROM backups WHERE fits))",
)
def str_02_restore_report(spark, sf):
    return intervals.restored(_backups(spark, sf))[1].select("file", "windows", "damaged", "superseded")


@query(
    "agg_23_least_squares",
    """SELECT round(CASE WHEN det > 1e-12 AND a >= 0 AND b >= 0 THEN a END, 6) AS a, round(CASE WHEN det > 1e-12 AND a >= 0 AND b >= 0 THEN b END, 6) AS b FROM (
      SELECT det, (xy * zz - zy * xz) / det AS a, (zy * xx - xy * xz) / det AS b FROM (SELECT *, xx * zz - xz * xz AS det FROM (
        SELECT sum(p * p) AS xx, sum(c * c) AS zz, sum(p * c) AS xz, sum(p * y) AS xy, sum(c * y) AS zy FROM (SELECT prompt_tokens::DOUBLE AS p, completion_tokens::DOUBLE AS c, prompt_tokens * 2 + completion_tokens * 3::DOUBLE AS y FROM usage))))""",
    U,
)
def agg_23_least_squares(spark, sf):
    u = tables.usage(spark, sf).select(F.col("prompt_tokens").cast("double").alias("p"), F.col("completion_tokens").cast("double").alias("c"))
    return ops.least_squares(u.withColumn("y", F.col("p") * 2 + F.col("c") * 3), "p", "c", "y").select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


_WIN = """windows AS (SELECT user_id AS file, event_id AS seq, (event_id // 2000) % 2 AS generation, (event_id * 7) % 1000 AS start, (event_id * 7) % 1000 + 20 + CAST(floor(value) AS BIGINT) % 60 AS "end" FROM events)"""


def _windows(spark, sf):
    e, s = tables.table(spark, sf, "events"), (F.col("event_id") * 7) % 1000
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), (F.floor(F.col("event_id") / 2000) % 2).alias("generation"), s.alias("start"), (s + 20 + F.floor("value").cast("long") % 60).alias("end"))


_COVER = """, isl AS (SELECT *, sum(t) OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(generation) OVER (PARTITION BY file ORDER BY seq) = generation THEN 0 ELSE 1 END AS t FROM windows)),
  gap AS (SELECT *, greatest(start - coalesce(max("end") OVER (PARTITION BY file, island ORDER BY start, "end", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start), 0) AS gap FROM isl)"""


@query("win_08_interval_coverage", 'SELECT file, CAST(island AS BIGINT) AS island, min(start) AS low, max("end") AS high, CAST(sum(gap) AS BIGINT) AS missing, count(*) FILTER (gap > 0) AS holes, CAST(max("end") - min(start) - sum(gap) AS BIGINT) AS held FROM gap GROUP BY ALL', _WIN + _COVER)
def win_08_interval_coverage(spark, sf):
    return ops.coverage(_windows(spark, sf))


@query("agg_28_missing_bytes", "SELECT file, CAST(sum(gap) AS BIGINT) AS missing FROM gap GROUP BY 1", _WIN + _COVER)
def agg_28_missing_bytes(spark, sf):
    return ops.coverage(_windows(spark, sf)).groupBy("file").agg(F.sum("missing").alias("missing"))


@query("str_03_active_sessions", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 300 SECOND")
def str_03_active_sessions(spark, sf):
    return ops.active(tables.table(spark, sf, "events"), "user_id", "ts", "2024-01-30 00:00:00", 300)


@query("str_10_retention", "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY GROUP BY 1")
def str_10_retention(spark, sf):
    old = F.col("ts") < F.lit("2024-01-30 00:00:00").cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    return tables.table(spark, sf, "events").where(old).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "win_09_start_limits",
    """SELECT event_id, h AS in_hour, d AS in_day, h < 2 AND d < 5 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS h,
      count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS d FROM events)""",
)
def win_09_start_limits(spark, sf):
    return ops.within_limits(tables.table(spark, sf, "events"), "user_id", "ts", 2, 5).select("event_id", "in_hour", "in_day", "allowed")


@query("join_14_orphan_blobs", "SELECT p_partkey AS key FROM part WHERE p_size > 10 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_14_orphan_blobs(spark, sf):
    kept = tables.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    return tables.table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("key")).join(kept, "key", "left_anti")


@query(
    "join_15_interval_tokens",
    """SELECT k AS bucket, CAST(sum(prompt_tokens) AS BIGINT) AS prompt FROM usage JOIN (SELECT k, first - 1 + k * 500 AS low, first + 499 + k * 500 AS high FROM (
      SELECT first, unnest(range((last - first) // 500 + 1)) AS k FROM (SELECT min(seq) AS first, max(seq) AS last FROM usage))) b ON seq > low AND seq <= high GROUP BY 1""",
    U,
)
@query(
    "join_15_all_interval_tokens",
    """SELECT k AS bucket, CAST(sum(prompt_tokens) AS BIGINT) AS prompt FROM usage JOIN (SELECT k, first - 1 + k * 500 AS low, first + 499 + k * 500 AS high FROM (
      SELECT first, unnest(range((last - first) // 500 + 1)) AS k FROM (SELECT min(seq) AS first, max(seq) AS last FROM usage))) b ON seq > low AND seq <= high GROUP BY 1""",
    U,
)
def join_15_all_interval_tokens(spark, sf):
    # The intervals start at the table's own first seq and go on to its last.
    u = tables.usage(spark, sf)
    from_first = u.crossJoin(F.broadcast(u.agg(F.min("seq").alias("first")))).withColumn("bucket", F.floor((F.col("seq") - F.col("first")) / 500))
    return from_first.groupBy("bucket").agg(F.sum("prompt_tokens").alias("prompt"))


@query(
    "join_17_completeness",
    "SELECT s.source AS source, l.lang AS lang, count(d.doc_id) AS n FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lang FROM documents) l LEFT JOIN documents d ON d.source = s.source AND d.lang = l.lang GROUP BY 1, 2 HAVING count(d.doc_id) < 6",
)
def join_17_completeness(spark, sf):
    d = tables.table(spark, sf, "documents")
    have = d.groupBy("source", "lang").agg(F.count("*").alias("n"))
    # The expected grid is of two small dimensions, taken from the counts and not from the rows.
    grid = have.select("source").distinct().crossJoin(have.select("lang").distinct())
    return grid.join(have, ["source", "lang"], "left").select("source", "lang", F.coalesce("n", F.lit(0)).alias("n")).where("n < 6")


def _jobs(spark, sf):
    k = F.col("event_type")
    kind = F.when(k == "signup", "claim").when(k == "view", "beat").when(k == "purchase", "done").when(k == "error", "fail").otherwise("release")
    return tables.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), kind.alias("kind"))


@query("str_04_leases")
def str_04_leases(spark, sf):
    return ops.leases(_jobs(spark, sf), lease_s=36_000)


@query("str_06_breaker")
def str_06_breaker(spark, sf):
    e = tables.table(spark, sf, "events")
    return ops.breaker(e.select((F.col("user_id") % 50).alias("endpoint"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok")), recover_s=7200.0)


@query("str_07_spaced")
def str_07_spaced(spark, sf):
    e = tables.table(spark, sf, "events")
    return ops.spaced(e.select((F.col("user_id") % 20).alias("gate"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1.7e9).alias("at")), 600.0, 1200.0)


@query(
    "rnk_05_fitting",
    None,
)
def rnk_05_fitting(spark, sf):
    d = tables.table(spark, sf, "documents")
    return ops.fitting(d, "source", "doc_id", "n_chars", 20_000, 20).select("source", "used", F.array_join(F.transform("taken", lambda k: k.cast("string")), ",").alias("taken"))


@query("src_16_recent_events", "SELECT event_id, event_type FROM (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50) ORDER BY event_id")
def src_16_recent_events(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(50).orderBy("event_id")


@query("flt_11_lookup", "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY event_id DESC LIMIT 50")
def flt_11_lookup(spark, sf):
    return tables.table(spark, sf, "events").where("user_id = 7").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(50)


@query("src_12_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def src_12_json_fields(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("join_16_currency_flags", "SELECT n_nationkey AS topic, coalesce(v.verdict, 'unclear') AS verdict FROM nation LEFT JOIN (SELECT n_nationkey AS k, 'current' AS verdict FROM nation WHERE n_nationkey % 3 = 0) v ON k = n_nationkey")
def join_16_currency_flags(spark, sf):
    n = tables.table(spark, sf, "nation")
    v = n.where("n_nationkey % 3 = 0").select("n_nationkey", F.lit("current").alias("verdict"))
    return n.join(v, "n_nationkey", "left").select(F.col("n_nationkey").alias("topic"), F.coalesce("verdict", F.lit("unclear")).alias("verdict"))


@query("dat_08_freshness", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'never_checked' WHEN o_orderstatus = 'P' THEN 'framework_changed' WHEN o_orderdate < DATE '1998-01-01' THEN 'expired' ELSE 'fresh' END AS state FROM orders")
def dat_08_freshness(spark, sf):
    o = tables.table(spark, sf, "orders")
    state = F.when(F.col("o_orderkey") % 9 == 0, "never_checked").when(F.col("o_orderstatus") == "P", "framework_changed").when(F.col("o_orderdate") < "1998-01-01", "expired").otherwise("fresh")
    return o.select("o_orderkey", state.alias("state"))


QUERIES, SQL = query.queries, query.sql
