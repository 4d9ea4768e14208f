"""Reports on runs: usage, latencies, histograms, regression, intervals, retention, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.replay import State, replayed

#: Bounds of the two latency histograms, in milliseconds.
SHORT_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)


def estimated_tokens(chars: Column) -> Column:
    """A token for every four characters begun; none for an empty text."""
    return F.ceil(chars / 4).cast("long")


def nearest_rank(values: Column, p: float) -> Column:
    """The value at index floor(n * p) of all in order, at most the last. For groups that fit a task; see ranks()."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, F.least(F.floor(F.size(ordered) * F.lit(p)).cast("int") + 1, F.size(ordered)))


#: Equal steps of value in which ranks() looks for a percentile.
BINS = 4096


def ranks(rows: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """group, a column for each point (nearest-rank percentiles, exact at any size), n and max.

    Rows are counted in BINS equal steps between the least and the greatest value of their
    group; the counts, at most BINS + 1 a group, tell in which step a point's rank lies, and the
    values of these steps alone are put in order. Nulls and NaN don't count."""
    v = rows.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    span = v.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_all"))
    low, high = (F.col(c).cast("double") for c in ("_low", "_high"))
    step = F.floor((F.col("_v").cast("double") - low) / (high - low) * BINS)
    s = span.withColumnRenamed("_g", "_h")
    # No broadcast is asked for: groups may be many. Spark sees their size, and splits hot ones.
    binned = v.join(s, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_v", "_all", F.when(low == high, F.lit(0)).otherwise(step).cast("long").alias("_bin"))
    counts = binned.groupBy("_g", "_bin", "_all").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = [F.struct(F.lit(k).alias("point"), (F.least(F.floor(F.col("_all") * F.lit(p)), F.col("_all") - 1) + 1).alias("rank")) for k, p in points.items()]
    placed = counts.withColumn("_before", before).select("*", F.explode(F.array(*at)).alias("_at"))
    wanted = placed.where((F.col("_at.rank") > F.col("_before")) & (F.col("_at.rank") <= F.col("_before") + F.col("_n")))
    wanted = wanted.select(F.col("_g").alias("_h"), F.col("_bin").alias("_b"), F.col("_at.point").alias("_point"), (F.col("_at.rank") - F.col("_before")).alias("_rest"))
    same = F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_bin") == F.col("_b"))
    inside = binned.join(wanted, same, "left_semi").groupBy("_g", "_bin", "_v").agg(F.count("*").alias("_n"))
    upto = inside.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_g", "_bin").orderBy("_v")))
    found = upto.join(wanted, same).where(F.col("_upto") >= F.col("_rest")).groupBy("_g").agg(*[F.min(F.when(F.col("_point") == k, F.col("_v"))).alias(k) for k in points])
    out = found.join(s, F.col("_g").eqNullSafe(F.col("_h")))
    return out.select(F.col("_g").alias(group), *points, F.col("_all").alias("n"), F.col("_high").alias("max"))


def histogram(rows: DataFrame, labels: list[str], value: Column, bounds: tuple[float, ...]) -> DataFrame:
    """labels, le and n: how many values (below 0 as 0) are at most each bound; the last le is +Inf."""
    v = F.greatest(value, F.lit(0.0))
    sums = rows.groupBy(*labels).agg(*[F.count_if(v <= b).alias(f"_{i}") for i, b in enumerate(bounds)], F.count(value).alias("_inf"))
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n")))
    return sums.select(*labels, F.explode(pairs).alias("b")).select(*labels, "b.le", "b.n")


def admitted(rows: DataFrame, label: str, seq: str, most: int) -> DataFrame:
    """label, n and admitted: the first most labels seen are counted, others refused."""
    counted = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(seq).alias("_first"))
    kept = counted.orderBy("_first").limit(most).select(label, F.lit(True).alias("admitted"))
    return counted.join(kept, label, "left").select(label, "n", F.coalesce("admitted", F.lit(False)).alias("admitted"))


def least_squares(rows: DataFrame, x: str, z: str, y: str) -> DataFrame:
    """a and b of y = a x + b z without intercept by the normal equations; null where they don't determine it or one is negative."""
    s = rows.agg(*[F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("xx", x, x), ("zz", z, z), ("xz", x, z), ("xy", x, y), ("zy", z, y))])
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    a, b = (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det, (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det
    return s.select(F.when((F.abs(det) > 1e-12) & (a >= 0) & (b >= 0), F.struct(a.alias("a"), b.alias("b"))).alias("f")).select("f.a", "f.b")


def coverage(windows: DataFrame) -> DataFrame:
    """Byte windows (file, seq, generation, start, end) by generation: a new generation begins
    when its tag changes in the order of upload. low, high, held (bytes but for holes), holes."""
    order = Window.partitionBy("file").orderBy("seq")
    turned = F.coalesce((F.col("generation") != F.lag("generation").over(order)).cast("int"), F.lit(1))
    run = windows.withColumn("island", F.sum(turned).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("file", "island").orderBy("start", "end", "seq")
    before = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    gaps = run.withColumn("gap", F.greatest(F.col("start") - F.coalesce(before, F.col("start")), F.lit(0)))
    out = gaps.groupBy("file", "island").agg(F.min("start").alias("low"), F.max("end").alias("high"), F.sum("gap").alias("missing"), F.count_if(F.col("gap") > 0).alias("holes"))
    return out.withColumn("held", F.col("high") - F.col("low") - F.col("missing"))


def active(rows: DataFrame, key: str, ts: str, now: str, seconds: int) -> DataFrame:
    """Keys whose last time lies within so many seconds before now."""
    last = rows.groupBy(key).agg(F.max(ts).alias("last"))
    return last.where(F.col("last") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS"))


def within_limits(rows: DataFrame, owner: str, ts: str, hour: int, day: int) -> DataFrame:
    """Runs with how many the owner had started in the hour and the day before, and whether both limits allow it."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = Window.partitionBy(owner).orderBy(at)
    in_hour = F.count("*").over(own.rangeBetween(-3_600_000_000, -1))
    in_day = F.count("*").over(own.rangeBetween(-86_400_000_000, -1))
    return rows.withColumn("in_hour", in_hour).withColumn("in_day", in_day).withColumn("allowed", (in_hour < hour) & (in_day < day))


def rates(series: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Increases of counters from reading to reading; a smaller value means the counter began anew."""
    order = Window.partitionBy(*keys).orderBy(ts)
    before = F.lag(value).over(order)
    return series.withColumn("increase", F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def over_range(series: DataFrame, keys: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Each reading of a series (ts in whole seconds) with what its last seconds say: increase (a
    smaller value means the counter began anew), rate a second, changes and max_over_time. They
    come of readings later than ts - seconds alone, nothing is extrapolated; of several readings
    of one time the largest counts."""
    own = Window.partitionBy(*keys).orderBy(ts)
    before, now = F.lag(value).over(own), F.col(value)
    once = series.groupBy(*keys, ts).agg(F.max(value).alias(value))
    steps = once.select(*keys, ts, value, F.when(now < before, now).otherwise(now - before).alias("_step"), (now != before).cast("int").alias("_turn"))
    last = own.rangeBetween(1 - seconds, 0)

    def inner(step: str) -> Column:  # the first reading's own step began before the range
        return F.coalesce(F.sum(step).over(last), F.lit(0)) - F.coalesce(F.first(step).over(last), F.lit(0))

    out = steps.withColumn("increase", inner("_step")).withColumn("changes", inner("_turn")).withColumn("max_over_time", F.max(value).over(last))
    return out.withColumn("rate", F.col("increase") / F.lit(float(seconds))).drop("_step", "_turn")


def histogram_quantile(buckets: DataFrame, keys: list[str], share: float, le: str = "le", count: str = "count") -> DataFrame:
    """keys and value: the quantile of cumulative buckets (le: the upper bound, infinity last),
    even within a bucket, whose lower bound is that of the bucket before (0 for the first, or its
    own bound where that is not above 0). In the last bucket it is the highest finite bound; null
    without observations, or without a bucket that has no bound."""
    own = Window.partitionBy(*keys).orderBy(le)
    top, infinity = F.max_by(count, le).over(Window.partitionBy(*keys)), F.lit(float("inf"))
    placed = buckets.withColumn("_low", F.lag(le).over(own)).withColumn("_under", F.coalesce(F.lag(count).over(own), F.lit(0))).withColumn("_all", top).withColumn("_open", F.max(le).over(Window.partitionBy(*keys)) == infinity)
    first = placed.where(F.col(count) >= F.col("_all") * share).groupBy(*keys).agg(F.min_by(F.struct(le, count, "_low", "_under", "_all", "_open"), le).alias("b"))
    low = F.coalesce("b._low", F.least(F.lit(0.0), F.col(f"b.{le}")))
    at = (F.col("b._all") * share - F.col("b._under")) / (F.col(f"b.{count}") - F.col("b._under"))
    inside = F.when((F.col("b._low").isNull()) & (F.col(f"b.{le}") <= 0), F.col(f"b.{le}")).otherwise(low + (F.col(f"b.{le}") - low) * at)
    value = F.when(~F.col("b._open") | (F.col("b._all") == 0), None).when(F.col(f"b.{le}") == infinity, F.col("b._low")).otherwise(inside)
    return first.select(*keys, value.alias("value"))


def leases(events: DataFrame, lease_s: int = 900, most: int = 3) -> DataFrame:
    """job_id, status and attempts after a replay of events (job_id, seq, at in seconds, kind:
    claim, beat, done, fail, release). A claim of a running job whose lease ran out counts as a
    new attempt; after the last attempt the job is abandoned; a release gives the attempt back;
    events of a job that nobody holds, or that has ended, or without a time, change nothing."""
    ends = {"done": "done", "fail": "failed", "release": "queued"}

    def step(s: State, x: State) -> None:
        if x["at"] is None:
            return
        held = s["status"] == "running" and x["at"] - s["_beat"] <= lease_s
        if x["kind"] == "claim" and (s["status"] == "queued" or s["status"] == "running" and not held):
            if s["attempts"] >= most:
                s["status"] = "abandoned"
            else:
                s.update(status="running", attempts=s["attempts"] + 1, _beat=x["at"])
        elif held and x["kind"] == "beat":
            s["_beat"] = x["at"]
        elif held and x["kind"] in ends:
            s["status"] = ends[x["kind"]]
            s["attempts"] -= x["kind"] == "release"

    start = {"status": "queued", "attempts": 0, "_beat": 0.0}
    return replayed(events.select("job_id", "seq", "at", "kind"), "job_id", ["seq"], start.copy, step, "status string, attempts int, _beat double").drop("_beat")


def breaker(calls: DataFrame, threshold: int = 3, recover_s: float = 60.0) -> DataFrame:
    """endpoint, state, failures, refused and unhealthy_since after a replay of calls (endpoint,
    seq, at, ok; ok is null for a call without an answer yet). Closed until threshold failures
    in a row, then open; after recover_s calls are let through on trial (half open), and the
    first answer closes the breaker or opens it again. unhealthy_since is when it first opened:
    a failed trial does not move it, closing clears it. Calls without a time change nothing."""

    def step(s: State, x: State) -> None:
        if x["at"] is None:
            return
        if s["state"] == "open":
            if x["at"] - s["_opened"] < recover_s:
                s["refused"] += 1
                return
            s["state"] = "half-open"
        if x["ok"]:
            s.update(state="closed", failures=0, unhealthy_since=None)
        elif x["ok"] is not None:
            s["failures"] = threshold if s["state"] == "half-open" else s["failures"] + 1
            if s["failures"] >= threshold:
                since = x["at"] if s["unhealthy_since"] is None else s["unhealthy_since"]
                s.update(state="open", _opened=x["at"], unhealthy_since=since)

    start = {"state": "closed", "failures": 0, "refused": 0, "unhealthy_since": None, "_opened": 0.0}
    schema = "state string, failures int, refused long, unhealthy_since double, _opened double"
    return replayed(calls.select("endpoint", "seq", "at", "ok"), "endpoint", ["seq"], start.copy, step, schema).drop("_opened")


def spaced(requests: DataFrame, interval: float, most_wait: float) -> DataFrame:
    """gate, admitted, refused and next_free: each request takes the next slot, at least
    interval after the one before; a slot too far ahead is refused, and used up all the same.
    Requests without a time change nothing."""

    def step(s: State, x: State) -> None:
        if x["at"] is not None:
            slot = max(x["at"], s["next_free"])
            s["refused" if slot - x["at"] > most_wait else "admitted"] += 1
            s["next_free"] = slot + interval

    start = {"admitted": 0, "refused": 0, "next_free": 0.0}
    out = replayed(requests.select("gate", "at", "seq"), "gate", ["at", "seq"], start.copy, step, "admitted long, refused long, next_free double")
    return out.withColumn("next_free", F.round("next_free", 6))


def fitting(rows: DataFrame, group: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """group, used and taken (the order keys, most at the utmost): rows in order while they fit
    the budget; one that doesn't is skipped, and smaller ones after it may still enter. A row
    without a size is skipped."""

    def step(s: State, x: State) -> None:
        if x["_size"] is not None and s["used"] + x["_size"] <= budget and len(s["taken"]) < most:
            s["used"] += x["_size"]
            s["taken"].append(x["_order"])

    sized = rows.select(group, F.col(order).cast("long").alias("_order"), F.col(size).cast("long").alias("_size"))
    return replayed(sized, group, ["_order", "_size"], lambda: {"used": 0, "taken": []}, step, "used long, taken array<long>")


def sample_value(value: Column, kind: str) -> Column:
    """A number as a scrape reads it; null stays null, so that what is unknown is no 0."""
    if kind == "boolean":
        return value.cast("int").cast("string")
    if kind not in ("float", "double"):
        return value.cast("string")
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").otherwise(value.cast("string"))


def _escaped(text: Column, quoted: bool) -> Column:
    """Backslashes and line ends, and quotes within them, as two characters."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit('"'), F.lit('\\"')) if quoted else out


def exposition(series: DataFrame, name: str, form: str, about: str, labels: list[str], value: str) -> DataFrame:
    """part and line of a metric's text form: what it is about (0), its form (1), and a line for
    each series (2) with its labels in order of their names. Series without a value have none."""
    number = sample_value(F.col(value), dict(series.dtypes)[value])
    pairs = [F.concat(F.lit(f'{c}="'), _escaped(F.coalesce(F.col(c).cast("string"), F.lit("")), True), F.lit('"')) for c in sorted(labels)]
    block = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")) if pairs else F.lit("")
    samples = series.select(F.lit(2).alias("part"), F.concat(F.lit(name), block, F.lit(" "), number).alias("line")).where("line is not null")
    head = series.sparkSession.range(2).select(F.col("id").cast("int").alias("part"), F.when(F.col("id") == 0, F.concat(F.lit(f"# HELP {name} "), _escaped(F.lit(about), False))).otherwise(F.lit(f"# TYPE {name} {form}")).alias("line"))
    return head.unionByName(samples)
