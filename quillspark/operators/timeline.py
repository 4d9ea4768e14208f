"""Timelines of facts: order, filters and the two gap detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import dates

MONTH_DAYS = 30


def shortened(text: Column, most: int) -> Column:
    """At most so many characters: cut at the last space before, with dots behind."""
    t = F.trim(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 3), r" [^ ]*$", ""), F.lit("...")))


def events(facts: DataFrame) -> DataFrame:
    """Facts with date_sortable, precision, category and place (from 1, by date and then seq) within their case."""
    both = dates.let(dates.printed_date(F.col("date")), lambda d: F.struct(dates.key_of(d).alias("key"), d["precision"].alias("precision")))
    out = facts.withColumn("_d", both).withColumn("date_sortable", F.col("_d.key")).withColumn("precision", F.col("_d.precision")).drop("_d")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("date_sortable", "seq"))
    return out.withColumn("category", dates.category(F.col("type"))).withColumn("place", place)


def gaps(timeline: DataFrame, months: int = 6) -> DataFrame:
    """Neighbours in a case's order of which both have a full date, and at least so many
    months of 30 days lie between. An undated neighbour ends a pair."""
    order = Window.partitionBy("case_id").orderBy("date_sortable", "seq")
    pair = timeline.select("case_id", "date", "date_sortable", "precision", "seq", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("date", "date_sortable", "precision")])
    days = F.datediff(F.try_to_date("next_date_sortable", "yyyy-MM-dd"), F.try_to_date("date_sortable", "yyyy-MM-dd"))
    return pair.where("precision = 'day' and next_precision = 'day'").withColumn("months", F.floor(days / MONTH_DAYS).cast("int")).where(F.col("months") >= months).select("case_id", "date", F.col("next_date").alias("end_date"), "months")


def day_gaps(timeline: DataFrame, days: int = 180) -> DataFrame:
    """Stretches over so many days between a case's distinct full dates."""
    full = timeline.where("precision = 'day'").select("case_id", F.col("date_sortable").alias("day")).distinct()
    order = Window.partitionBy("case_id").orderBy("day")
    span = full.withColumn("start", F.lag("day").over(order))
    return span.withColumn("days", F.datediff(F.to_date("day"), F.to_date("start"))).where(F.col("days") > days).select("case_id", "start", F.col("day").alias("end"), "days")


def filtered(timeline: DataFrame, low: str | None = None, high: str | None = None, types: tuple[str, ...] = (), providers: tuple[str, ...] = ()) -> DataFrame:
    """By date, where undated rows always pass; by type; by provider, where rows without any pass."""
    out = timeline
    undated = F.col("date_sortable") == dates.UNDATED
    if low:
        out = out.where(undated | (F.col("date_sortable") >= low))
    if high:
        out = out.where(undated | (F.col("date_sortable") <= high))
    if types:
        out = out.where(F.col("type").isin(*types))
    if providers:
        out = out.where(F.col("source").isNull() | (F.col("source") == "") | F.col("source").isin(*providers))
    return out


def condensed(timeline: DataFrame, most: int = 400) -> DataFrame:
    """At most so many events of each case at even strides, the last one always."""
    n = F.count("*").over(Window.partitionBy("case_id"))
    t = timeline.withColumn("_n", n).withColumn("_i", F.col("place") - 1)
    # Place i is taken if some k < most has int(k * n / most) == i.
    first = F.ceil(F.col("_i") * most / F.col("_n"))
    taken = (F.col("_n") <= most) | ((first < most) & (F.floor(first * F.col("_n") / most) == F.col("_i"))) | (F.col("_i") == F.col("_n") - 1)
    return t.where(taken).drop("_n", "_i")
