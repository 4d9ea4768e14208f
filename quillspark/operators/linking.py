"""Links between facts, pages, topics and sources; unions, set differences and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.review import norm_key
from quillspark.session import settled


def in_ranges(ranges: DataFrame, units: DataFrame, width: int = 64) -> DataFrame:
    """Ranges (id, file, low, high) and the units (file, page, readable) inside them: id, n
    and whole (all pages there once and readable). A range meets units by the bands of pages
    that it touches, so the join is one of equal keys."""
    band = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))
    r = ranges.select("*", band.alias("_band"))
    u = units.withColumn("_band", F.floor(F.col("page") / width))
    inside = r.join(u, ["file", "_band"]).where("page between low and high")
    got = inside.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.min("readable").alias("readable"))
    out = ranges.join(got, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = (F.col("n") == F.col("high") - F.col("low") + 1) & (F.col("pages") == F.col("n")) & F.col("readable")
    return out.select("id", "n", F.coalesce(whole, F.lit(False)).alias("whole"))


def restored(merged: DataFrame, originals: DataFrame) -> DataFrame:
    """Merged facts (id, date, description) with the source of the first original of that
    description and date, else of that description."""
    both, one = F.concat_ws("|", norm_key(F.col("date")), norm_key(F.col("description"))), norm_key(F.col("description"))
    first = lambda key, name: originals.groupBy(key.alias(f"_{name}")).agg(F.min(F.struct("seq", "source")).alias(f"{name}"))
    m = merged.withColumn("_exact", both).withColumn("_loose", one)
    out = m.join(first(both, "exact"), "_exact", "left").join(first(one, "loose"), "_loose", "left")
    return out.select("id", F.coalesce("exact.source", "loose.source").alias("source"))


def preselected(selected: DataFrame, topic_map: DataFrame, fallback: tuple[str, ...] = ("A", "G", "K"), forced: tuple[str, ...] = ("B", "C", "E", "J")) -> DataFrame:
    """case_id and topic: the union of the chosen conditions' topics, the fallback for a
    condition without any, and the forced ones."""
    named = selected.join(topic_map, "condition", "left")
    own = named.select("case_id", F.explode(F.coalesce("topics", F.array(*map(F.lit, fallback)))).alias("topic"))
    always = selected.select("case_id").distinct().select("case_id", F.explode(F.array(*map(F.lit, forced))).alias("topic"))
    return own.unionByName(always).distinct()


def shared_words(left: DataFrame, right: DataFrame, most: int = 3, tried: int = 256) -> DataFrame:
    """left_id, right_id, shared and place: the rows of right with most distinct words in
    common with each of left; ties by right_id. Both have id and words (array).

    Texts are read once: a row of right is kept as the numbers of those of its words that left has,
    and of rows with equal numbers the first `most`, as no other can have a place. A row of left first
    meets others on its rarest words, until these stand in `tried` of them. Where the last of the
    best so far shares t words, what comes before it shares one of all but the t - 1 most frequent,
    and meets on those. Pairs carry ids alone until they are compared."""
    a = left.select(F.col("id").alias("left_id"), F.explode(F.array_distinct("words")).alias("word"))
    known = settled(a.select("word").distinct().withColumn("w", F.monotonically_increasing_id()))
    held = right.select(F.col("id").alias("right_id"), F.explode(F.array_distinct("words")).alias("word")).join(known, "word").groupBy("right_id").agg(F.sort_array(F.collect_list("w")).alias("held"))
    copy = F.row_number().over(Window.partitionBy("held").orderBy("right_id"))
    sets = held.withColumn("copy", copy).where(F.col("copy") <= most).groupBy("held").agg(F.collect_list("right_id").alias("ids"))
    sets = settled(sets.withColumn("set", F.monotonically_increasing_id()))
    uses = sets.select("set", F.explode("held").alias("w"))
    rarest = Window.partitionBy("left_id").orderBy("n", "w")
    before = F.coalesce(F.sum("n").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = a.join(known, "word").join(uses.groupBy("w").agg(F.count("*").alias("n")), "w").select("left_id", "w", F.row_number().over(rarest).alias("at"), before.alias("before"))
    asked = settled(asked)
    mine = asked.groupBy("left_id").agg(F.collect_list("w").alias("mine"))
    place = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("shared"), "right_id"))

    def best(words: DataFrame) -> DataFrame:
        met = words.select("left_id", "w").join(uses, "w").select("left_id", "set").distinct().join(sets, "set").join(mine, "left_id")
        found = met.select("left_id", F.explode("ids").alias("right_id"), F.size(F.array_intersect("mine", "held")).cast("long").alias("shared"))
        return found.withColumn("place", place).where(F.col("place") <= most)

    floor = best(asked.where(F.col("before") < tried)).groupBy("left_id").agg(F.when(F.count("*") == most, F.min("shared")).otherwise(1).alias("least"))
    sized = asked.groupBy("left_id").agg(F.count("*").alias("size")).join(floor, "left_id").select("left_id", (F.col("size") - F.col("least") + 1).alias("upto"))
    return best(asked.join(sized, "left_id").where(F.col("at") <= F.col("upto")))


def feature_difference(rows: DataFrame, was: str, now: str) -> DataFrame:
    """added and missing: what one array has and the other lacks, sorted."""
    return rows.withColumn("added", F.array_sort(F.array_except(now, was))).withColumn("missing", F.array_sort(F.array_except(was, now)))


def merged_states(parts: DataFrame, group: str) -> DataFrame:
    """Parts (conditions, files: arrays; readable, total) of one group as one: sorted unions,
    sums, and coverage to four places, rounded half to even."""
    out = parts.groupBy(group).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("conditions")))).alias("conditions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("files")))).alias("files"),
        F.sum("readable").alias("readable"), F.sum("total").alias("total"), F.count("*").alias("parts"),
    )
    ratio = F.coalesce(F.col("readable") / F.nullif("total", F.lit(0)), F.lit(1.0))
    return out.withColumn("coverage", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)), 4))


def renamed_sources(docs: DataFrame) -> DataFrame:
    """id, name and sources: equal documents collapse and name all their sources; names that
    still clash become source/name, then get a number behind."""
    same = docs.groupBy("name", "content").agg(F.min("id").alias("id"), F.array_sort(F.collect_set("source")).alias("sources"))
    clash = F.count("*").over(Window.partitionBy("name"))
    full = same.withColumn("_n", F.when(clash > 1, F.concat_ws("/", F.element_at("sources", 1), "name")).otherwise(F.col("name")))
    k = F.row_number().over(Window.partitionBy("_n").orderBy("id"))
    return full.select("id", F.when(k > 1, F.concat("_n", F.lit(" ("), k, F.lit(")"))).otherwise(F.col("_n")).alias("name"), "sources")


def padded(items: DataFrame, fallback: DataFrame, group: str, least: int = 3, most: int = 5) -> DataFrame:
    """Distinct titles of each group by seq, filled up from the fallback to least, at most most.
    Of the fallback no more than its first `least` titles can enter, and only these are broadcast."""
    first_titles = fallback.groupBy("title").agg(F.min("seq").alias("seq")).orderBy("seq", "title").limit(least)
    own = items.select(group, "title", F.lit(0).alias("_kind"), "seq")
    more = items.select(group).distinct().crossJoin(F.broadcast(first_titles)).select(group, "title", F.lit(1).alias("_kind"), "seq")
    first = own.unionByName(more).groupBy(group, "title").agg(F.min(F.struct("_kind", "seq")).alias("o"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("o", "title"))
    p = first.withColumn("place", place)
    return p.where(((F.col("o._kind") == 0) & (F.col("place") <= most)) | ((F.col("o._kind") == 1) & (F.col("place") <= least))).select(group, "title", "place")


def reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds reason: the first rule that holds, or nothing."""
    out = None
    for name, rule in rules.items():
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return rows.withColumn("reason", F.coalesce(out, F.lit("")))
