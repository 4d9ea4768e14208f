"""Sharding by sampled splitters: near-equal bytes, equal texts together.

Rows get a sort key: the upper bits of a hash of the text, then of a hash of doc_id, so
that equal texts lie next to each other. A sample in which a row's chance is in
proportion to its size gives quantiles, which are the borders of many small ranges;
their exact sizes are counted, and overfull ranges are sampled again and subdivided.
Texts whose copies together fill more than a fiftieth of a shard are dealt to shards
first, the largest to the emptiest; running totals over ranges, and over the rows of each
range, then fill all shards to one level. So equal texts share a shard and sizes differ
by little more than a text; only copies that exceed a whole shard are cut.

To the driver go only the sample (its size is a parameter), a row per range and at most
50 rows per shard of large texts.

Defined results: a null text has no bytes (size 1, CRC of the empty string); rows that
repeat are placed side by side; an empty table gives no rows; other columns are
carried as one if asked for, so none clashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Workspace, table, whole_text

#: Bits of the key that tell rows of one text apart.
LOW = 20
SAMPLES_A_RANGE = 16
MOST_ROUNDS = 8


def _keyed(docs: DataFrame, whole: bool) -> DataFrame:
    text = F.xxhash64(whole_text())
    own = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("own")), 64 - LOW)
    key = text.bitwiseAND(F.lit(-(1 << LOW))).bitwiseOR(own)
    return docs.select("doc_id", *([F.struct(*docs.columns).alias("_in")] if whole else []), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"), key.alias("_key"))


def _range_of(key: Column, borders: np.ndarray) -> Column:
    """How many borders lie at or before the key."""

    @F.pandas_udf("int")
    def place(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(np.searchsorted(borders, k.to_numpy(), side="right").astype("int32"))

    return place(key)


def _sample(rows: DataFrame, weight: Column, rate: float, turn: int) -> list[int]:
    """Sorted keys; a row's chance is rate times its weight, one at most."""
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "_key", F.lit(turn)), 11) / F.lit(float(1 << 53))
    return sorted(r[0] for r in rows.where(chance < weight * rate).select("_key").collect())


def _quantiles(sample: list[int], parts: int) -> list[int]:
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def splitters(rows: DataFrame, ranges: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Borders, and (range, size, rows) of every range that has rows. rows: doc_id, _key, size.

    Weight is half bytes and half rows, so that neither many small nor few large rows
    fill a range beyond its measure. Borders lie between different texts where a range
    holds several; only a range that is one text is cut inside."""
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not total.n:
        return np.empty(0, np.int64), []
    weight = F.col("size") / F.lit(total.size * 2.0) + F.lit(0.5 / total.n)
    found = _sample(rows, weight, ranges * SAMPLES_A_RANGE, 0)
    borders = {k >> LOW << LOW for k in _quantiles(found, ranges)}
    for turn in range(1, MOST_ROUNDS + 1):
        edges = np.array(sorted(borders), np.int64)
        placed = rows.withColumn("_range", _range_of(F.col("_key"), edges))
        counted = placed.groupBy("_range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.sum(weight).alias("w"), F.min("_key").alias("low"), F.max("_key").alias("high")).collect()
        full = [c for c in counted if c.w > 2 / ranges and c.low < c.high]
        if not full or turn == MOST_ROUNDS:
            break
        again = _sample(placed.where(F.col("_range").isin([c["_range"] for c in full])), weight, ranges * SAMPLES_A_RANGE, turn)
        before = len(borders)
        for c in full:
            own = again[bisect_right(again, c.low - 1) : bisect_right(again, c.high)]
            cut = _quantiles(own, max(2, round(c.w * ranges * 2)))
            between = {k >> LOW << LOW for k in cut} - {c.low >> LOW << LOW}
            borders |= between or {k for k in cut if k > c.low}
        if len(borders) == before:
            break
    return edges, sorted((c["_range"], c["size"], c.n) for c in counted)


def _packed(heavy: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """A shard for each large text (group, size), largest first into the emptiest; and how full that makes each."""
    held, where = [0] * shards, {}
    for group, size in sorted(heavy, key=lambda g: (-g[1], g[0])):
        where[group] = held.index(min(held))
        held[where[group]] += size
    return where, held


def shard(docs: DataFrame, shards: int = 8, whole: bool = False, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 in each shard, without gaps) of
    every row; whole adds the row itself as _in."""
    spark = docs.sparkSession
    space = Workspace(spark, "sharding")
    keyed = _keyed(docs, whole)
    rows = keyed if whole else space.keep(keyed, "rows")
    ranges = ranges or min(65_536, max(64 * shards, rows.count() // 50_000))
    borders, counted = splitters(rows, ranges)
    total = sum(size for _, size, _ in counted)
    group = F.shiftright("_key", LOW)
    # At most 50 * shards texts can be so large.
    large = rows.groupBy(group.alias("_group")).agg(F.sum("size").alias("size")).where(F.col("size") * F.lit(50 * shards) > F.lit(total))
    heavy = [(r["_group"], r["size"]) for r in large.where(F.col("size") * F.lit(shards) <= F.lit(total)).collect()]
    where, held = _packed(heavy, shards)
    marks = F.broadcast(spark.createDataFrame([(g, k) for g, k in where.items()], "_group long, _heavy int"))
    rows = rows.withColumn("_range", _range_of(F.col("_key"), borders)).withColumn("_group", group).join(marks, "_group", "left").withColumn("_heavy", F.coalesce("_heavy", F.lit(-1)))
    pieces = sorted(tuple(r) for r in rows.groupBy("_heavy", "_range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())
    at_size, at_row, base = [0] * (shards + 1), [0] * (shards + 1), []
    for number, place, size, n in pieces:  # of the last entry: rows that aren't heavy
        base.append((number, place, at_size[number], at_row[number]))
        at_size[number] += size
        at_row[number] += n
    # What the large texts leave of each shard is filled with the others, in order.
    rest, open_ = at_size[-1], list(range(shards))
    while (over := [k for k in open_ if held[k] * len(open_) > rest + sum(held[j] for j in open_)]) and len(open_) > 1:
        open_ = [k for k in open_ if k not in over]
    level = (rest + sum(held[k] for k in open_)) / len(open_)
    cuts, filled = [], 0.0
    for k in range(shards):
        filled += max(0.0, level - held[k]) if k in open_ else 0.0
        cuts.append(filled)
    offsets = spark.createDataFrame(base, "_heavy int, _range int, _bytes long, _rows long")
    order = Window.partitionBy("_heavy", "_range").orderBy("_key", "doc_id", "size", "text_crc32")
    placed = rows.join(offsets, ["_heavy", "_range"]).withColumn("_start", F.col("_bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("_row", F.col("_rows") + F.row_number().over(order) - 1)
    run = Window.partitionBy("_heavy", "_range", "_group")
    small = F.sum("size").over(run) * F.lit(50 * shards) <= F.lit(total)
    start = F.when(small, F.min("_start").over(run)).otherwise(F.col("_start"))
    filled_at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[:-1]]), lambda c: c <= start))
    placed = placed.withColumn("shard", F.when(F.col("_heavy") >= 0, F.col("_heavy")).otherwise(filled_at).cast("int")).drop("_bytes", "_rows", "_start", "_range", "_group")
    placed = placed if whole else space.keep(placed, "placed")
    first = {r["shard"]: r.at for r in placed.where("_heavy < 0").groupBy("shard").agg(F.min("_row").alias("at")).collect()}
    slot = F.col("_row")
    for number, at in first.items():
        slot = F.when((F.col("_heavy") < 0) & (F.col("shard") == number), F.col("_row") - F.lit(at) + F.lit(at_row[number])).otherwise(slot)
    return placed.select("doc_id", *(["_in"] if whole else []), "size", "text_crc32", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write docs under path/_shard=N with all columns and _slot, each file in the order of
    slots. A shard is written by several tasks."""
    out = shard(docs, shards, whole=True).select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "_in.*")
    out.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents."""
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
SQL: dict[str, str] = {}
