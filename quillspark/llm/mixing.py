"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of each source are permuted (put in the order of a hash) and the permutation
is cut into blocks of equal words. A source's target says how many blocks the mix wants of
it: whole passes over the source, then the first blocks of the order up to the exact word.
The vector of block quotas is split among output shards by a binary tree: each node hands
its left child a multivariate-hypergeometric draw of its blocks, so each shard gets a random
share of every source, and all shards together have the quotas exactly. Then each shard draws:
of every source it takes the run of permuted blocks that its quotas name, disjoint from all
other shards' runs, and nothing is taken but by a shard. Each shard shuffles its own rows by
another hash (place), which is the order in which they are written.

A mix has about `blocks` blocks whatever its size, so the tree's work doesn't grow. One row
per source leaves the executors, MOST_SOURCES at most; a source that holds a third of all rows
is spread over buckets of its permutation, as many as its rows ask for, and texts take no part
in that.

Defined results: a null text, or one without words, has size 0 and takes 0 words; a null
source is a source of its own, after all others; repeated rows count once each, and the
permutation goes by all columns, so that rows of one doc_id are told apart; an empty table
gives no rows; further columns are carried as one, so none clashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Workspace, table, word_count

#: Rows of a source's permutation that one window task puts in order; the result doesn't depend on it.
BUCKET_ROWS = 2048
#: Sources are what a mix is made of: a row each, and a quota for each shard, are the driver's. More are refused.
MOST_SOURCES, MOST_QUOTAS = 100_000, 5_000_000


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources by name; the mix has share times all words;
    no source gives more than most times its own. blocks: about how many the whole mix has."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: tuple[int, int] = (3, 2)
    most: int = 2
    shards: int = 8
    blocks: int = 1 << 20
    seed: int = 17


def targets(sizes: list[int], weights: list[int], mix: Mix = Mix()) -> list[float]:
    """Words for each source: shares by weight, a source stopping at most times its own
    size and its excess going to the others by weight, until none is above."""
    up, down = mix.share
    rest, open_ = up * sum(sizes), set(range(len(sizes)))  # rest counts in 1/down words
    while True:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * rest > mix.most * sizes[i] * down * weight}
        if not full:
            break
        rest -= sum(mix.most * sizes[i] * down for i in full)
        open_ -= full
    return [weights[i] * rest / (down * weight) if i in open_ else float(mix.most * n) for i, n in enumerate(sizes)]


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows). The sums over shards are
    the quotas, and shards' totals differ by few blocks. The same for the same seed."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(have, int(have.sum()) * (middle - low) // (high - low), method="marginals")
        node(low, middle, left)
        node(middle, high, have - left)

    node(0, shards, np.asarray(quotas, np.int64))
    return out


def shard_runs(quotas: list[int], mix: Mix) -> np.ndarray:
    """Where each shard's run of every source's blocks ends (rows: shards), by the tree's
    quotas; it begins where the shard before ends, the first one's at 0."""
    return np.cumsum(split_tree(np.array(quotas, np.int64), mix.shards, mix.seed), axis=0)


def _keyed(docs: DataFrame, mix: Mix, *more: Column) -> DataFrame:
    """doc_id, _source, size and more, with two hashes of the whole row: _turn, the row's place
    in the permutation, and _tie. Rows that are equal in both are equal."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    known = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    hashes = [F.xxhash64(F.lit(mix.seed + k), *known).alias(name) for k, name in enumerate(("_turn", "_tie"))]
    return docs.select("doc_id", key.alias("_source"), word_count(F.col("text")).alias("size"), *hashes, *more)


def draw(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Every row of docs (doc_id, size, source_size, target, taken, and the hashes _turn and _tie)
    with draws: for each time a shard takes it, pass, words (all,
    but for the row at which a source's target falls), shard and place (order within the shard)."""
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    rows = space.keep(_keyed(docs, mix), "rows")
    sources = rows.groupBy("_source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).orderBy("_source").limit(MOST_SOURCES + 1).collect()
    if len(sources) > MOST_SOURCES or len(sources) * mix.shards > MOST_QUOTAS:
        raise ValueError(f"more than {MOST_SOURCES} sources or {MOST_QUOTAS} quotas: mix groups of sources, or into fewer shards")
    sizes = [s.n for s in sources]
    goal = targets(sizes, [mix.weights[i % len(mix.weights)] for i in range(len(sizes))], mix)
    block = max(1, sum(map(round, goal)) // mix.blocks)
    # The permutation's buckets are its leading bits: their number is a matter of tasks alone.
    bits = max(1, int(max((s.rows for s in sources), default=1) // BUCKET_ROWS).bit_length())
    plan, quotas = [], []
    for s, t in zip(sources, goal, strict=True):
        want = round(t)
        passes = want // s.n if s.n else 0
        rest, blocks = want - passes * s.n, -(-s.n // block)
        quotas.append(passes * blocks + -(-rest // block))
        plan.append([s._source, s.n, t, passes, rest, blocks])
    ends = shard_runs(quotas, mix)
    for k, p in enumerate(plan):
        p.append(ends[:, k].tolist())
    schema = "_source string, source_size long, target double, _passes long, _rest long, _blocks long, _ends array<long>"
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_turn", 64 - bits))
    buckets = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0))).join(F.broadcast(spark.createDataFrame(plan, schema)), "_source").drop("_words")
    within = Window.partitionBy("_source", "_bucket").orderBy("_turn", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    out = rows.join(placed, ["_source", "_bucket"]).withColumn("_start", start)

    def one(number: Column, words: Column) -> Column:
        sequence = number * F.col("_blocks") + F.floor(F.col("_start") / F.lit(block)).cast("long")
        shard = F.size(F.filter("_ends", lambda end: end <= sequence))
        return F.struct(number.cast("int").alias("pass"), words.alias("words"), shard.alias("shard"), F.xxhash64(number, "_tie").alias("place"))

    full = F.transform(F.sequence(F.lit(0), F.col("_passes") - 1), lambda p: one(p.cast("long"), F.col("size")))
    part = F.least(F.col("size"), F.col("_rest") - F.col("_start"))
    asked = F.concat(
        F.when(F.col("_passes") > 0, full).otherwise(F.array()),
        F.when(F.col("_start") < F.col("_rest"), F.array(one(F.col("_passes"), part))).otherwise(F.array()),
    )
    # A block that no shard's quota reaches is drawn by none.
    draws = F.filter(asked, lambda d: d["shard"] < mix.shards)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.withColumn("draws", draws).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws", "_turn", "_tie")


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its word number count."""
    lead = r"^[\x20\x09-\x0D]*"
    return F.when(count <= 0, F.lit("")).otherwise(F.array_join(F.slice(F.split(F.regexp_replace(text, lead, ""), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.greatest(count, F.lit(1)).cast("int")), ""))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: a row of docs for each draw, with _shard and _place; where a draw takes
    only some words of a text, the text is cut behind them. Rows come in the order of shards,
    and within a shard in that of its own shuffle, each partition a run of it: written as they
    come, the files hold the shuffled shards."""
    names = docs.columns
    same = ["_turn", "_tie"]
    draws = draw(docs, mix).select(*same, "size", F.explode("draws").alias("_draw"))
    # Equal rows are one row here, as many draws as they have.
    rows = _keyed(docs, mix, F.struct(*names).alias("_row")).groupBy(*same).agg(F.any_value("_row").alias("_row"))
    drawn = draws.join(rows, same)
    text = F.when(F.col("_draw.words") < F.col("size"), first_words(F.col("_row.text"), F.col("_draw.words"))).otherwise(F.col("_row.text"))
    out = drawn.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names], F.col("_draw.shard").alias("_shard"), F.col("_draw.place").alias("_place"))
    # Places are even over all longs, so equal parts of them are equal parts of a shard.
    bits = max(0, (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) // mix.shards).bit_length()
    run = F.shiftrightunsigned(F.col("_place").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int") if bits else F.lit(0)
    return out.repartitionById(mix.shards << bits, F.shiftleft("_shard", bits) + run).sortWithinPartitions("_shard", "_place")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and where its draws stand: their shards,
    and their places in the shards' own shuffles."""
    each = F.col("draws")
    return draw(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.size(each).alias("n_draws"), each["shard"].alias("shards"), each["place"].alias("places"))


QUERIES = {"op1_mixing": op1_mixing}
SQL: dict[str, str] = {}
