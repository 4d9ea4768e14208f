"""MinHash near-dedup: links of Jaccard similarity at or above a bound, and their components.

Words are lower-cased (A-Z only) runs without white space; a document's set are its distinct
shingles of k words. Each set gets BANDS * ROWS minima of universal hashes. Documents with
equal sets form one class, and only a class's first document goes on. Classes that share a
band are candidates: signatures are compared first, then the full sets confirm a link.
A pair at the bound of 0.8 is missed with probability (1 - 0.8**5)**32, about 3 in a million.

Candidates within a band's bucket are never all paired. In each round a bucket's pivot is
tested against the bucket's documents of other components, and leaves the bucket; components
are found, and buckets of one component are done. The first pivot is the least document, the
same in all buckets of a group; later ones go by a hash, so that a document meets others in
every bucket it is in. So a bucket of n documents that are alike costs n tests a round.
What still shares a bucket with another component after ROUNDS rounds is gathered in clusters
(components over shared buckets), and every pair of a cluster's blocks is one group: its pairs
of different components are compared in memory, by signature and then by full set, and only
links that join two components come out.

Defined results: null and empty texts have no shingles and link with nothing; fewer than k
words are one shingle; rows of one doc_id count as one document, for which the text with the
largest set stands (ties by hashes of the set and the text); rows without doc_id are never
linked and have no component; texts are read whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Workspace, slices, table, whole_text
from quillspark.llm.components import components

BANDS, ROWS, SEED = 32, 5, 2024
#: A signature is compared first: fewer equal minima than this share (five standard deviations below 0.8) can't be a link.
SURE = 0.64
ROUNDS = 2
#: Documents, and bytes, of a block: a task compares two of them.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(SEED)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
A = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
B = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Near:
    """Words a shingle, and the least similarity in hundredths."""

    words: int = 5
    percent: int = 80


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    joined = b"\n".join(texts).translate(LOWER) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    inside = np.flatnonzero(~space)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    word = _mix(np.add.reduceat(_mix(BYTE[data[inside]] + place.astype(np.uint64) * M2), first) + sizes.astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, stops)
    out, low = [], 0
    for high in upto:
        w = word[low:high]
        low = high
        n = min(k, len(w))
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            h = _mix(h * M1 + w[j : len(w) - n + 1 + j])
        out.append(np.unique(h))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima (upper 32 bits) of each set, in rows; sets aren't empty."""
    out = np.empty((len(sets), len(A)), np.uint32)
    at = 0
    while at < len(sets):
        stop, held = at, 0
        while stop < len(sets) and (stop == at or held + len(sets[stop]) <= 32_768):
            held += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[at:stop])
        first = np.cumsum([0] + [len(s) for s in sets[at : stop - 1]])
        for p in range(len(A)):
            out[at:stop, p] = np.minimum.reduceat(x * A[p] + B[p], first) >> np.uint64(32)
        at = stop
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("tie"), F.encode(whole_text(), "UTF-8").alias("text"))


def sketched(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, tie (a hash of the text), n_shingles, h1 and h2 (hashes of the set) and sig of every row."""
    kept = _texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = shingles(batch.column("text").to_pylist(), near.words)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full) if full else ())
            rows = [(len(s), int(s.sum()) - (1 << 63) if len(s) else 0, int(_mix(s).sum()) - (1 << 63) if len(s) else 0, next(sig).astype("<u4").tobytes() if len(s) else b"") for s in sets]
            n, h1, h2, sigs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "tie", "n_shingles", "h1", "h2", "sig"])

    return kept.mapInArrow(run, "doc_id long, tie long, n_shingles long, h1 long, h2 long, sig binary")


def _banded(reps: DataFrame) -> DataFrame:
    width = ROWS * 4
    each = F.array(*[F.xxhash64(F.substring("sig", width * b + 1, width), F.lit(b)) for b in range(BANDS)])
    return reps.select("node", F.posexplode(each).alias("band", "bucket"))


def _alike(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (x, y) whose signatures agree enough to be worth comparing in full."""

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), "<u4").reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), "<u4").reshape(len(b), -1)
        return pd.Series((x == y).mean(1) >= SURE)

    x = reps.select(F.col("node").alias("x"), F.col("sig").alias("sx"))
    y = reps.select(F.col("node").alias("y"), F.col("sig").alias("sy"))
    return pairs.join(x, "x").join(y, "y").where(close("sx", "sy")).select("x", "y")


def _confirmed(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Pairs (x, y) that are links by their full sets."""
    x = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    y = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    joined = pairs.join(x, "x").join(y, "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "tx", 4 << 20), "ty", 4 << 20):
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            own: dict[int, bytes] = dict(zip(xs, batch.column("tx").to_pylist(), strict=True)) | dict(zip(ys, batch.column("ty").to_pylist(), strict=True))
            sets = dict(zip(own, shingles(list(own.values()), near.words), strict=True))
            keep = []
            for p, q in zip(xs, ys, strict=True):
                a, b = sets[p], sets[q]
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= near.percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["u", "v"]).filter(pa.array(keep))

    return joined.mapInArrow(run, "u long, v long")


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of others, sorted sets, has in common with own."""
    x = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, x), len(own) - 1)
    sizes = np.array([len(o) for o in others])
    return np.add.reduceat((own[at] == x).astype(np.int64), np.cumsum(sizes) - sizes)


def _in_blocks(rest: DataFrame, reps: DataFrame, texts: DataFrame, near: Near, space: Workspace) -> DataFrame:
    """Links (u, v) between components that share a bucket in rest (bucket, node, component):
    all that it takes to join them. A group holds two blocks of one cluster."""
    first = rest.groupBy("bucket").agg(F.min("node").alias("v"))
    cluster = components(rest.join(first, "bucket").select(F.col("node").alias("u"), "v"), space, "clusters").withColumnRenamed("component", "cluster")
    rows = space.keep(rest.select("node", "component").distinct().join(cluster, "node"), "clustered")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_BYTES))).cast("int")
    sized = rows.join(texts.select("node", "size"), "node").groupBy("cluster").agg(blocks.alias("blocks"))
    rows = rows.join(sized, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(reps, "node").join(texts.drop("size"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "component", "sig", "text")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        sig = np.frombuffer(b"".join(pdf.sig), "<u4").reshape(len(pdf), -1)
        node, own, inner = pdf.node.to_numpy(), pdf.own.to_numpy(), pdf.p.iloc[0] == pdf.q.iloc[0]
        _, part = np.unique(pdf.component.to_numpy(), return_inverse=True)
        sets, found = shingles(list(pdf.text), near.words), []
        sizes = np.array([len(s) for s in sets])
        for i in range(len(pdf) - 1):
            j = np.flatnonzero((part != part[i]) & (np.arange(len(pdf)) > i) & (inner | (own != own[i])))
            j = j[(sig[j] == sig[i]).mean(1) >= SURE] if len(j) else j
            if not len(j):
                continue
            both = _shared(sets[i], [sets[k] for k in j])
            for k in j[100 * both >= near.percent * (sizes[i] + sizes[j] - both)]:
                if part[k] != part[i]:
                    part[part == part[k]] = part[i]
                    found.append((int(node[i]), int(node[k])))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return rows.groupBy("cluster", "p", "q").applyInPandas(links, "u long, v long")


def _joined(found: DataFrame, links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """found (node, component) after more links: only components that a link joins are worked on."""
    u = found.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    v = found.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    between = links.join(u, "u").join(v, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    new = components(between, space, name).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return found.join(new, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


def near_groups(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept
    (whether that is its own) of every row."""
    space = Workspace(docs.sparkSession, "minhash")
    rows = space.keep(sketched(docs, near), "sketched")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    best = some.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "h1", "h2", "tie")).alias("best")).select("doc_id", "best.*")
    classes = best.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"))
    stands = space.keep(best.join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "tie", "node"), "stands")
    of = rows.select("doc_id", "n_shingles").join(stands.select("doc_id", "node"), "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    firsts = stands.where("doc_id = node").select("node", "tie")
    shared = some.withColumnRenamed("doc_id", "node").join(firsts, ["node", "tie"], "left_semi").select("node", "sig")
    # A bucket of one row is no candidate; what is left is a fraction of all rows.
    banded = _banded(shared).distinct()
    full = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    left = space.keep(banded.join(full, "bucket").select("band", "bucket", "node"), "buckets-0")
    nodes = left.select("node").distinct()
    reps = space.keep(shared.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "reps")
    texts = _texts(docs).withColumnRenamed("doc_id", "node").join(firsts.join(nodes, "node", "left_semi"), ["node", "tie"], "left_semi").groupBy("node", "tie").agg(F.any_value("text").alias("text"))
    texts = space.keep(texts.select("node", "text", F.length("text").cast("long").alias("size")), "texts")
    found = nodes.select("node", F.col("node").alias("component"))
    for at in range(ROUNDS + 1):
        known = left.join(found, "node")
        if at < ROUNDS:
            turn = F.struct((F.xxhash64("node", "bucket", F.lit(at)) if at else F.lit(0).cast("long")).alias("turn"), F.col("node").alias("y"), F.col("component").alias("cy"))
            pivots = known.groupBy("bucket").agg(F.min(turn).alias("pivot")).select("bucket", "pivot.y", "pivot.cy")
            rows = space.keep(known.join(pivots, "bucket").where("node <> y"), f"rows-{at}")
            pairs = rows.where("component <> cy").select(F.col("node").alias("x"), "y").distinct()
            pairs = space.keep(_alike(pairs, reps), f"pairs-{at}")
            links = space.keep(_confirmed(pairs, texts, near), f"links-{at}")
        else:
            links = space.keep(_in_blocks(known, reps, texts, near, space), f"links-{at}")
        if not links.isEmpty():
            found = space.keep(_joined(found, links, space, f"parts-{at}"), f"found-{at}")
        if at == ROUNDS:
            break
        # The pivot has met all others; buckets whose rest is one component are done.
        rest = rows.select("band", "bucket", "node").join(found, "node")
        mixed = rest.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
        left = space.keep(rest.select("band", "bucket", "node").join(mixed, "bucket", "left_semi"), f"buckets-{at + 1}")
        space.drop(f"rows-{at}")
        space.release()
        if left.isEmpty():
            break
    part = F.coalesce("component", F.col("own.node"), "doc_id")
    out = of.alias("own").join(found.withColumnRenamed("node", "at"), F.col("own.node") == F.col("at"), "left")
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(True)).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on word pairs."""
    return near_groups(table(spark, sf_dir, "documents"), Near(words=2, percent=80))


QUERIES = {"op3_minhash": op3_minhash}
SQL: dict[str, str] = {}
