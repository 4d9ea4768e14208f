"""Document fingerprints: a randomised edit embedding, sampled, banded and verified.

A text is embedded by a random walk: at each step the cursor stands on a character and
moves on or waits, by a random bit that depends on the step and the character and is the
same for all texts. Two texts that differ by few edits keep meeting again, so their edit
distance shows as the Hamming distance of what their cursors see. Each coordinate is a hash
of the few characters at the cursor.

A fingerprint samples SAMPLES coordinates of each octave of steps, the same for all texts,
so texts of any length can be compared; likeness is one minus the Hamming distance
estimated from the samples, octaves weighing by how many steps they stand for. Bands of
sampled bits find candidates, and the full fingerprint verifies them.

Defined results: null is an empty text; empty texts have the fingerprint "" and likeness 1
to each other, 0 to others; equal texts have equal fingerprints; long texts are walked
whole; rows are ordered by doc_id, then by a hash of the text, so repeated rows have a
defined neighbour; a lone row is its own next document; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Workspace, table, whole_text
from quillspark.llm.components import components

#: Random bits repeat after PERIOD steps. The first octave is steps 0 to 2**BASE - 1.
PERIOD, BASE, SAMPLES, CONTEXT, SEED = 4096, 6, 64, 4, 11
#: Samples that a band reads.
ROWS = 8
#: Fingerprints that are compared with as many others in one group.
BLOCK = 512
#: Rows sampled to find the borders of a part, and what a row counts for beside its characters.
SAMPLES_A_PART, ROW_WEIGHT = 100, 500
#: Texts walked side by side, by total length.
AT_ONCE = 1_500_000


@lru_cache(maxsize=1)
def waits() -> np.ndarray:
    """For each character class and step (modulo PERIOD): steps until the cursor has moved on."""
    bits = np.random.default_rng(SEED).integers(0, 2, (256, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    out = np.empty((256, PERIOD), np.int32)
    nearest = np.full(256, PERIOD, np.int64)
    for j in range(PERIOD - 1, -1, -1):
        nearest = np.where(bits[:, j] == 1, j, nearest)
        out[:, j] = nearest - j + 1
    return out.ravel()


@lru_cache(maxsize=64)
def sampled(octave: int) -> np.ndarray:
    """The steps of one octave that fingerprints look at, in order."""
    low = 0 if octave == 0 else 1 << (BASE + octave - 1)
    high = 1 << (BASE + octave)
    return np.sort(np.random.default_rng([SEED, octave]).choice(high - low, SAMPLES, replace=False) + low) if high - low <= 1 << 16 else np.sort(np.random.default_rng([SEED, octave]).integers(low, high, SAMPLES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(points: np.ndarray) -> np.ndarray:
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int32)


def walk(texts: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
    """For each text of code points, entered at a step of its own, the step at which each character is left.

    Texts advance side by side, one character at a time, the longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    table_, at = waits(), 0
    while at < len(order) and sizes[at]:
        stop = at + 1
        while stop < len(order) and sizes[stop] and (stop + 1 - at) * sizes[at] <= AT_ONCE and sizes[stop] * 2 > sizes[at]:
            stop += 1
        group = order[at:stop]
        width = int(sizes[at])
        rows = np.zeros((width, len(group)), np.int32)
        for k, i in enumerate(group):
            rows[: len(texts[i]), k] = _classes(texts[i])
        rows *= PERIOD
        live = len(group) - np.searchsorted(sizes[at:stop][::-1], np.arange(width), side="right")
        left = np.zeros((width, len(group)), np.int64)
        step = np.array([starts[i] for i in group], np.int64)
        for c in range(width):
            n = live[c]
            now = step[:n]
            now += table_[rows[c, :n] + (now & (PERIOD - 1))]
            left[c, :n] = now
        for k, i in enumerate(group):
            out[i] = left[: len(texts[i]), k]
        at = stop
    return out


def _seen(points: np.ndarray) -> np.ndarray:
    """A byte for each place: a hash of the CONTEXT characters from there on (zeros behind the end)."""
    full = np.concatenate([points, np.zeros(CONTEXT - 1, np.uint32)]).astype(np.uint64)
    h = np.zeros(len(points), np.uint64)
    for k in range(CONTEXT):
        h = (h ^ full[k : k + len(points)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(24)).astype(np.uint8)


def sketch(points: np.ndarray, left: np.ndarray) -> bytes:
    """What the cursor sees at the sampled steps, octave by octave; 0 behind the end, else 1 to 255."""
    if not len(points):
        return b""
    seen = np.maximum(1, _seen(points))
    octaves = max(0, int(left[-1] - 1).bit_length() - BASE) + 1
    steps = np.concatenate([sampled(o) for o in range(octaves)])
    at = np.searchsorted(left, steps, side="right")
    return np.where(at < len(points), seen[np.minimum(at, len(points) - 1)], 0).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 less the estimated share of coordinates, up to the longer text's end, in which two sketches differ."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    y = np.frombuffer(b, np.uint8).reshape(-1, SAMPLES)
    x = np.zeros_like(y)
    x.ravel()[: len(a)] = np.frombuffer(a, np.uint8)
    held = (x > 0) | (y > 0)
    weight = np.array([1 << (BASE + max(0, o - 1)) for o in range(len(y))], float)
    same = ((x == y) & held).sum(1) / SAMPLES
    return float((same * weight).sum() / (held.sum(1) / SAMPLES * weight).sum())


def bands(fingerprint: bytes) -> list[tuple[int, int]]:
    """Band number and hash of each run of ROWS samples that lies before the text's end."""
    x = np.frombuffer(fingerprint, np.uint8).reshape(-1, ROWS)
    return [(k, int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=7).digest(), "big")) for k, r in enumerate(x) if r.all()]


def fingerprints(texts: list[str]) -> list[bytes]:
    points = [code_points(t) for t in texts]
    return [sketch(p, left) for p, left in zip(points, walk(points, [0] * len(points)), strict=True)]


def near_groups(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable) of every row: texts are linked
    whose fingerprints share a band and agree to at least least. Rows of one fingerprint are
    one class. Classes that share bands form clusters, and every pair of a cluster's blocks is
    compared in memory, whole; only links that join two components come out. Rows without
    doc_id are linked with nothing."""
    space = Workspace(docs.sparkSession, "embedding")
    own = space.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(whole_text()).alias("print")), "own")
    classes = own.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"))

    @F.pandas_udf("array<long>")
    def banded(prints: pd.Series) -> pd.Series:
        return pd.Series([[k << 56 ^ h for k, h in bands(bytes.fromhex(p))] for p in prints])

    rows = classes.select("node", F.explode(banded("print")).alias("bucket"))
    first = rows.groupBy("bucket").agg(F.min("node").alias("v"))
    cluster = components(rows.join(first, "bucket").select(F.col("node").alias("u"), "v"), space, "clusters").withColumnRenamed("component", "cluster")
    rows = space.keep(classes.join(cluster, "node"), "clustered")
    sized = rows.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = rows.join(sized, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "print")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        node, part, side = pdf.node.tolist(), np.arange(len(pdf)), pdf.own.to_numpy()
        inner, found = pdf.p.iloc[0] == pdf.q.iloc[0], []
        prints = [bytes.fromhex(p) for p in pdf["print"]]
        held = [set(bands(p)) for p in prints]
        for i in range(len(pdf) - 1):
            for j in np.flatnonzero((part != part[i]) & (np.arange(len(pdf)) > i) & (inner | (side != side[i]))).tolist():
                if part[j] != part[i] and not held[i].isdisjoint(held[j]) and likeness(prints[i], prints[j]) >= least:
                    part[part == part[j]] = part[i]
                    found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    joined = components(rows.groupBy("cluster", "p", "q").applyInPandas(links, "u long, v long"), space, "parts")
    out = own.join(classes, "print", "left").join(joined, "node", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def fingerprint_of(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([f.hex() for f in fingerprints(list(texts.fillna("")))])

    return run(text)


def likeness_of(x: str, y: str) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(bytes.fromhex(p), bytes.fromhex(q)) for p, q in zip(a, b, strict=True)])

    return run(x, y)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands int"


def _described(texts: list[str], following: list[str]) -> tuple[list[bytes], list[str], list[bytes]]:
    """Sketches of texts, their edited texts (each with the next document's text), and sketches of those."""
    points = [code_points(t) for t in texts]
    walked = walk(points, [0] * len(points))
    own = [sketch(p, s) for p, s in zip(points, walked, strict=True)]
    edited, tails, starts = [], [], []
    for t, s, n in zip(texts, walked, following, strict=True):
        k = len(t) // 3
        kept = len(t) - k
        edited.append(t[:kept] + n[:k])
        tails.append(code_points(n[:k]))
        starts.append(int(s[kept - 1]) if kept else 0)
    # The walk over what an edited text keeps is that of the text itself.
    behind = walk(tails, starts)
    prints = []
    for t, s, tail, more, e in zip(texts, walked, tails, behind, edited, strict=True):
        kept = len(t) - len(t) // 3
        prints.append(sketch(code_points(e), np.concatenate([s[:kept], more])))
    return own, edited, prints


KEY = ["later", "down", "tie"]


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, and KEY, whose ascending order is that of documents: descending doc_id,
    rows without one last, then a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("later"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("down"), F.xxhash64("text").alias("tie"))


def _borders(rows: DataFrame, parts: int) -> np.ndarray:
    """Keys (a row each, sorted) that cut the documents' order into parts of about equal
    characters, by a sample of SAMPLES_A_PART rows a part. Results don't depend on them."""
    share = min(1.0, SAMPLES_A_PART * parts / max(1, rows.count()))
    got = rows.select(*KEY, (F.length("text") + ROW_WEIGHT).cast("long").alias("size")).sample(share, SEED).toArrow()
    key = [got.column(c).to_numpy().astype(np.int64) for c in KEY]
    order = np.lexsort(key[::-1])
    total = np.cumsum(got.column("size").to_numpy()[order])
    cuts = np.searchsorted(total, np.arange(1, parts) * (total[-1] / parts)) if len(order) else np.empty(0, np.int64)
    return np.unique(np.stack(key, 1)[order[cuts]], axis=0) if len(cuts) else np.empty((0, 3), np.int64)


def _part_of(borders: np.ndarray) -> Column:
    """How many borders a row's KEY is at or behind; keys alone go to Python, texts don't."""

    @F.pandas_udf("int")
    def place(later: pd.Series, down: pd.Series, tie: pd.Series) -> pd.Series:
        n = len(later)
        both = [np.concatenate([borders[:, k], column.to_numpy().astype(np.int64)]) for k, column in enumerate((later, down, tie))]
        is_row = np.arange(len(borders) + n) >= len(borders)
        order = np.lexsort([is_row, *both[::-1]])
        before = np.cumsum(~is_row[order])
        out = np.empty(len(order), np.int32)
        out[order] = before
        return pd.Series(out[len(borders) :])

    return place(*KEY)


def _neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """part, doc_id, text and halo: parts are runs of the documents' order, each followed by
    a copy of the next part's first row (halo), the last by the first of all."""
    rows = _ordered(docs)
    rows = rows.withColumn("part", _part_of(_borders(rows, parts)))
    tops = sorted((r.part, *r.top) for r in rows.groupBy("part").agg(F.min(F.struct(*KEY)).alias("top")).collect())
    heads = docs.sparkSession.createDataFrame([(tops[k - 1][0], *t[1:]) for k, t in enumerate(tops)], "to int, later int, down long, tie long")
    # A row for each part at most.
    halo = rows.drop("part").join(F.broadcast(heads), KEY).select("doc_id", "text", *KEY, F.col("to").alias("part")).dropDuplicates(["part"])
    return rows.withColumn("halo", F.lit(False)).unionByName(halo.withColumn("halo", F.lit(True)))


def described(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses. The only
    shuffle of texts brings runs of the documents' order together, a run a task; a run's last
    row finds its next document in a copied row, so no text goes to the driver."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = _neighbours(docs, parts).repartitionById(parts, "part").sortWithinPartitions("part", "halo", *KEY).select("part", "halo", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                size += len(row[3])
                if size >= 4_000_000 and len(held) > 1:
                    yield _rows(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield _rows(held)

    return placed.mapInArrow(run, OUT)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    """Results of all rows of held (part, halo, doc_id, text) but the last, halos left out."""
    texts = [r[3] for r in held]
    own, edited, prints = _described(texts, [*texts[1:], ""])
    out = []
    for k, (part, halo, doc_id, text) in enumerate(held[:-1]):
        if halo or held[k + 1][0] != part:
            continue
        follow = own[k + 1]
        shared = len(set(bands(own[k])) & set(bands(prints[k])))
        out.append((doc_id, len(text), hashlib.sha256(edited[k].encode("utf-8", "surrogatepass")).hexdigest(), own[k].hex(), prints[k].hex(), likeness(own[k], prints[k]), likeness(own[k], follow), shared))
    names = [f.split()[0] for f in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)


def op7_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return described(table(spark, sf_dir, "documents"))


QUERIES = {"op7_edit_embedding": op7_edit_embedding}
SQL: dict[str, str] = {}
