"""SimHash near-dedup by bit-sliced comparison.

A text's fingerprint has a bit where more than half of its shingles' hashes have it. Equal
fingerprints form one class, and only distinct ones are compared. Two that differ in at most
`radius` bits agree in two of radius + 2 blocks of bits, so each distinct fingerprint is put in
one bucket for every pair of blocks. A bucket of more than HOT fingerprints is dealt anew: the
bits that it leaves open are cut in radius + 1 pieces, of which two near ones agree in one, and
each piece makes buckets of its own, until none is hot. Nothing is left out, and no bucket's
pairs are formed beyond HOT of them.

A task takes its buckets in tiles of many. A tile's fingerprints stand vertically: plane b holds
bit b of all of them, 64 to a word, so that one XOR of a plane with itself shifted by o compares
a bit of all rows with that of the rows o further on. Differences are counted in carry-save
counters, two planes at a time, and words of which every lane has exceeded the radius, belongs
to two buckets or to one component already are abandoned on the way. Only links that join two
components of a tile come out; components of all are found by large-star and small-star.

Defined results: words are runs of anything but white space, with A-Z lower-cased; null and
empty texts have no shingles and fingerprint zero, which links as any other; fewer words than a
shingle has are one shingle; rows of one doc_id are one document with several fingerprints;
rows without doc_id have a fingerprint, link with nothing and have no component; repeated rows
each come out; texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Workspace, slices, table, whole_text
from quillspark.llm.components import components

#: Seed of the hash of a shingle.
SEED = 42
#: Fingerprints of a bucket that are compared with each other.
HOT = 256
#: Fingerprints of a tile.
TILE = 1 << 16
BITS = 64


@dataclass(frozen=True)
class Near:
    """Words a shingle, and the bits by which near fingerprints may differ."""

    words: int = 3
    radius: int = 2


def fingerprint(text: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    own = text.lower().split()  # bytes: A-Z only, and the six white bytes
    if not own:
        return 0
    k = min(words, len(own))
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(own) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low : low + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def prints(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(whole_text(), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            known = {t: fingerprint(t, near.words) for t in set(texts)}
            fp = np.fromiter((known[t] for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _cut(bits: list[int], n: int) -> list[int]:
    """Masks of n runs of bits, of about equal size."""
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def first_masks(radius: int) -> list[int]:
    """The bits that fingerprints of a bucket share: each pair of radius + 2 blocks."""
    return [a | b for a, b in combinations(_cut(list(range(BITS)), radius + 2), 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks of the buckets that a hot one of mask is dealt to."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | m for m in _cut(free, radius + 1)]


def planes_of(fp: np.ndarray, most_shift: int) -> np.ndarray:
    """Bit planes of fingerprints: (64, words), bit i of plane b being bit b of the i-th; words
    of zeros follow, so that planes can be shifted."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.stack([_packed(row, most_shift // 64 + 2) for row in bits.T])


def _packed(flags: np.ndarray, spare: int = 0) -> np.ndarray:
    """Flags as words of 64, with spare words of zeros behind."""
    out = np.zeros((len(flags) // 64 + 1 + spare) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def within(planes: np.ndarray, lanes: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Of the rows i set in lanes (words), those whose fingerprint differs from that of row
    i + shift by at most radius bits."""
    words, low = divmod(shift, 64)
    at = np.flatnonzero(lanes)
    alive = lanes[at]
    counter = [np.zeros(len(at), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(at), np.uint64)

    def differing(b: int) -> np.ndarray:
        plane = planes[b]
        far = plane[at + words]
        if low:
            far = (far >> np.uint64(low)) | (plane[at + words + 1] << np.uint64(64 - low))
        return plane[at] ^ far

    for b in range(0, BITS, 2):
        x, y = differing(b), differing(b + 1)
        half = counter[0] ^ x  # a full adder of the lowest counter and two planes
        carry = (counter[0] & x) | (half & y)
        counter[0] = half ^ y
        for k in range(1, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 6:
            more, equal = over.copy(), np.full(len(at), ~np.uint64(0))
            for k in reversed(range(len(counter))):
                if not radius >> k & 1:
                    more |= equal & counter[k]
                equal &= counter[k] if radius >> k & 1 else ~counter[k]
            alive = alive & ~more
            held = alive != 0
            if not held.any():
                break
            if held.sum() * 4 <= len(held) * 3:
                at, alive, over, counter = at[held], alive[held], over[held], [c[held] for c in counter]
    out = np.zeros(len(lanes), np.uint64)
    out[at] = alive
    return out


def tile_links(fp: np.ndarray, rest: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Rows (i, j) of links that join the components of a tile; rest: how many rows of its
    bucket follow each row."""
    n, out = len(fp), []
    most = int(rest.max(initial=0))
    planes, part = planes_of(fp, most), np.arange(n)
    for shift in range(1, most + 1):
        open_ = rest >= shift
        open_[: n - shift] &= part[: n - shift] != part[shift:]
        near = within(planes, _packed(open_), shift, radius)
        found = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[:n])
        if not len(found):
            continue
        root: dict[int, int] = {}

        def top(x: int, root: dict[int, int] = root) -> int:
            while x in root:
                x = root[x]
            return x

        for i in found.tolist():
            a, b = top(int(part[i])), top(int(part[i + shift]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, i + shift))
        if root:
            to = np.arange(n)
            for x in root:
                to[x] = top(x)
            part = to[part]
    return out


def _linked(buckets: DataFrame, near: Near) -> DataFrame:
    """Of buckets (mask, key, fp, n), sorted by mask and key in each partition: links (u, v) of
    those that aren't hot, and the rows of those that are (mask, key, fp) as they came."""

    def of_tile(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
        last = np.flatnonzero(np.concatenate([(mask[1:] != mask[:-1]) | (key[1:] != key[:-1]), [True]]))
        rest = last[np.searchsorted(last, np.arange(len(fp)))] - np.arange(len(fp))
        return tile_links(fp.view(np.uint64), rest, near.radius)

    def made(u: np.ndarray | None = None, v: np.ndarray | None = None, hot: list[np.ndarray] | None = None) -> pa.RecordBatch:
        n = len(hot[0]) if hot else len(u)
        none = pa.nulls(n, pa.int64())
        columns = [none, none, *map(pa.array, hot)] if hot else [pa.array(u, pa.int64()), pa.array(v, pa.int64()), none, none, none]
        return pa.RecordBatch.from_arrays(columns, ["u", "v", "mask", "key", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def flush(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(rows[0]) and (found := of_tile(*rows)):
                i, j = np.array(found).T
                yield made(rows[2][i], rows[2][j])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp", "n")]
            hot = columns[3] > HOT
            if hot.any():
                yield made(hot=[c[hot] for c in columns[:3]])
            held = [np.concatenate([h, c[~hot]]) for h, c in zip(held, columns, strict=False)]
            if len(held[0]) >= TILE:  # the last bucket may go on
                cut = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                stop = int(cut[-1]) + 1 if len(cut) else 0
                yield from flush([h[:stop] for h in held])
                held = [h[stop:] for h in held]
        yield from flush(held)

    return buckets.select("mask", "key", "fp", "n").mapInArrow(run, "u long, v long, mask long, key long, fp long")


def links(distinct: DataFrame, near: Near, space: Workspace) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp): all that it takes to join their components."""
    spark, of = distinct.sparkSession, "u long, v long"
    masks = first_masks(near.radius)
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    found, at = spark.createDataFrame([], of), 0
    while True:
        # A count over each bucket leaves its rows together and in order: no further shuffle.
        counted = rows.withColumn("n", F.count("*").over(Window.partitionBy("mask", "key"))).where("n > 1")
        made = space.keep(_linked(counted, near), f"links-{at}")
        found = found.unionByName(made.where("u is not null").select("u", "v"))
        hot = made.where("mask is not null").select("mask", "fp")
        if hot.isEmpty():
            return found
        finer = [(m, f) for m in masks for f in finer_masks(m, near.radius)]
        masks = list(dict.fromkeys(f for _, f in finer))
        steps = F.broadcast(spark.createDataFrame([(_signed(m), _signed(f)) for m, f in finer], "mask long, finer long"))
        rows = hot.join(steps, "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")).distinct()
        at += 1


def near_groups(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row."""
    space = Workspace(docs.sparkSession, "simhash")
    rows = space.keep(prints(docs, near), "prints")
    classes = space.keep(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    near_by = links(classes.select("fp"), near, space)
    u, v = (classes.select(F.col("fp").alias(c), F.col("node").alias(f"of_{c}")) for c in ("u", "v"))
    edges = near_by.join(u, "u").join(v, "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    # Fingerprints of one doc_id belong together.
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    own = rows.join(several, "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = components(edges.unionByName(own), space, "parts")
    parts = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(parts, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints differ in two bits or fewer."""
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", digits, "component_id")


QUERIES = {"op12_simhash": op12_simhash}
SQL: dict[str, str] = {}
