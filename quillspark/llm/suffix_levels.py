"""Suffix-array dedup by a logarithmic index family.

Suffixes are sampled by content: in every string of LENGTH bytes the K-byte piece of least
hash is its anchor, so equal strings have equal anchors, and a text keeps about one suffix
in 85. A suffix is entered under the hashes of REACH bytes from its anchor on and of the
REACH bytes around its start: every string of LENGTH bytes contains one of the two whole.
Documents come in batches. A batch's suffixes are sorted by key into an array; the array is
merge-scanned against every existing level for equal keys, and becomes a level of its own;
two levels of one size merge into one of twice the size. Levels are bucketed tables sorted
by key, so scans and merges read them in order, without a shuffle. (Arrays are in the order
of the keys' hashes, not of the alphabet: only equal prefixes have to meet, and a suffix
then takes 8 bytes.)

What shares a key may be a match of LENGTH bytes. The bytes around each such suffix are
compared: equal surroundings at once, others string by string, so exactly the bytes covered
by a repeated string of LENGTH bytes are removed. Texts that are equal as wholes are indexed
once. Equality of strings is that of 64-bit hashes, of whole surroundings of 128-bit ones.

Defined results: null is empty; texts under LENGTH bytes, and empty tables, lose nothing; all
copies of a text of LENGTH bytes or more lose everything; matches never cross documents;
other columns are ignored; rows need no unique doc_id. Suffixes of a text longer than SPLIT are
found in pieces that overlap by LENGTH - 1 bytes, so that every string lies in one of them whole;
no text is refused for its length.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Workspace, slices, table, whole_text

LENGTH, K = 200, 32
SPAN = LENGTH - K + 1
HALF = SPAN // 2
REACH = LENGTH - HALF
BATCHES = 4
#: A key with more different surroundings is compared row by row over all executors, not within a task.
MOST_AROUND = 2000
PLACE = 28
_rng = np.random.default_rng(200)
BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 17
#: A task holds about a hundred bytes for each byte of a piece. The result doesn't depend on it.
SPLIT = 1 << 20


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * M1 + b
    x ^= x >> np.uint64(32)
    x *= M2
    x ^= x >> np.uint64(29)
    return x


def pieces(data: np.ndarray, size: int = K) -> np.ndarray:
    """A hash of the size bytes (a power of two) from each place on; the last size - 1 places have none."""
    h = BYTE[data]
    step = 1
    while step < size:
        h = _join(h[:-step], h[step:])
        step *= 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, by running minima from both sides of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    ahead = np.minimum.accumulate(padded.reshape(-1, width), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Anchors:
    """Anchors of some texts: for each the text, the anchor's place in it, and the first and
    last start of the strings it stands for; and keys, the two kinds apart."""

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        h = pieces(data)
        self.h = h
        place = np.arange(len(h), dtype=np.uint64)
        least = _least(h >> np.uint64(PLACE) << np.uint64(PLACE) | place, SPAN)
        at = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
        inside = np.arange(len(at)) + LENGTH <= ends[of]
        start = np.flatnonzero(inside)
        new = np.ones(len(start), bool)
        new[1:] = (at[start[1:]] != at[start[:-1]]) | (of[start[1:]] != of[start[:-1]])
        head = np.flatnonzero(new)
        self.at = at[start[head]]
        self.first = start[head]
        self.last = start[np.append(head[1:], len(start)) - 1] if len(head) else start[head]
        self.of = of[start[head]]
        self.base = ends - sizes

    def _key(self, places: np.ndarray, seed: int) -> np.ndarray:
        """A hash of REACH bytes from each place on."""
        h, x = self.h, np.full(len(places), seed, np.uint64)
        for d in (*range(0, REACH - K, K), REACH - K):
            x = _join(x, h[places + d])
        return x.astype(np.int64)

    def entries(self) -> tuple[np.ndarray, ...]:
        """key, text, first and last start of the strings, offset of the anchor in the first."""
        ahead = np.flatnonzero(self.at - self.last < HALF)
        around = np.flatnonzero(self.at - self.first >= HALF)
        key = np.concatenate([self._key(self.at[ahead], 1), self._key(self.at[around] - HALF, 2)])
        first = np.concatenate([np.maximum(self.first[ahead], self.at[ahead] - HALF + 1), self.first[around]])
        last = np.concatenate([self.last[ahead], np.minimum(self.last[around], self.at[around] - HALF)])
        return key, np.concatenate([self.of[ahead], self.of[around]]), first, last, np.concatenate([self.at[ahead], self.at[around]]) - first


def _packs(texts: list[bytes], split: int) -> Iterator[tuple[np.ndarray, int, list[bytes], bool]]:
    """Texts of LENGTH bytes or more in runs of about PIECE bytes, with their numbers. One of more
    than split comes alone, in pieces: where each begins, and whether it is the last."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > split:
            starts = range(0, len(texts[at]) - LENGTH + 1, split)
            for start in starts:
                yield np.array([at]), start, [texts[at][start : start + split + LENGTH - 1]], start == starts[-1]
            at += 1
            continue
        stop, held = at, 0
        while stop < len(texts) and len(texts[stop]) <= split and (stop == at or held + len(texts[stop]) <= PIECE):
            held += len(texts[stop])
            stop += 1
        yield np.arange(at, stop), 0, texts[at:stop], True
        at = stop


def _keys(texts: list[bytes], split: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, the number of the text, and whether the key is there more than once in it. The run
    of an anchor over a border of pieces counts twice, which makes a candidate more and no result."""
    held = []
    for numbers, _, some, last in _packs(texts, split):
        key, of, *_ = Anchors(some).entries()
        held.append((key, numbers[of]))
        if not last:
            continue
        key, of = (np.concatenate(c) for c in zip(*held, strict=True))
        held = []
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        same = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
        keep = np.append(True, ~same)
        yield key[keep], of[keep], np.append(same, False)[keep]


def _addressed(docs: DataFrame, *more: str) -> DataFrame:
    """owner (of a text, the same for equal texts), n_bytes, sha, text and the columns named."""
    text = F.encode(whole_text(), "UTF-8")
    rows = docs.select(*more, text.alias("text")).withColumn("sha", F.sha2("text", 256))
    return rows.select(*more, F.xxhash64("sha").alias("owner"), F.length("text").cast("long").alias("n_bytes"), "sha", "text")


def suffixes(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """key, owner and twice (the key is there more than once in that text) of all sampled suffixes."""
    rows = _addressed(docs).where(F.col("n_bytes") >= LENGTH).select("owner", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owners, texts = batch.column("owner").to_numpy(), batch.column("text").to_pylist()
            for key, of, twice in _keys(texts, split):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owners[of]), pa.array(twice)], ["key", "owner", "twice"])

    return rows.mapInArrow(run, "key long, owner long, twice boolean")


class Levels:
    """The index family: level i, if there, holds the keys of 2**i batches, in bucketed, sorted files."""

    def __init__(self, space: Workspace, buckets: int | None = None):
        self.space, self.spark = space, space.spark
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"level_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", f"{self.space.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.space.drop(name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Enter a batch (key, owner, twice); the keys of it that match: within the batch, or a level."""
        array = self._write(batch.groupBy("key").agg((F.max("twice") | (F.min("owner") != F.max("owner"))).alias("again")))
        own = self.spark.table(array)
        found = [own.where("again").select("key")]
        found += [own.join(self.spark.table(level).hint("merge"), "key").select("key") for level in self.levels.values()]
        matches = self.space.keep(_union(found).distinct(), f"matches_{array}")
        size, name = 0, array
        while size in self.levels:
            other = self.levels.pop(size)
            merged = self._write(self.spark.table(name).select("key").join(self.spark.table(other).select("key").hint("merge"), "key", "full_outer").select("key"))
            self._drop(name)
            self._drop(other)
            size, name = size + 1, merged
        self.levels[size] = name
        return matches

    def close(self) -> None:
        for name in self.levels.values():
            self._drop(name)
        self.levels = {}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


AROUND = "owner long, key long, around binary, start long, lead int, bytes binary"


def _surroundings(texts: DataFrame, split: int) -> DataFrame:
    """For every suffix whose key matches: where its strings begin, the bytes they cover
    together, the anchor's offset (lead), and around, the name of all that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            owners, texts_, keys = batch.column("owner").to_numpy(), batch.column("text").to_pylist(), batch.column("keys")
            for numbers, start, some, _ in _packs(texts_, split):
                key, of, first, last, lead = (a := Anchors(some)).entries()
                data, out = a.data.tobytes(), []
                for i, number in enumerate(numbers.tolist()):
                    mine = np.flatnonzero(of == i) if len(some) > 1 else np.arange(len(key))
                    wanted = keys[number].values.to_numpy()
                    mine = mine[np.isin(key[mine], wanted)]
                    base = int(a.base[i]) - start
                    for j in mine.tolist():
                        cut = data[first[j] : last[j] + LENGTH]
                        name = xxhash.xxh3_128_digest(cut + int(lead[j]).to_bytes(4, "little") + int(key[j]).to_bytes(8, "little", signed=True))
                        out.append((int(owners[number]), int(key[j]), name, int(first[j]) - base, int(lead[j]), cut))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["owner", "key", "around", "start", "lead", "bytes"])

    return texts.mapInArrow(run, AROUND)


def _strings(cuts: list[bytes], leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of LENGTH bytes in the cuts: which cut, its number there, and a hash of it and of its anchor's offset."""
    data = np.frombuffer(b"".join(cuts), np.uint8)
    sizes = np.array([len(c) for c in cuts], np.int64)
    count = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(cuts)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(np.cumsum(sizes) - sizes, count) + number
    h = pieces(data, 128)
    return of, number, _join(_join(h[place], h[place + LENGTH - 128]), (leads[of] - number).astype(np.uint64))


def _runs(of: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of consecutive numbers: cut, first and last."""
    if not len(of):
        return []
    new = np.append(True, (of[1:] != of[:-1]) | (number[1:] != number[:-1] + 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(of)) - 1
    return list(zip(of[head].tolist(), number[head].tolist(), number[tail].tolist(), strict=True))


RUNS = "around binary, low int, high int"


def _repeated(rows: DataFrame) -> DataFrame:
    """Runs of strings (by number, both ends in) that more than one of a key's surroundings
    have. rows: key, around, lead, bytes, a key's together and in order; a key's rows fit a task."""

    def resolve(held: list[tuple]) -> pa.RecordBatch | None:
        of, number, h = _strings([r[3] for r in held], np.array([r[2] for r in held], np.int64))
        mark = _join(np.array([r[0] for r in held], np.int64).astype(np.uint64)[of], h)
        _, back, times = np.unique(mark, return_inverse=True, return_counts=True)
        some = times[back] > 1
        found = _runs(of[some], number[some])
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array([held[i][1] for i, _, _ in found], pa.binary()), pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())], ["around", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            while len(held) > 2 * MOST_AROUND:
                cut = next((k for k in range(2 * MOST_AROUND, 0, -1) if held[k][0] != held[k - 1][0]), None) or next((k for k in range(2 * MOST_AROUND, len(held)) if held[k][0] != held[k - 1][0]), len(held))
                if cut == len(held):
                    break
                if (out := resolve(held[:cut])) is not None:
                    yield out
                held = held[cut:]
        if held and (out := resolve(held)) is not None:
            yield out

    return rows.mapInArrow(run, RUNS)


def _repeated_hot(rows: DataFrame) -> DataFrame:
    """The same for keys with very many surroundings: a row for each string, counted over all executors."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 17):
            key, around, lead, cuts = (c.to_pylist() for c in batch.columns)
            of, number, h = _strings(cuts, np.array(lead, np.int64))
            mark = _join(np.array(key, np.int64).astype(np.uint64)[of], h).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(around, pa.binary()).take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(mark)], ["around", "number", "mark"])

    spelt = rows.mapInArrow(spell, "around binary, number int, mark long")
    often = spelt.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    same = spelt.join(often, "mark", "left_semi")
    numbers = same.groupBy("around").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    pair = F.transform("numbers", lambda n: F.struct(n.alias("low"), n.alias("high")))
    return numbers.select("around", F.explode(pair).alias("r")).select("around", "r.low", "r.high")


OUT = "owner long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(texts: DataFrame, with_spans: bool) -> DataFrame:
    """What is left of each text (owner, text, hits: array of start and end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for owner, text, hits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                spans: list[list[int]] = []
                for low, high in sorted((h["low"], h["high"]) for h in hits):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                ends = [0, *[x for s in spans for x in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((owner, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans] if with_spans else []))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["owner", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.select("owner", "text", "hits").mapInArrow(run, OUT)


def dedup(docs: DataFrame, with_spans: bool = False, batches: int = BATCHES, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with_spans adds spans,
    the bytes removed."""
    spark = docs.sparkSession
    space = Workspace(spark, "suffixes")
    own = space.keep(_addressed(docs, "doc_id").select("doc_id", "owner", "n_bytes", "sha"), "own")
    entered = space.keep(suffixes(docs, split), "entered")
    index = Levels(space)
    matches = [index.add(entered.where(F.pmod("owner", F.lit(batches)) == b)) for b in range(batches)]
    index.close()
    # Owners differ between batches, so a key can match in several of them.
    keys = _union(matches).distinct()
    wanted = entered.join(keys, "key", "left_semi").groupBy("owner").agg(F.collect_set("key").alias("keys"))
    wanted = space.keep(wanted, "wanted")
    space.drop("entered")
    space.release()
    once = _addressed(docs).where(F.col("n_bytes") >= LENGTH).groupBy("owner").agg(F.any_value("text").alias("text"))
    texts = space.keep(once.join(wanted, "owner"), "texts")
    space.release()
    found = space.keep(_surroundings(texts, split), "around")
    named = found.groupBy("around").agg(F.any_value("key").alias("key"), F.any_value("lead").alias("lead"), F.any_value("bytes").alias("bytes"), F.count("*").alias("n"))
    named = space.keep(named, "named")
    space.release()
    # Surroundings that recur are repeated as wholes; a key's others are compared with all of that key.
    several = named.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    rest = named.select("key", "around", "lead", "bytes")
    normal = rest.join(several.where(F.col("kinds") <= MOST_AROUND).select("key"), "key", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = _repeated(normal.repartition(parts, "key").sortWithinPartitions("key"))
    hot = _repeated_hot(rest.join(several.where(F.col("kinds") > MOST_AROUND).select("key"), "key", "left_semi"))
    whole = named.where("n > 1").select("around", F.lit(0).alias("low"), (F.length("bytes") - LENGTH).alias("high"))
    runs = space.keep(runs.unionByName(hot).unionByName(whole), "runs")
    hits = found.select("owner", "around", "start").join(runs, "around").select("owner", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + LENGTH).alias("high")).alias("hit"))
    hits = hits.groupBy("owner").agg(F.collect_list("hit").alias("hits"))
    left = space.keep(_cut(texts.select("owner", "text").join(hits, "owner"), with_spans), "left")
    space.release()
    copies = own.groupBy("owner").agg(F.count("*").alias("copies")).where("copies > 1")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    out = own.join(copies, "owner", "left").join(left, "owner", "left").withColumn("_gone", F.coalesce(gone, F.lit(False)))
    nothing = hashlib.sha256(b"").hexdigest()
    result = out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("_gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_gone"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("_gone"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(F.col("_gone"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans")] if with_spans else []),
    )
    return result


def op5_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that lie in a repeated string of LENGTH bytes."""
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_levels": op5_suffix_levels}
SQL: dict[str, str] = {}
