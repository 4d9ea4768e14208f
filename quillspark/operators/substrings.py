"""Which texts hold which of many phrases, by hashes of whole phrases: no text meets every phrase."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that phrases are told apart by before they are hashed.
HEAD = 4
#: Rungs: code points of a phrase that are hashed, the most that it has; all of a phrase up to 32.
RUNGS = (*range(1, 33), 40, 50, 63, 79, 99, 124, 155, 194, 243, 304, 380, 475, 594, 743, 929, 1162, 1453, 1817, 2272, 2840, 3550, 4438, 5548, 6935, 8669, 10837, 13547, 16934, 21168, 26460)
#: Slots of the table of rungs by head, and of that of wanted hashes, which every task gets: their
#: sizes, whatever the phrases.
SLOTS, BITS = 1 << 16, 1 << 26
#: Slots that one row of the table of hashes has.
ROW = 1 << 15
#: Code points that are hashed at once; one text at least.
RUN = 1 << 20
#: Without effect since no sample of texts is taken; a test still sets it.
RARITY = 16
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Hashed:
    """Texts one behind the other, with the hash of any of their substrings."""

    def __init__(self, texts: list[str]):
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        self.row = np.repeat(np.arange(len(texts)), sizes)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        each = (np.concatenate(points).astype(np.uint64) if points else np.empty(0, np.uint64)) * MIX
        each = (each ^ (each >> np.uint64(31))) * MIX
        powers = np.full(len(each) + 1, BASE, np.uint64)
        powers[0] = 1
        self.back = np.full(len(each) + 1, INVERSE, np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(len(each) + 1, np.uint64)
        np.cumsum(each * np.cumprod(powers)[:-1], out=self.sums[1:])

    def starts(self, size: int) -> np.ndarray:
        """Where a substring of that size begins."""
        at = np.arange(len(self.row) - size + 1) if len(self.row) >= size else np.empty(0, np.int64)
        return at[at + size <= self.end[at]]

    def of(self, at: np.ndarray, size: int) -> np.ndarray:
        h = (self.sums[at + size] - self.sums[at]) * self.back[at] + np.uint64(size) * MIX
        h ^= h >> np.uint64(32)
        h *= MIX
        return h ^ (h >> np.uint64(29))


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches in runs of bounded text."""
    for batch in batches:
        texts, low, held = batch.column(column).to_pylist(), 0, 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= RUN or k == len(texts) - 1:
                yield batch.slice(low, k + 1 - low), texts[low : k + 1]
                low, held = k + 1, 0


def _slot(h: Column, size: int) -> Column:
    return F.pmod(h, F.lit(size))


def _hashed(phrases: DataFrame) -> DataFrame:
    """phrase, rung (its number), head and hash of phrases (phrase)."""
    rungs = np.array(RUNGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _runs(batches, "phrase"):
            own, rung = Hashed(texts), np.searchsorted(rungs, [len(t) for t in texts], "right") - 1
            first, head, full = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            for k in np.unique(rung):
                mine = rung == k
                full[mine] = own.of(first[mine], int(rungs[k]))
                head[mine] = own.of(first[mine], min(HEAD, int(rungs[k])))
            yield pa.RecordBatch.from_arrays([batch.column("phrase"), pa.array(rung, pa.int32()), pa.array(head.view(np.int64)), pa.array(full.view(np.int64))], ["phrase", "rung", "head", "hash"])

    return phrases.select("phrase").mapInArrow(run, "phrase string, rung int, head long, hash long")


def _met(texts: DataFrame, rungs: np.ndarray, short: int, wanted: np.ndarray, bits: int) -> DataFrame:
    """id and hash of the substrings of texts (id, text) that may be a phrase: rungs has for each
    slot of a head those that phrases with it have, as bits; short those of phrases without."""

    used = int(np.bitwise_or.reduce(rungs)) | short
    named = [(k, size) for k, size in enumerate(RUNGS) if used >> k & 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _runs(batches, "text"):
            own = Hashed(texts)
            headed = own.starts(HEAD)
            own_rungs = rungs[own.of(headed, HEAD).view(np.int64) % len(rungs)]
            headed, own_rungs = headed[own_rungs != 0], own_rungs[own_rungs != 0]
            rows, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k, size in named:
                if size < HEAD:
                    at = own.starts(size)
                else:
                    at = headed[(own_rungs >> k & 1).astype(bool)]
                    at = at[at + size <= own.end[at]]
                h = own.of(at, size).view(np.int64)
                slot = h % bits
                ok = (wanted[slot >> 3] >> (slot & 7) & 1).astype(bool)
                rows.append(own.row[at[ok]])
                hashes.append(h[ok])
            found = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(hashes)], names="row,hash"))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(found.row)), pa.array(found.hash)], ["id", "hash"])

    own = texts.select("id", "text")
    return own.mapInArrow(run, own.select("id", F.lit(0).cast("long").alias("hash")).schema)


def holding(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """id and phrase_id of every text (id, text) that holds a phrase (phrase_id, phrase), whatever
    their case. Empty and null phrases are held by nothing; ids stand for one text each.

    A text is asked for hashes of whole phrases (of the first code points of those over 32, see
    RUNGS) at the places where some phrase's head of four stands, and for the lengths that phrases
    with that head have; what is some phrase's hash meets that phrase, and the pairs that met are
    tested. So phrases that share their grams, like numbered ones, don't meet each other's texts."""
    t = texts.where("text IS NOT NULL").select("id", F.lower("text").alias("text"))
    own = phrases.where("phrase <> ''").select("phrase_id", F.lower("phrase").alias("phrase"))
    hashed = _hashed(own.select("phrase").distinct())
    rungs, short = np.zeros(SLOTS, np.int64), 0
    for at, mask in hashed.groupBy(F.when(F.col("rung") >= HEAD - 1, _slot(F.col("head"), SLOTS)).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, rung)"))).collect():
        if at is None:
            short = mask
        else:
            rungs[at] = mask
    # Slots of the table of hashes as bitmaps of a row of it each, so that the driver gets no hash.
    slot, row = _slot(F.col("hash"), BITS), min(ROW, BITS)
    wanted = np.zeros(BITS // 8, np.uint8)
    for at, bitmap in hashed.groupBy(F.floor(slot / row)).agg(F.expr(f"bitmap_construct_agg(pmod(pmod(hash, {BITS}), {row}))")).collect():
        wanted[at * row // 8 : (at + 1) * row // 8] = np.frombuffer(bitmap, np.uint8)[: row // 8]
    met = _met(t, rungs, short, wanted, BITS).join(hashed.select("hash", "phrase"), "hash").select("id", "phrase")
    found = met.join(t, "id").where(F.contains("text", "phrase")).select("id", "phrase")
    return found.join(own, "phrase").select("id", "phrase_id")


def cited_sources(facts: DataFrame, verifications: DataFrame, supportive: tuple[str, ...]) -> DataFrame:
    """source and positive (whether a supportive verdict cites it) of the sources of facts (source,
    document, page) that a verification (record_reference, verdict) cites: by the document and page
    that both name, or by a reference that holds the source."""
    from quillspark.operators.review import citation

    refs = verifications.select(F.trim("record_reference").alias("reference"), F.col("verdict").isin(*supportive).alias("good")).where("reference <> ''")
    refs = refs.groupBy("reference").agg(F.max("good").alias("good"))
    named = refs.withColumn("c", citation(F.col("reference"))).select(F.lower("c.document").alias("document"), F.col("c.page").alias("page"), "good").where("document <> ''").groupBy("document", "page").agg(F.max("good").alias("good"))
    own = facts.where(F.trim("source") != "").select("source", F.lower(F.trim("document")).alias("document"), F.col("page").cast("int").alias("page")).distinct()
    parsed = citation(F.col("source"))
    has = (F.coalesce("document", F.lit("")) != "") & (F.coalesce("page", F.lit(0)) != 0)
    own = own.select("source", F.when(has, F.col("document")).otherwise(F.lower(parsed["document"])).alias("document"), F.when(has, F.col("page")).otherwise(parsed["page"].cast("int")).alias("page"))
    exact = own.join(named.withColumn("page", F.col("page").cast("int")), ["document", "page"]).select("source", "good")
    loose = holding(refs.select(F.col("reference").alias("id"), F.col("reference").alias("text")), own.select(F.col("source").alias("phrase_id"), F.trim("source").alias("phrase")).distinct())
    loose = loose.join(refs.withColumnRenamed("reference", "id"), "id").select(F.col("phrase_id").alias("source"), "good")
    return exact.unionByName(loose).groupBy("source").agg(F.coalesce(F.max("good"), F.lit(False)).alias("positive"))
