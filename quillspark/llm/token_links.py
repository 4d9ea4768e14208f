"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

A text is encoded by a byte-level vocabulary (A, `tokenizers` JSON) and by a piece vocabulary
(B, `sentencepiece` model). Cumulative sums of the tokens' byte lengths are their ends; ends
that both have are the cuts (intersect1d), the place of an end among the cuts is the token's
group (searchsorted), and every A-B pair of tokens that end at one cut is a link (repeats of
the cuts by the product of both numbers of tokens).

Neither vocabulary has a token across a single space between two other characters, so a text
is cut there, and each distinct part of a chunk of documents is encoded and aligned once, many
in one string: both encodings, groups and links of a text are those of its parts in turn. Where vocabulary B has
an entry with an inner space, texts are left whole. B's model has to leave text as it is but
for the space in front (an identity normaliser), which the comparison of bytes verifies.

A chunk is one row: its documents' totals, the parts that each is made of, and how often the
chunk holds each distinct pair of ids. Pairs' counts are summed over the corpus in two shuffles,
the first of them salted; what a chunk needs of them comes back to it by its number, and is
added up over its documents' parts.

Defined results: null and empty texts, and texts whose tokens of A or of B don't join to space
and text, have no tokens, zeros and an empty digest; repeated rows each count; rows without
doc_id count and come out; texts are processed whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe_codec import byte_symbols
from quillspark.llm.common import Workspace, slices, table, whole_text

#: Bytes of text in a chunk (one document at least).
CHUNK = 2 << 20
#: Bytes of parts that are encoded in one string (one part at least).
RUN = 1 << 17
SALTS = 16
#: A single space between two characters that no library takes for white space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
WIDE = "▁"


@dataclass(frozen=True)
class Parts:
    """What both vocabularies make of parts: whether their tokens join to the part, how many
    tokens of A and B, groups and links each has, the groups as printed, and the links of all
    (A's id in the upper half of a long)."""

    ok: np.ndarray
    totals: np.ndarray
    groups: list[str]
    links: np.ndarray


def cuts_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends that both have, and the group of each token of A and of B; ends never fall."""
    distinct_a, distinct_b = (e[np.diff(e, prepend=-1) > 0] for e in (ends_a, ends_b))
    cuts = np.intersect1d(distinct_a, distinct_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def links_of(cuts: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens that end together: their cut, and the places of A's and B's token."""
    first_a, first_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    many_a, many_b = np.searchsorted(ends_a, cuts, "right") - first_a, np.searchsorted(ends_b, cuts, "right") - first_b
    many = many_a * many_b
    cut = np.repeat(np.arange(len(cuts)), many)
    nth = np.arange(len(cut)) - np.repeat(np.cumsum(many) - many, many)
    return cut, first_a[cut] + nth // many_b[cut], first_b[cut] + nth % many_b[cut]


class Aligner:
    """Both vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        as_byte = {c: i for i, c in enumerate(byte_symbols())}
        named = {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        entries = [named.get(i, "") for i in range(max(named) + 1)]
        self.bytes_a = [bytes(as_byte[c] for c in s) if all(c in as_byte for c in s) else s.encode() for s in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(WIDE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, b)), np.int64) for b in (self.bytes_a, self.bytes_b))
        self.divisible = not any(WIDE in p.lstrip(WIDE) for p in pieces)
        #: Ids in decimal with what follows them in print.
        self.printed = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(max(len(entries), len(pieces)))]

    def parts_of(self, texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
        """The distinct parts of texts, and the places among them of each text's own."""
        split = [t.split(" ") if self.divisible else [t] for t in texts]
        if self.divisible:
            # Beside an empty part, or white space at a part's edge, the space is none to cut at.
            odd = {p for p in set().union(*split) if not p or p[0].isspace() or p[-1].isspace()}
            split = [own if odd.isdisjoint(own) else BETWEEN.split(t) for own, t in zip(split, texts, strict=True)]
        flat = list(chain.from_iterable(split))
        names = list(dict.fromkeys(flat))
        index = dict(zip(names, range(len(names)), strict=True))
        places = np.fromiter(map(index.__getitem__, flat), np.int32, len(flat))
        return names, np.split(places, np.cumsum(list(map(len, split)))[:-1])

    def _encoded(self, parts: list[str]) -> list[tuple[int, list[int], list[int]]]:
        """Ids of A and B of runs of parts that are encoded in one string, each with the number
        of its parts; none for a part whose ids don't join to it. Halved until the rest does."""
        joined = " ".join(parts)
        a, b = self.a.encode(" " + joined, add_special_tokens=False).ids, self.b.encode(joined)
        want = (" " + joined).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b)):
            return [(len(parts), a, b)]
        if len(parts) == 1:
            return [(1, [], [])]
        half = len(parts) // 2
        return self._encoded(parts[:half]) + self._encoded(parts[half:])

    def align(self, parts: list[str]) -> Parts:
        """Every part encoded and aligned."""
        sizes = np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts))
        runs, low, held = [], 0, 0
        alone = [not self.divisible or not p or p[0].isspace() or p[-1].isspace() for p in parts]
        for k, n in enumerate(sizes.tolist()):
            if k > low and (held + n > RUN or alone[k] or alone[k - 1]):
                runs += self._encoded(parts[low:k])
                low, held = k, 0
            held += n
        runs += self._encoded(parts[low:]) if parts else []
        ok = np.repeat(np.array([bool(a) for _, a, _ in runs], bool), [n for n, _, _ in runs])
        stops = np.cumsum(np.where(ok, sizes, 0))
        a, b = (np.fromiter(chain.from_iterable(r[side] for r in runs), np.int64, sum(len(r[side]) for r in runs)) for side in (1, 2))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts, group_a, group_b = cuts_of(ends_a, ends_b)
        cut, i, j = links_of(cuts, ends_a, ends_b)
        upto = [np.searchsorted(e, stops, "right") for e in (ends_a, ends_b, cuts)]
        upto.append(np.searchsorted(cut, upto[2]))
        text, at = self._print(a, b, group_a, group_b, upto[2][ok]), np.concatenate([[0], upto[0] + upto[1]]).tolist()
        groups = ["".join(text[x:y]) for x, y in zip(at, at[1:], strict=False)]
        return Parts(ok, np.stack([np.diff(u, prepend=0) for u in upto], 1).astype(np.int64), groups, a[i] << 32 | b[j])

    def _print(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, stops: np.ndarray) -> list[str]:
        """Ids as printed, in the order of groups, those of A first. stops: the groups up to the
        end of each part."""
        if not len(stops):
            return []
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        out = np.empty(len(a) + len(b), np.int64)
        width = len(self.printed) // 4
        out[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = a + width * np.append(group_a[1:] != group_a[:-1], True)
        mark = np.zeros(len(b), np.int64)
        last = np.flatnonzero(np.append(group_b[1:] != group_b[:-1], True))
        mark[last] = 2
        mark[last[stops - 1]] = 3
        out[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = b + width * mark
        return list(map(self.printed.__getitem__, out.tolist()))


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def default_paths() -> tuple[str, str]:
    """Where the installed public vocabularies are, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


DOCS = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_parts", pa.int64())])
CHUNK_OF = "chunk long, docs array<struct<doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_parts long>>, parts binary, part_links binary, links binary, pairs array<long>, counts array<long>"


def _one(values: pa.Array) -> pa.Array:
    """An array that holds values as its one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunk_row(aligner: Aligner, chunk: int, doc_id: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """One row of a chunk of documents: their totals, the places of their parts, each part's
    links as places among the distinct pairs, and how often the chunk holds each pair."""
    live = [k for k, t in enumerate(texts) if t]
    names, split = aligner.parts_of([texts[k] for k in live]) if live else ([], [])
    parts = aligner.align(names)
    totals, digests, sizes, kept = np.zeros((len(texts), 4), np.int64), [""] * len(texts), np.zeros(len(texts), np.int64), []
    for k, at in zip(live, split, strict=True):
        if parts.ok[at].all():
            totals[k], sizes[k] = parts.totals[at].sum(0), len(at)
            digests[k] = hashlib.sha256(";".join(map(parts.groups.__getitem__, at.tolist())).encode()).hexdigest()
            kept.append(at)
    places = np.concatenate(kept) if kept else np.empty(0, np.int32)
    many = parts.totals[:, 3]
    pairs, link = np.unique(parts.links, return_inverse=True)
    times = np.bincount(places, minlength=len(names))
    counts = np.bincount(link, weights=np.repeat(times, many), minlength=len(pairs)).astype(np.int64)
    docs = pa.StructArray.from_arrays([doc_id, *map(pa.array, totals.T), pa.array(digests, pa.string()), pa.array(sizes)], fields=list(DOCS))
    packed = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (places, many, link)]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), _one(docs), *packed, _one(pa.array(pairs, pa.int64())), _one(pa.array(counts, pa.int64()))], ["chunk", "docs", "parts", "part_links", "links", "pairs", "counts"])


def chunks(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """A row for each chunk of documents; see chunk_row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, at = load(*(paths or default_paths())), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", CHUNK):
            yield chunk_row(aligner, at, batch.column("doc_id"), batch.column("text").to_pylist())
            at += 1

    return rows.mapInArrow(run, CHUNK_OF)


def pair_counts(held: DataFrame) -> DataFrame:
    """pair (A's id in the upper half), count and whether it is the highest of its B id."""
    each = held.select(F.pmod("chunk", F.lit(SALTS)).alias("salt"), F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("salt", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n")).where("n > 0")
    totals = each.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("count"))
    return totals.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))


def _added(held: pa.Table, looked: pa.Table) -> pa.Table:
    """Documents of one chunk with the sums of their links' counts."""
    row = held.to_batches()[0]
    docs = row.column("docs").flatten()
    places, many, link = (np.frombuffer(row.column(c)[0].as_buffer(), "<i4").astype(np.int64) for c in ("parts", "part_links", "links"))
    pairs = len(row.column("pairs").flatten())
    at = looked.column("place").to_numpy()
    count, best = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    count[at], best[at] = looked.column("count").to_numpy(), looked.column("best").to_numpy().astype(np.int64)
    stops = np.concatenate([[0], np.cumsum(many)])
    docs_stop = np.concatenate([[0], np.cumsum(docs.field("n_parts").to_numpy())])
    sums = []
    for value in (best, count):
        upto = np.concatenate([[0], np.cumsum(value[link])])
        own = upto[stops[1:]] - upto[stops[:-1]]
        upto = np.concatenate([[0], np.cumsum(own[places])])
        sums.append(pa.array(upto[docs_stop[1:]] - upto[docs_stop[:-1]]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return pa.table([*(docs.field(n) for n in names), *sums], names=[*names, "n_best", "count_sum"])


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row,
    and the linked pairs of ids: a, b, count, best (whether no other has more of its b)."""
    space = Workspace(docs.sparkSession, "token-links")
    held = space.keep(chunks(docs, paths), "chunks", **{"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "2", "parquet.page.size.row.check.min": "2"})
    totals = space.keep(pair_counts(held), "totals")
    # B's vocabulary bounds this side.
    highest = F.broadcast(totals.groupBy("b").agg(F.max("count").alias("most")))
    counts = totals.join(highest, "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    wanted = held.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    looked = wanted.join(counts.drop("b"), "pair").select(F.col("chunk").alias("of"), "place", "count", "best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = held.groupBy("chunk").cogroup(looked.groupBy("of")).applyInArrow(_added, out)
    return found, counts.select(F.shiftright("pair", 32).alias("a"), "b", "count", "best")


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all documents between the byte-level and the piece vocabulary."""
    return align(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op13_token_links": op13_token_links}
SQL: dict[str, str] = {}
