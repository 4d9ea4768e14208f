"""Vector code compression: product codes learned by delta-maintained Lloyd rounds.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook. A round reads every vector with the assignment that the round before wrote beside
it, assigns it anew, and writes it again; what is shuffled are only the contributions of
parts whose assignment changed, plus under the new entry and minus under the old, summed
within each task beforehand. They are added to the running sums and counts, which are a table
of their own, and entries are the sums' quotients. All is integers, so neither the order of
rows nor a lost executor changes a result.

The driver sees codebooks and their sums, entries * components numbers whatever the input.

Defined results: rows whose vector is null, or holds a null, NaN or infinity, are dropped; a
component of 2**14 or more counts as 2**14 (so that errors fit a long); a vector shorter than
the longest one counts as continued by zeros, as does the longest one up to a multiple of the
parts; entries start from the rows least by vec_id (nulls last), rows of one vec_id by their
components, and there are fewer of them where there are fewer rows; repeated rows and vec_ids
each count; an empty table gives no rows; other columns are ignored. A label's error that
exceeds a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Workspace, table

#: The largest integer that a component becomes.
MOST = 1 << 24
#: Labels whose totals are sent to all tasks; with more of them, totals are joined by a shuffle.
FEW_LABELS = 100_000
MOVED = "array<struct<part int, entry int, sums array<long>>>"


@dataclass(frozen=True)
class Codec:
    """Parts of a vector, entries of a codebook (256 at most), rounds, and what a component is multiplied by."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def integers(vectors: DataFrame, codec: Codec) -> DataFrame:
    """vec_id, label and v (array of int) of the rows that are kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            x = lists.flatten().to_numpy(zero_copy_only=False)
            fine = np.isfinite(x)
            keep = lists.is_valid().to_numpy(zero_copy_only=False)
            keep[np.repeat(np.arange(len(sizes)), sizes)[~fine]] = False
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(np.where(fine, x, 0) * codec.scale), -MOST, MOST).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(whole))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), held], ["vec_id", "label", "v"]).filter(pa.array(keep))

    return rows.mapInArrow(run, rows.withColumn("v", F.col("v").cast("array<int>")).schema)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of book nearest to each row of x, the first of equals, and its squared distance; both exact."""
    width = max(1, x.shape[1])
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * top * top * width < 1 << 53:  # every sum is an integer that a double holds
        f, b = x.astype(np.float64), book.astype(np.float64)
        d = (b * b).sum(1) - 2 * (f @ b.T)
        at = d.argmin(1)
        return at, (d[np.arange(len(x)), at] + (f * f).sum(1)).astype(np.int64)
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, (1 << 21) // (len(book) * width))
    for low in range(0, len(x), step):
        d = ((x[low : low + step, None, :] - book[None]) ** 2).sum(2)
        at[low : low + step] = d.argmin(1)
        far[low : low + step] = d.min(1)
    return at, far


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, those that are shorter than width continued by zeros."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    first = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(first, sizes)] = flat
    return out


def contributions(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """What rows x of one part add to each entry's count (first column) and sums, when their
    assignment goes from old to new. Rows that stay add nothing."""
    moved = np.ones(len(x), bool) if old is None else old != new
    gone = np.zeros(0, np.int64) if old is None else old[moved]
    key = np.concatenate([new[moved], gone])
    sign = np.concatenate([np.ones(int(moved.sum())), -np.ones(len(gone))])
    values = np.concatenate([x[moved], x[moved][: len(gone)]]) * sign[:, None]
    columns = [np.bincount(key, weights=w, minlength=entries) for w in (sign, *values.T)]
    return np.stack(columns, 1).astype(np.int64)


def _assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with their code by books (parts, entries, components), and after each task's rows
    one of moved: its net contributions to counts and sums."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, schema = np.zeros((parts, entries, width + 1), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), parts * width)
            old = batch.column("code")
            before = None if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            code = np.empty((len(x), parts), np.uint8)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                at, _ = nearest(own, books[p])
                net[p] += contributions(own, None if before is None else before[:, p], at, entries)
                code[:, p] = at
            held = pa.array([c.tobytes() for c in code], pa.binary())
            moved = pa.nulls(len(x), pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64()))])))
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), held, moved], ["vec_id", "label", "v", "code", "moved"])
            schema = out.schema
            yield out
        if schema is not None:
            changed = np.argwhere(net.any(2)).tolist()
            moved = [{"part": p, "entry": e, "sums": net[p, e].tolist()} for p, e in changed]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in schema if f.name != "moved"), pa.array([moved], schema.field("moved").type)], schema=schema)

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast(MOVED).alias("moved")).schema)


def learn(vectors: DataFrame, codec: Codec, space: Workspace) -> tuple[DataFrame, np.ndarray] | None:
    """The kept vectors as a table (vec_id, label, v, code of the last round), and the codebooks
    (parts, entries, components). None if no vector is kept."""
    rows = space.keep(integers(vectors, codec).withColumn("code", F.lit(None).cast("binary")), "vectors-0")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // codec.parts)
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(codec.entries).collect()
    seeds = np.array([[*r.v, *[0] * (codec.parts * width - len(r.v))] for r in first], np.int64).reshape(len(first), codec.parts, width)
    books = np.ascontiguousarray(seeds.transpose(1, 0, 2))
    sums = None
    for at in range(1, codec.rounds + 1):
        both = space.keep(_assigned(rows, books), f"vectors-{at}")
        rows = both.where("moved is null").drop("moved")
        each = both.where("moved is not null").select(F.explode("moved").alias("m")).select("m.part", "m.entry", F.posexplode("m.sums").alias("place", "total"))
        added = each if sums is None else each.unionByName(sums)
        sums = space.keep(added.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")), f"sums-{at}")
        state = np.zeros((*books.shape[:2], width + 1), np.int64)
        for part, entry, place, total in sums.collect():
            state[part, entry, place] = total
        used = state[:, :, 0] > 0
        books = np.where(used[:, :, None], state[:, :, 1:] // np.maximum(state[:, :, :1], 1), books)
        space.drop(f"vectors-{at - 1}")
        space.drop(f"sums-{at - 1}")
        space.release()
    return rows, books


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (hex, two digits a part) and error of rows by codebooks."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code = np.stack([at for at, _ in found], 1).astype(np.uint8)
            error = sum((far for _, far in found), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    own = rows.select("vec_id", "label", "v")
    return own.mapInArrow(run, own.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema)


def compress(vectors: DataFrame, codec: Codec = Codec()) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept vector."""
    space = Workspace(vectors.sparkSession, "vector-codes")
    learned = learn(vectors, codec, space)
    if learned is None:
        none = vectors.limit(0).select(F.col("vec_id").cast("long").alias("vec_id"), "label")
        return none.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows, books = learned
    found = space.keep(encoded(rows, books), "codes")
    totals = space.keep(found.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    small = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    return found.join(small, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings: 4 parts of 256 entries, 4 rounds."""
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _sql(codec: Codec) -> str:
    """The same in SQL, round by round, for vectors of one length that the parts divide."""
    kept = f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codec.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, label, p, v[CAST(p * (len(v) // {codec.parts}) + 1 AS BIGINT) : CAST((p + 1) * (len(v) // {codec.parts}) AS BIGINT)] AS x FROM kept, range({codec.parts}) t(p)),
    seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept),
    book0 AS MATERIALIZED (SELECT p, e, x FROM parts JOIN seeds USING (vec_id) WHERE e < {codec.entries})"""
    steps = []
    for k in range(codec.rounds + 1):
        steps.append(f"""at{k} AS MATERIALIZED (SELECT vec_id, p, min({{'d': list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best FROM parts a JOIN book{k} b USING (p) GROUP BY vec_id, p)""")
        if k < codec.rounds:
            steps.append(f"""each{k} AS (SELECT p, best.e AS e, unnest(x) AS c, unnest(range(len(x))) AS i FROM at{k} JOIN parts USING (vec_id, p)),
    means{k} AS (SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM each{k} GROUP BY p, e, i),
    moved{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM means{k} GROUP BY p, e),
    book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN moved{k} m USING (p, e))""")
    last = codec.rounds
    return f"""WITH {kept}, {", ".join(steps)},
    flat AS (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS i FROM book{last}),
    digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM flat),
    found AS (SELECT vec_id, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM at{last} GROUP BY vec_id)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM found JOIN kept USING (vec_id), digest"""


SQL = {"op11_vector_codes": _sql(Codec())}
