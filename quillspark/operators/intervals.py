"""Intervals of any width: points in them, and bytes restored from windows that overlap."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.columns import once, worked_out

#: The printed forms of a backup's key.
LIVE = r"^audit/(\d{4}/\d{2}/\d{2})/live-(.+?)-g([0-9a-f]+)-(\d+)-(\d+)-([0-9a-f]{12})\.jsonl$"
LEGACY = r"^audit/(\d{4}/\d{2}/\d{2})/live-(.+?)-(\d+)-(\d+)-([0-9a-f]{12})\.jsonl$"
ROTATED = r"^audit/(\d{4}/\d{2}/\d{2})/rotated-(.+?)-(\d+)-([0-9a-f]{12})\.jsonl$"
UNKNOWN = "unknown"
PARTS = {"kind": "string", "date": "string", "filename": "string", "generation": "string", "start": "long", "end": "long", "size": "long", "sha": "string"}


def points_in(points: DataFrame, intervals: DataFrame, at: str = "at", low: str = "low", high: str = "high", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every point with every interval [low, high) that it lies in; both of whole numbers, met
    within equal keys. Columns of both sides; other names have to differ.

    An interval stands in the one or two cells, of the least power of two that is not below its
    width, that it touches; a point looks up its cell once for each width in use, 64 at most. So
    neither a very wide interval nor a crowd of narrow ones makes more than two rows of one. Empty
    intervals and nulls meet nothing."""
    width = F.col(high) - F.col(low)
    sized = intervals.where(width > 0).withColumn("_level", F.length(F.bin(width - 1)) - (width == 1).cast("int"))
    cells = F.array_distinct(F.array(F.expr(f"shiftright(CAST({low} AS BIGINT), _level)"), F.expr(f"shiftright(CAST({high} AS BIGINT) - 1, _level)")))
    sized = sized.withColumn("_cell", F.explode(cells))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())
    looked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_cell", F.expr(f"shiftright(CAST({at} AS BIGINT), _level)"))
    met = looked.join(sized, [*keys, "_level", "_cell"])
    return met.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_level", "_cell")


def key_parts(key: Column) -> Column:
    """struct(kind, date, filename, generation, start, end, size, sha) of a backup's key: a live
    window with or without its file's generation, or a rotated file; null for any other."""

    def row(kind: str, pattern: str, *groups: str, **fixed: Column) -> Column:
        """The pattern's groups come out of one match: no line feed is in any, so one parts them."""
        cut = F.split(F.regexp_replace(key, pattern, "\n".join(f"${n}" for n in range(1, len(groups) + 1))), "\n")

        def fields(found: Column) -> Column:
            own = {name: F.get(found, F.lit(n)) for n, name in enumerate(groups)} | {"kind": F.lit(kind)} | fixed
            return F.struct(*[own.get(name, F.lit(None)).cast(PARTS[name]).alias(name) for name in PARTS])

        return F.when(key.rlike(pattern), once(cut, fields))

    live = row("live", LIVE, "date", "filename", "generation", "start", "end", "sha")
    legacy = row("live", LEGACY, "date", "filename", "start", "end", "sha", generation=F.lit(UNKNOWN))
    return F.coalesce(live, legacy, row("rotated", ROTATED, "date", "filename", "size", "sha"))


def verified(windows: DataFrame, content: str = "content") -> DataFrame:
    """windows (key, content, ...) with parts, and what is wrong with them: no key, size or sha of
    the content against its key; "" if nothing is. Both are worked out once for each window."""
    named = worked_out(windows, parts=key_parts(F.col("key")))
    size = F.coalesce(F.col("parts.size"), F.col("parts.end") - F.col("parts.start"))
    wrong = F.when(F.col("parts").isNull(), "key").when(F.coalesce(F.length(content), F.lit(-1)) != size, "size").when(F.substring(F.sha2(content, 256), 1, 12) != F.col("parts.sha"), "sha")
    return worked_out(named, wrong=F.coalesce(wrong, F.lit("")))


def generations(windows: DataFrame) -> DataFrame:
    """windows (id, file, generation, uploaded, start, end, unfit, ...) with island: the number of their
    run of one generation in the order of upload (ties by start, end, then id); null for those that
    are unfit, which part no run."""
    order = Window.partitionBy("file").orderBy("unfit", "uploaded", "start", "end", "id")
    turned = F.coalesce((F.col("generation") != F.lag("generation").over(order)).cast("int"), F.lit(1))
    return windows.withColumn("island", F.when(~F.col("unfit"), F.sum(turned).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1))


def covers(windows: DataFrame, cell: int = 1 << 24) -> DataFrame:
    """file, island, start, end and window (its id) of runs of bytes by the window that holds them
    last: the stretches of held, joined again over the borders of cells."""
    newest = held(windows, cell)
    order = Window.partitionBy("file", "island").orderBy("from")
    fresh = F.coalesce(((F.lag("upto").over(order) != F.col("from")) | (F.lag("window").over(order) != F.col("window"))).cast("int"), F.lit(1))
    runs = newest.withColumn("run", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file", "island", "run").agg(F.min("from").alias("start"), F.max("upto").alias("end"), F.any_value("window").alias("window")).drop("run")


def held(windows: DataFrame, cell: int = 1 << 24) -> DataFrame:
    """file, island, from, upto and window (its id) of stretches of bytes by the window that holds them
    last: of windows (file, island, id, uploaded, start, end) that overlap, the later upload (ties
    by id) is the one that counts for the bytes it covers.

    Windows are cut at the borders of cells and dealt out by cell, and a task goes through each
    cell's once, in order of their start: what it holds is the windows that are open, however
    long a file is."""
    live = windows.where("end > start")
    first, last = F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)
    cut = live.withColumn("cell", F.explode(F.sequence(first, last)))
    at = ["file", "island", "cell"]
    cut = cut.select(*at, F.greatest("start", F.col("cell") * cell).alias("low"), F.least("end", (F.col("cell") + 1) * cell).alias("high"), "uploaded", F.col("id").alias("window")).repartition(*at)
    turn = F.row_number().over(Window.partitionBy(*at).orderBy("uploaded", "window"))
    dealt = cut.select(*at, "low", "high", turn.alias("turn"), "window").sortWithinPartitions(*at, "low")
    kinds = dict(dealt.dtypes)
    return dealt.mapInArrow(_newest, f"file {kinds['file']}, island {kinds['island']}, from long, upto long, window {kinds['window']}")


def _values(column: pa.Array) -> list:
    """As Python values; by numpy, many times as fast, where it has the same."""
    same = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_string(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if same else column.to_pylist()


def _newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the window of the last turn, of windows (file, island, cell, low, high, turn, window)
    sorted by cell and low."""
    here, open_, at, out = None, [], 0, []

    def upto(limit: float) -> None:
        """Hands on what lies before limit."""
        nonlocal at
        while open_ and at < limit:
            _, high, window = open_[0]
            if high > at:
                end = min(high, limit)
                if out and out[-1][4] == window and out[-1][3] == at and out[-1][:2] == here[:2]:
                    out[-1] = (*here[:2], out[-1][2], end, window)
                else:
                    out.append((*here[:2], at, end, window))
                at = end
            if high <= at:
                heapq.heappop(open_)

    names, kinds = ("file", "island", "from", "upto", "window"), None
    for batch in batches:
        file, island, _, low, _, _, window = batch.schema.types
        kinds = (file, island, low, low, window)
        for *cell, low, high, turn, window in zip(*map(_values, batch.columns), strict=True):
            if cell != here:
                upto(math.inf)
                here = cell
                open_.clear()
            upto(low)
            at = low
            heapq.heappush(open_, (-turn, high, window))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names)
        out.clear()
    upto(math.inf)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def restored(windows: DataFrame, cell: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """Files out of their backed-up windows (id, key, uploaded, content). The bytes: file, island,
    start, end, window and data, in pieces whose order is (island, start). And the files' report:
    generations, windows, superseded (windows of which no byte counts), damaged (that don't fit
    their key, and are left out), holes and missing bytes within generations (whose first byte is 0),
    and whether the order of generations is uncertain, as two began with one upload time."""
    known = verified(windows).where("parts IS NOT NULL AND parts.kind = 'live'")
    flat = known.select("id", "uploaded", "content", (F.col("wrong") != "").alias("unfit"), F.col("parts.filename").alias("file"), *[F.col(f"parts.{c}").alias(c) for c in ("generation", "start", "end")])
    placed = generations(flat.drop("content"))
    fit = placed.where("island IS NOT NULL")
    data = F.substring("content", (F.col("start") - F.col("from") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    content = flat.select(F.col("id").alias("window"), F.col("start").alias("from"), "content")
    pieces = covers(fit, cell).join(content, "window").select("file", "island", "start", "end", "window", data.alias("data"))
    order = Window.partitionBy("file", "island").orderBy("from")
    gap = F.col("from") - F.coalesce(F.lag("upto").over(order), F.lit(0))
    used = held(fit, cell).withColumn("gap", gap).groupBy("file", "island", "window").agg(F.count_if(F.col("gap") > 0).alias("holes"), F.sum("gap").alias("missing"))
    used = used.groupBy("file").agg(F.count("*").alias("used"), F.sum("holes").alias("holes"), F.sum("missing").alias("missing"))
    # Damaged windows are told by their island too, so that the counts and the runs need the same shuffle, which Spark then reads twice and makes once.
    each = placed.groupBy("file", "island").agg(F.count("*").alias("n"), F.min("uploaded").alias("began"))
    damaged = F.coalesce(F.sum(F.when(F.col("island").isNull(), F.col("n"))), F.lit(0))
    uncertain = F.count_distinct(F.when(F.col("island").isNotNull(), F.col("began"))) < F.count("island")
    told = each.groupBy("file").agg(F.sum("n").alias("windows"), damaged.alias("damaged"), F.count("island").alias("generations"), uncertain.alias("uncertain"))
    superseded = F.col("windows") - F.col("damaged") - F.col("used")
    counted = told.join(used, "file", "left").fillna({"used": 0, "holes": 0, "missing": 0})
    return pieces, counted.select("file", "windows", superseded.alias("superseded"), "damaged", "holes", "missing", "generations", "uncertain")
