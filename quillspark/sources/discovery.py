"""Which files a run takes, by their metadata alone, and the tail of rotated logs.

Discovery reads no content. Sizes decide before any file is opened: Spark's reader of binary
files skips by length, so that files beyond the cut are never read.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of record files.
SUFFIXES = ("pdf", "txt", "md", "docx", "zip")
#: Bytes of one file, and of all together.
MOST_FILE, MOST_TOTAL = 50 << 20, 500 << 20
#: Lengths are counted in steps of 2**STEP bytes first, then by the byte in the step that matters.
STEP = 12
#: Fixed value: a reference by its prefix, or an identifier of hexadecimal digits.
REFERENCE = r"(req_[a-f0-9]{12}|[a-f0-9-]{32,36})"


def _plain(path: str) -> str:
    """A path without scheme and host, as both sides of a comparison need it."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    return (bare if bare.startswith("/") else os.path.abspath(bare)).rstrip("/") or "/"


def discovered(spark: SparkSession, paths: list[str], outputs: str | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, label (relative to its entry), length and modified of every record file below paths.

    A named file is taken whatever it is called. Below a folder, only the suffixes are, hidden
    files and folders aren't, and nothing below outputs. What is reached twice counts once, at
    its first entry. Names that start with an underscore are hidden for Spark, too."""
    found = None
    for entry, path in enumerate(paths):
        root = _plain(path)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
        bare = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
        below = F.when(bare != root, F.substring(bare, len(root.rstrip("/")) + 2, 1 << 20))
        shown = ~below.rlike(r"(^|/)\.") & F.lower(F.substring_index(below, ".", -1)).isin(*suffixes) & below.contains(".")
        if outputs is not None:
            shown &= ~F.startswith(bare, F.lit(_plain(outputs) + "/"))
        files = files.where(below.isNull() | shown).select("path", F.coalesce(below, F.substring_index("path", "/", -1)).alias("label"), "length", "modified", F.lit(entry).alias("_entry"))
        found = files if found is None else found.unionByName(files)
    if found is None:
        return spark.createDataFrame([], "path string, label string, length long, modified timestamp")
    first = F.min_by(F.struct("label", "length", "modified"), "_entry").alias("_first")
    return found.groupBy("path").agg(first).select("path", "_first.*")


def _below(counts: DataFrame, most: int) -> tuple[int | None, int]:
    """Of rows (k, bytes) in order of k: the first k at which the sum passes most (none: null), and the sum before it."""
    before = F.sum("bytes").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    row = counts.withColumn("before", before).where(F.col("before") + F.col("bytes") > most).orderBy("k").first()
    return (None, 0) if row is None else (row.k, row.before)


def admitted(files: DataFrame, most_file: int = MOST_FILE, most_total: int = MOST_TOTAL) -> DataFrame:
    """Adds reason: empty for what a run takes. A file over most_file is too large. If the rest
    passes most_total, the smallest are taken first, equal lengths by path.

    Sums run over counts by length (most_file / 4096 rows, then 4096), and only files of
    the one length at which the total is passed are put in order."""
    fitting = files.where(F.col("length") <= most_file)
    step = F.shiftright("length", STEP)
    k, before = _below(fitting.groupBy(step.alias("k")).agg(F.sum("length").alias("bytes")), most_total)
    large = F.when(F.col("length") > most_file, "too large")
    if k is None:
        return files.withColumn("reason", F.coalesce(large, F.lit("")))
    inside = fitting.where(step == k)
    length, used = _below(inside.groupBy(F.col("length").alias("k")).agg(F.sum("length").alias("bytes")), most_total - before)
    fits = (most_total - before - used) // length
    turn = F.row_number().over(Window.orderBy("path"))
    late = fitting.where(F.col("length") == length).withColumn("_turn", turn).where(F.col("_turn") > fits).select("path", F.lit(True).alias("_late"))
    over = (F.col("length") > length) | F.col("_late")
    return files.join(late, "path", "left").withColumn("reason", F.coalesce(large, F.when(over, "over the total"), F.lit(""))).drop("_late")


def contents(spark: SparkSession, paths: list[str], taken: DataFrame) -> DataFrame:
    """path, label and content of the files without a reason. Files longer than the longest of
    them aren't opened: the length goes down to the reader."""
    wanted = taken.where("reason = ''").select("path", "label")
    longest = taken.where("reason = ''").agg(F.max("length")).first()[0]
    if longest is None:
        return wanted.select("path", "label", F.lit(None).cast("binary").alias("content"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).where(F.col("length") <= longest)
    return read.select("path", "content").dropDuplicates(["path"]).join(wanted, "path")


def generations(spark: SparkSession, path: str) -> list[str]:
    """A log and its rotated files (path.1, path.2, ...), newest first. Their number is the rotation's."""
    folder, _, name = path.rpartition("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}*").load(folder).select("path").collect()
    numbered = ((re.fullmatch(re.escape(name) + r"(?:\.(\d+))?", r.path.rpartition("/")[2]), r.path) for r in files)
    return [p for _, p in sorted((int(m[1] or 0), p) for m, p in numbered if m)]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line and _at, the line's place in the file, of lines that aren't blank."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("value").alias("line"), at.alias("_at")).where(F.trim("line") != "")


def recent(spark: SparkSession, path: str, limit: int = 200) -> tuple[DataFrame, DataFrame, int]:
    """The last limit events (line: JSON) of a log with rotated files, oldest first by place; the
    lines of the files opened that are no JSON; and how many files were opened. Files are read
    newest first, until limit events are found."""
    events = broken = None
    opened, left = 0, limit
    for age, name in enumerate(generations(spark, path)):
        if left <= 0:
            break
        opened += 1
        all_ = lines(spark, name)
        sound = F.try_parse_json("line").isNotNull()
        some = all_.where(sound).orderBy(F.col("_at").desc()).limit(left).select("line", F.struct(F.lit(-age).alias("age"), F.col("_at.block").alias("block"), F.col("_at.row").alias("row")).alias("place"))
        left -= some.count()
        bad = all_.where(~sound).select("line", F.lit(name).alias("path"))
        events, broken = (some, bad) if events is None else (events.unionByName(some), broken.unionByName(bad))
    if events is None:
        events, broken = spark.createDataFrame([], "line string, place struct<age:int,block:long,row:long>"), spark.createDataFrame([], "line string, path string")
    return events.orderBy("place"), broken, opened


def reference(message: Column) -> Column:
    """The reference that a message names, else null. Letters may be in either case."""
    found = F.regexp_extract(F.lower(message), REFERENCE, 1)
    return F.when(found != "", found)


def looked_up(spark: SparkSession, path: str, message: str, scan: int = 5000, most: int = 50) -> DataFrame:
    """Of the last scan events those with the message's reference as request_id, the last most of
    them, in order; truncated says whether there were more."""
    asked = spark.range(1).select(reference(F.lit(message)).alias("request_id")).where("request_id is not null")
    found = recent(spark, path, scan)[0].withColumn("request_id", F.get_json_object("line", "$.request_id")).join(F.broadcast(asked), "request_id")
    turn = found.withColumn("_turn", F.row_number().over(Window.orderBy(F.col("place").desc()))).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)
    return turn.where(F.col("_turn") <= most).orderBy("place").select("request_id", "line", "place", "truncated")
