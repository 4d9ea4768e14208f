"""Runs that go on where one ended: a manifest of what was done, by fingerprint.

State is a folder of parts. A part holds the rows of one run and the fingerprints of the inputs
they came of, and is written beside the state, then renamed into it in one step: a run that is
killed leaves the state as it was. What a later run has to read is an anti join of its inputs with
the fingerprints of all parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(*columns: Column | str) -> Column:
    """A digest of values with their borders; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.struct(F.col(c) if isinstance(c, str) else c)), F.lit("")) for c in columns])), 256)


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def done(spark: SparkSession, state: str) -> DataFrame | None:
    """Rows of all parts, with their fingerprint; None before the first."""
    fs, at = _fs(spark, f"{state}/parts")
    if not fs.exists(at) or not fs.listStatus(at):
        return None
    return spark.read.option("mergeSchema", "true").parquet(f"{state}/parts/*")


def open_inputs(inputs: DataFrame, state: str, mark: Column) -> DataFrame:
    """inputs whose fingerprint (mark) no part has, with it."""
    marked = inputs.withColumn("fingerprint", mark)
    known = done(inputs.sparkSession, state)
    return marked if known is None else marked.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")


def commit(rows: DataFrame, state: str) -> None:
    """Add rows (with fingerprint) as one part, all or nothing."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    staged = f"{state}/staged/{name}"
    rows.write.parquet(staged)
    fs, from_ = _fs(spark, staged)
    fs.mkdirs(_fs(spark, f"{state}/parts")[1])
    if not fs.rename(from_, _fs(spark, f"{state}/parts/{name}")[1]):
        raise OSError(f"{staged} could not be moved into the state")


def resumed(inputs: DataFrame, state: str, mark: Column, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows of the current inputs: work is applied to those that no earlier run has done, its
    rows (they keep fingerprint) are committed, and the rest comes from the parts. Inputs that are
    gone, or have changed since, leave no rows behind in the result."""
    commit(work(open_inputs(inputs, state, mark)), state)
    now = inputs.select(mark.alias("fingerprint")).distinct()
    return done(inputs.sparkSession, state).join(now, "fingerprint", "left_semi")
