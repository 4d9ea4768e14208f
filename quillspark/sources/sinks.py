"""Sinks: guarded CSV with a summary row, JSON lines and content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.shaping import formula_guarded


def guarded_csv(rows: DataFrame, path: str, summary: dict[str, str] | None = None) -> None:
    """All columns as text that no spreadsheet takes for a formula, a summary row first in its own file."""
    out = rows.select(*[formula_guarded(F.col(c).cast("string")).alias(c) for c in rows.columns])
    out.write.mode("overwrite").option("header", "true").csv(path)
    if summary is not None:
        first = rows.sparkSession.createDataFrame([tuple(summary.get(c) for c in rows.columns)], ", ".join(f"`{c}` string" for c in rows.columns))
        first.coalesce(1).write.mode("append").option("header", "true").csv(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def blobs(rows: DataFrame, content: str, path: str) -> DataFrame:
    """Write each distinct content once, by the first byte of its hash; returns rows with the key in place of the content."""
    named = rows.withColumn("key", F.sha2(content, 256))
    named.select("key", F.col(content).alias("content")).dropDuplicates(["key"]).withColumn("prefix", F.substring("key", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
    return named.drop(content)
