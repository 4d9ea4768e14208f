"""Streaming forms of the stateful reports: windowed usage, active sessions and leased jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
JOB = "job_id long, status string, attempts int"
HELD = "status string, attempts int, beat double"


def events(spark: SparkSession, path: str, files_a_trigger: int = 8) -> DataFrame:
    """A stream of event files; offsets and holes are the file source's and its checkpoint's."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def usage(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Calls and value by hour and event type; what comes later than late is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "calls", "value")


def sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "300 seconds") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Idempotent intake: the first row of each key, keys being forgotten after the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def leases(stream: DataFrame, lease_s: float = 900.0, most: int = 3) -> DataFrame:
    """The state of each job (job_id, seq, at, kind) after each batch; the rules are those of
    the replay in operators.operations.leases. A job's state is three values."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, beat = state.get if state.exists else ("queued", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["seq"])
        for at, kind in zip(rows["at"], rows.kind, strict=True):
            held = status == "running" and at - beat <= lease_s
            if kind == "claim" and (status == "queued" or status == "running" and not held):
                if attempts >= most:
                    status = "abandoned"
                else:
                    status, attempts, beat = "running", attempts + 1, at
            elif held and kind == "beat":
                beat = at
            elif held and kind in ("done", "fail"):
                status = "done" if kind == "done" else "failed"
            elif held and kind == "release":
                status, attempts = "queued", attempts - 1
        state.update((status, int(attempts), float(beat)))
        yield pd.DataFrame([(key[0], status, int(attempts))], columns=["job_id", "status", "attempts"])

    return stream.groupBy("job_id").applyInPandasWithState(step, JOB, HELD, "update", GroupStateTimeout.NoTimeout)
