"""A session with the settings the engine is tuned for; a cluster's own settings win."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("quillspark")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df as written to the folder that the session names in spark.checkpoint.dir, so that steps
    built on it neither compute it again nor carry its plan. Only where none is named and the
    master is local (tests on one machine) is a local folder set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return df.checkpoint()
