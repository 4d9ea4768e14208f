"""What the training-data operators share: inputs, shared folders and Arrow mapping."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark has to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names in
    spark.checkpoint.dir. Only where that is unset and the master is local (tests on
    one machine) is a local folder made and set; a cluster without it is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


class Workspace:
    """Tables that a many-step operator writes to the shared folder to cut its
    lineage: an executor lost later costs no recomputation of earlier steps. Results
    read them, so they stay until the application ends, when the folder is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        fs, path = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, path: str) -> tuple:
        """Hadoop's file system and path of a folder."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df, with further options of the writer, and return it as read again."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        fs, path = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)

    def release(self) -> None:
        """Let go of what finished steps have shuffled: Spark deletes those files once
        the driver has collected the garbage that refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def whole_text(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: Column) -> Column:
    """How many words (see WORD) a text has; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], size_of: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about most_bytes of column size_of (one
    row at least), so that a task's memory doesn't depend on how long texts are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(size_of)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
