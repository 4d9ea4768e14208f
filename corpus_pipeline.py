"""A training-data pipeline over documents, of five of the operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents. In order: documents that the quality classifier
rejects go; of each group of near duplicates the one with the least doc_id stays; secrets
are replaced in the texts by their kind; the sources are mixed to their target weights, a
document standing as often as the mix takes it; and the texts are encoded.

Nulls and empty texts pass through every stage as its operator defines; further columns of
documents are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_codec, minhash, mixing, quality_mil, secret_ledger
from quillspark.llm.common import Workspace, table, whole_text

#: Five words a shingle and a similarity of 0.8.
NEAR = minhash.Near(words=5, percent=80)
MIX = mixing.Mix()


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars made to fit the text again, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, taught by labels, rejects."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return quality_mil.classify(rows, table(spark, sf_dir, "labels"), ("_row",)).where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the least doc_id.

    Rows without doc_id stay. Of several texts of one doc_id each is a document of its own: the
    one with the least hash goes by the doc_id, the others by keys above all doc_ids, so that
    they yield to any other document. Of rows of one doc_id and text, the one whose row has the
    least hash stays."""
    names = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_text"), whole_text().alias("text"), F.struct(*names).alias("_row"))
    several = rows.where("_id is not null").groupBy("_id").agg(F.min("_text").alias("_first"), F.max("_text").alias("_last")).where("_first <> _last").select("_id", "_first")
    further = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("_id", "_text"), 2)
    keyed = rows.join(several, "_id", "left").withColumn("_key", F.when(F.coalesce(F.col("_text") == F.col("_first"), F.lit(True)), F.col("_id")).otherwise(further))
    dropped = minhash.near_groups(keyed.select(F.col("_key").alias("doc_id"), "text"), NEAR).where("not kept").select(F.col("doc_id").alias("_key")).distinct()
    left = keyed.join(dropped, "_key", "left_anti").select("_key", "_row")
    hashed = F.xxhash64(*[F.col("_row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = left.where("_key is not null").groupBy("_key").agg(F.min_by("_row", hashed).alias("_row"))
    return left.where("_key is null").select("_row.*").unionByName(one.select("_row.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind in brackets.

    Findings are joined back by blob, and only those of texts that have any."""
    versions = docs.select(whole_text().alias("text"), F.struct(*docs.columns).alias("_row"))
    _, findings = secret_ledger.update(versions.select("text"))
    found = secret_ledger.by_path(secret_ledger.address(versions).drop("text"), findings)
    text = F.when(F.size("findings") > 0, secret_ledger.redact(F.col("_row.text"), F.col("findings"))).otherwise(F.col("_row.text"))
    return _resized(found.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents in the numbers that their source's target asks for."""
    return _resized(mixing.mixed(docs, MIX).select(*docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and their digests of every row."""
    keys = ("doc_id", *(c for c in ("source",) if c in docs.columns))
    return bpe_codec.encode(docs, keys=keys, with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]
#: The classifier has no SQL; tests hold the other stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
