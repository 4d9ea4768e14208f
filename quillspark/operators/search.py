"""Ranked search: postings, inverse document frequency and top-k."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(paragraphs: DataFrame, key: str = "para_seq", text: str = "text") -> DataFrame:
    """token, key and tf: how often each token stands in each paragraph."""
    return paragraphs.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def scored(paragraphs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The paragraphs that hold a word of the query, with score: the sum over the query's
    distinct tokens of tf * (ln((N + 1) / (df + 1)) + 1), N being all paragraphs.

    Query tokens are counted inside each paragraph. One aggregation finds N and all df, a row
    per query token; with these as literals a score is an expression of its row, so that
    scoring shuffles nothing."""
    wanted = sorted(set(paragraphs.sparkSession.range(1).select(tokens(F.lit(query))).first()[0]))
    held = F.filter(tokens(F.col(text)), lambda t: t.isin(wanted) if wanted else F.lit(False))
    found = paragraphs.select(F.explode(F.concat(F.array_distinct(held), F.array(F.lit("")))).alias("token"))
    seen = {r.token: r.n for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    tf = [F.size(F.filter("_held", F.lit(t).__eq__)) for t in wanted]
    idf = [math.log((seen.get("", 0) + 1) / (seen.get(t, 0) + 1)) + 1.0 for t in wanted]
    score = functools.reduce(Column.__add__, [n * F.lit(w) for n, w in zip(tf, idf, strict=True)], F.lit(0.0))
    return paragraphs.withColumn("_held", held).where(F.size("_held") > 0).withColumn("score", F.round(score, 6)).drop("_held")


def ranked(paragraphs: DataFrame, query: str, key: str = "para_seq", text: str = "text") -> DataFrame:
    """key and score of all paragraphs that hold a word of the query (see scored)."""
    return scored(paragraphs, query, text).select(key, "score")


def search(paragraphs: DataFrame, query: str, limit: int = 20, provider: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The best paragraphs, ties by para_seq. Filters apply after ranking, so they don't change
    scores. Each partition hands on its own best, texts and all, and no other row."""
    from quillspark.functions.dates import any_date_between

    found = scored(paragraphs, query)
    if provider:
        found = found.where(F.contains(F.lower("text"), F.lower(F.lit(provider))))
    if date_from or date_to:
        found = found.where(any_date_between(F.col("text"), date_from, date_to))
    return found.orderBy(F.desc("score"), "para_seq").limit(limit)
