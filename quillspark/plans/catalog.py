"""All queries of the reference's operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import evidence, links, operational, reports, reviews, selections, shapes, timelines

MODULES = (timelines, reviews, operational, shapes, links, reports, evidence, selections)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over all paragraphs."""
    return timelines.rnk_01_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
