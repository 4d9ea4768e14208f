"""Queries and SQL of the training-data operators, as __spark_entry__.py adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe_codec, edit_embedding, html_text, media_ogg, minhash, mixing, quality_mil, secret_ledger, sharding, simhash, suffix_levels, token_links, vector_codes

MODULES = (mixing, sharding, minhash, media_ogg, suffix_levels, quality_mil, edit_embedding, html_text, secret_ledger, bpe_codec, vector_codes, simhash, token_links)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
