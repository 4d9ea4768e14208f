"""Helpers that build columns out of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mapped(values: dict[str, str]) -> Column:
    """A map column of fixed values."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def worked_out(df: DataFrame, **values: Column) -> DataFrame:
    """df with further columns that are computed once for each row. Filters and fields on columns of
    select or withColumn are moved below them, and then compute them again each; not below these,
    as a generator makes them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in values.items()]))))
