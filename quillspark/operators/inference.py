"""A model as a pluggable function over batches of rows: dates that no parser finds.

The function gets a list of items and returns what it says about them, by index. A call that
fails is tried once more; a batch that fails twice, or an answer that makes no sense, costs only
itself. The default is a rule, so that results are the same each time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import printed_date

#: Rows of a call, and how often it is tried.
BATCH, TRIES = 40, 2
#: Characters of a description and of a quote that a call is given.
MOST_DESCRIPTION, MOST_QUOTE = 300, 200

Model = Callable[[list[dict[str, object]]], object]


def only_year(items: list[dict[str, object]]) -> object:
    """The default: the year of an item that names exactly one between 1900 and 2099."""
    out = []
    for item in items:
        years = {n for n in re.findall("[0-9]+", f"{item['description']} {item['quote']}") if len(n) == 4 and n[:2] in ("19", "20")}
        out.append({"index": item["index"], "date": years.pop() if len(years) == 1 else None})
    return {"dates": out}


def answers(items: list[dict[str, object]], model: Model) -> dict[int, str | None] | None:
    """What the model says for each index of a batch; none if it failed TRIES times. The last of
    several answers to one index counts, one that is no such answer is passed over."""
    for _ in range(TRIES):
        try:
            said = model(items)
        except Exception:  # whatever the model's client raises: the batch is tried again
            continue
        rows = said.get("dates") if isinstance(said, dict) else None
        if not isinstance(rows, list):
            continue
        out: dict[int, str | None] = {}
        for row in rows:
            index = row.get("index") if isinstance(row, dict) else None
            if type(index) is int and 0 <= index < len(items):
                out[index] = str(row["date"]) if row.get("date") else None
        return out
    return None


def inferred_dates(facts: DataFrame, key: str, model: Model = only_year, batch: int = BATCH) -> DataFrame:
    """key, iso, precision and state of facts (key, description, quote) without a date. state:
    inferred; none (the model has no date, or one that the parser refuses); unanswered; or
    lost (the call failed). Nulls are empty texts. Each task calls batch by batch, in its rows' order."""
    rows = facts.select(F.col(key).cast("string").alias("key"), *[F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c) for c, n in (("description", MOST_DESCRIPTION), ("quote", MOST_QUOTE))])

    def calls(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                some = frame.iloc[start : start + batch]
                said = answers([{"index": i, "description": d, "quote": q} for i, (d, q) in enumerate(zip(some.description, some.quote, strict=True))], model)
                states = ["lost" if said is None else "said" if i in said else "unanswered" for i in range(len(some))]
                yield pd.DataFrame({"key": some.key.to_numpy(), "said": [(said or {}).get(i) for i in range(len(some))], "state": states})

    told = rows.mapInPandas(calls, "key string, said string, state string").withColumn("d", printed_date(F.col("said")))
    state = F.when(F.col("d").isNotNull(), "inferred").when(F.col("state") == "said", "none").otherwise(F.col("state"))
    return told.select(F.col("key").cast(facts.schema[key].dataType).alias(key), "d.iso", "d.precision", state.alias("state"))
