"""State machines replayed over sorted events, with one state at a time in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

State = dict[str, Any]
#: Finished keys that are handed on at once.
BATCH = 4096


def replayed(events: DataFrame, key: str, order: list[str], start: Callable[[], State], step: Callable[[State, dict[str, Any]], None], schema: str) -> DataFrame:
    """One row for each key: key and the fields of schema after step has met the key's events in order.

    Events are hashed by key and sorted inside their partitions, which spills to disk; a task
    then reads them in Arrow batches and changes one state, so that a key's events never stand
    in memory together, however many they are. Events that tie in order are met in any order;
    a null key is a key of its own; nulls in order come first; no events, no rows."""
    fields = StructType([events.schema[key], *StructType.fromDDL(schema).fields])
    kinds, names = to_arrow_schema(fields), fields.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for event in batch.to_pylist():
                if state is None or event[key] != now:
                    if state is not None:
                        done.append({key: now, **state})
                    now, state = event[key], start()
                step(state, event)
            if len(done) >= BATCH:
                yield pa.RecordBatch.from_pylist(done, schema=kinds)
                done = []
        if state is not None:
            done.append({key: now, **state})
        yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in done], schema=kinds)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, fields)
