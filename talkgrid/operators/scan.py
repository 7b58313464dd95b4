"""Ordered passes with state over the rows of each key.

For semantics in which each step depends on the step before (sessions that restart at their own length,
greedy packing): rows are brought together by key, sorted, and streamed through a small state machine.
A task holds one row and one state at a time, never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Machine:
    """One key's state: step() for every row in order, close() after the last; both return output rows (tuples)."""

    def step(self, row: dict) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> list[tuple]:
        return []


def ordered_scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Callable[[], Machine], schema: str) -> DataFrame:
    """The rows that a fresh `machine` of each key gives, with the key columns in front.  Nulls are keys of their own."""
    keys, order = list(keys), list(order)
    out_schema = StructType([rows.schema[k] for k in keys] + list(StructType.fromDDL(schema).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out_schema)
        now, state, out = None, None, []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in arrow]
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != now:
                    if state is not None:
                        out.extend(now + r for r in state.close())
                    now, state = key, machine()
                out.extend(key + r for r in state.step(row))
            if len(out) > 5000:
                yield emit()
        if state is not None:
            out.extend(now + r for r in state.close())
        yield emit()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)
