"""Continuous periods and gaps of overlapping intervals, per entity.

The state of one key is an ordered map of disjoint intervals (two parallel lists).  An insertion finds
the intervals it meets by binary search and replaces them by their hull; the gaps are what lies between
neighbours, so a merge removes the gaps it closes.

At scale the key is (entity, time slot): an entity that owns a third of all rows is spread over its
slots.  Each slot keeps its own map.  What reaches a slot from earlier slots (the largest end, and where
the period that is still open began) is a running maximum over one small row per slot, so no task ever
holds an entity's rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from talkgrid.operators.durable import cut_lineage

SLOT_MS = 15 * 60 * 1000


class IntervalMap:
    """Ordered disjoint intervals; intervals that overlap or touch are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: Sequence[int] = (), ends: Sequence[int] = ()):
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        """Add [start, end]; an interval without length is none."""
        if end <= start:
            return
        starts, ends = self.starts, self.ends
        lo = bisect_left(ends, start)  # the first interval that ends at or after start
        hi = bisect_right(starts, end)  # one past the last that begins at or before end
        if lo < hi:
            start, end = min(start, starts[lo]), max(end, ends[hi - 1])
        starts[lo:hi] = [start]
        ends[lo:hi] = [end]

    def periods(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return zip(self.ends, self.starts[1:])


def _fold(n_keys: int):
    """A mapInArrow function: rows sorted by their key columns, then start and end, become disjoint intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, names = None, IntervalMap(), None
        out: list[list] = []

        def close() -> None:
            for s, e in state.periods():
                out.append([*key, s, e])

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return batch

        for batch in batches:
            names, types = batch.schema.names, batch.schema.types
            columns = [c.to_pylist() for c in batch.columns]
            starts, ends = columns[-2], columns[-1]
            for i, k in enumerate(zip(*columns[:n_keys])):
                if k != key:
                    if key is not None:
                        close()
                    key, state = k, IntervalMap()
                state.insert(starts[i], ends[i])
            if len(out) >= 10_000:
                yield emit()
        if key is not None:
            close()
        if out:
            yield emit()

    return run


def milliseconds(seconds):
    """Whole milliseconds of a column of seconds; null for null, NaN and infinite times."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9e15))
    return F.when(finite, F.bround(seconds * 1000).cast("bigint"))


def periods_and_gaps(rows: DataFrame, keys: Sequence[str], start: str, end: str, slot_ms: int = SLOT_MS) -> DataFrame:
    """Columns `keys`, kind ('period' or 'gap'), from_ms, to_ms.

    `start` and `end` are whole milliseconds.  A row with a null key is its own entity (nulls compare
    equal); a row without both times, or whose end is not after its start, is no interval.  Repeated rows
    change nothing.  An empty table gives no rows.
    """
    keys = list(keys)
    valid = rows.where(F.col(end) > F.col(start)).select(
        *keys, F.floor(F.col(start) / F.lit(slot_ms)).cast("bigint").alias("_slot"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e")
    )
    cell = [*keys, "_slot"]
    folded = valid.repartition(*cell).sortWithinPartitions(*cell, "_s", "_e").mapInArrow(_fold(len(cell)), valid.schema)
    # One row per slot that holds its disjoint intervals in order; of other slots it needs what is in the narrow tables below.
    slots = cut_lineage(folded.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("_s", "_e"))).alias("_iv")))
    across = W.partitionBy(*keys).orderBy("_slot")
    ends = slots.select(*cell, F.element_at("_iv", -1)["_e"].alias("_max_e"))
    carried = ends.select(*cell, F.max("_max_e").over(across.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"), F.max("_max_e").over(W.partitionBy(*keys)).alias("_total"))
    # An interval opens a period if it begins after everything before it.  Inside a slot the intervals are disjoint, so
    # those that do not are the slot's first ones.
    placed = _null_safe_join(slots, carried, cell)
    inner = F.filter("_iv", lambda x: x["_s"] <= F.col("_carry"))
    placed = placed.withColumns({"_open": F.when(F.col("_carry").isNull(), F.col("_iv")).otherwise(F.filter("_iv", lambda x: x["_s"] > F.col("_carry"))), "_before": F.greatest("_carry", F.array_max(F.transform(inner, lambda x: x["_e"])))})
    placed = cut_lineage(placed.select(*cell, "_open", "_before", "_total").where(F.size("_open") > 0))
    # A period ends where the gap after it begins; the last one of an entity ends at the entity's largest end.
    after = placed.select(*cell, F.lead("_before").over(across).alias("_after"))
    closed = _null_safe_join(placed, after, cell)
    one = F.posexplode(F.arrays_zip(F.col("_open")["_s"].alias("s"), F.concat(F.array("_before"), F.slice(F.col("_open")["_e"], 1, F.size("_open") - 1)).alias("b"), F.concat(F.slice(F.col("_open")["_e"], 1, F.size("_open") - 1), F.array(F.coalesce("_after", "_total"))).alias("e")))
    periods = closed.select(*keys, one.alias("_i", "_x")).select(*keys, F.col("_x.s").alias("_s"), F.col("_x.b").alias("_before"), F.col("_x.e").alias("_to"))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("from_ms"), F.col("_to").alias("to_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("_before").alias("from_ms"), F.col("_s").alias("to_ms")),
    )
    return periods.select(*keys, F.explode(both).alias("x")).select(*keys, "x.kind", "x.from_ms", "x.to_ms").where("from_ms IS NOT NULL")


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_j{i}")) for i, c in enumerate(on)], "inner").drop(*[f"_j{i}" for i in range(len(on))])


def layers(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """layer, job_id, s, e in milliseconds of both tables."""
    one = lambda df, name: df.select(F.lit(name).alias("layer"), "job_id", milliseconds(F.col("start")).alias("s"), milliseconds(F.col("end")).alias("e"))
    return one(utterances, "utterances").unionByName(one(words, "words"))
