"""Streaming: sessions, capped sessions, duplicates and interval maps over rows that arrive late and twice."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from talkgrid.operators.durable import checkpoint_dir
from talkgrid.operators.intervals import IntervalMap


def event_time(rows: DataFrame, column: str, late: str) -> DataFrame:
    """`rows` with a watermark; a time without zone is taken as UTC (the session's zone)."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def sessions(rows: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """key, start, end (of the last event), n of sessions that end after a gap without events; works on batches and streams."""
    w = F.session_window(time, gap)
    grouped = rows.groupBy(key, w).agg(F.count(F.lit(1)).alias("n"), F.max(time).alias("end"))
    return grouped.select(key, F.col("session_window.start").alias("start"), "end", "n")


def unique_events(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each event once, though it may be delivered again within the watermark."""
    return event_time(rows, time, late).dropDuplicatesWithinWatermark(keys)


def capped_sessions(rows: DataFrame, key: str, time: str, gap_ms: int, most_ms: int) -> DataFrame:
    """key, start_ms, end_ms, n: sessions that end at a gap, or once they are `most_ms` long, in keyed state.

    A session is given out when the next event of its key closes it, and when no event came for the gap in
    event time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        start, end, n = state.get if state.exists else (None, None, 0)
        if state.hasTimedOut:
            out.append((k[0], start, end, n))
            state.remove()
            yield pd.DataFrame(out, columns=[key, "start_ms", "end_ms", "n"])
            return
        times = sorted(int(t) for pdf in batches for t in pdf["_ms"])
        for t in times:
            if n and (t - end > gap_ms or t - start > most_ms):
                out.append((k[0], start, end, n))
                n = 0
            if not n:
                start = t
            end, n = max(t, end) if n else t, n + 1
        state.update((start, end, n))
        state.setTimeoutTimestamp(max(end + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "start_ms", "end_ms", "n"])

    key_type = rows.schema[key].dataType.simpleString()
    timed = rows.select(key, time, F.unix_millis(time).alias("_ms"))
    return timed.groupBy(key).applyInPandasWithState(step, f"`{key}` {key_type}, start_ms bigint, end_ms bigint, n bigint", "start_ms bigint, end_ms bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def interval_maps(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, periods, gaps: the ordered disjoint-interval map of every entity that has new intervals, kept in state.

    Each insertion finds the intervals it meets by binary search.  Rows may come in any order and twice.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap(*(state.get if state.exists else ((), ())))
        for pdf in batches:
            for s, e in zip(pdf[start], pdf[end]):
                if pd.notna(s) and pd.notna(e):
                    held.insert(int(s), int(e))
        state.update((held.starts, held.ends))
        span = lambda pairs: [{"from_ms": a, "to_ms": b} for a, b in pairs]
        yield pd.DataFrame([(*k, span(held.periods()), span(held.gaps()))], columns=[*keys, "periods", "gaps"])

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    pairs = "array<struct<from_ms:bigint,to_ms:bigint>>"
    return rows.select(*keys, start, end).groupBy(*keys).applyInPandasWithState(step, f"{types}, periods {pairs}, gaps {pairs}", "starts array<bigint>, ends array<bigint>", "update", GroupStateTimeout.NoTimeout)


def read_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A table's Parquet file, or folder of files, as a stream."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_files(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives for the data that are there now, written batch by batch to the shared folder and read back.

    In complete mode every batch replaces the ones before; in append mode it is added under its number, so that a
    batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    place = lambda batch: f"{folder}/rows" if mode == "complete" else f"{folder}/rows/stream_batch_no={batch}"
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(place(batch))
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(place(-1))  # a stream without data has rows of no batch
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select(stream.columns)


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All rows that a stream gives for the data that are there now, from a memory table (for tests and small results)."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
