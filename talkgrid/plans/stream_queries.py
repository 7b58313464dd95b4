"""Queries of streaming operators; streams that end where the data do."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.operators.scan import Machine, ordered_scan
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import table
from talkgrid.streaming.sessions import read_stream, run_to_files, sessions, unique_events

REGISTRY = Registry()
add = REGISTRY.add


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@add("stream_sessionize", """WITH x AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), y AS (
SELECT *, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM x)
SELECT user_id, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM y GROUP BY user_id, n""")
def stream_sessionize(spark, d):
    """Sessions of each user's events, read as a stream."""
    events = read_stream(spark, d, "events", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    s = run_to_files(sessions(events, "user_id", "ts", "30 minutes"), "complete")
    return s.select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


class _Capped(Machine):
    def __init__(self, gap: int, most: int):
        self.gap, self.most, self.n = gap, most, 0

    def step(self, row):
        t, out = row["t"], []
        if self.n and (t - self.end > self.gap or t - self.start > self.most):
            out, self.n = self.close(), 0
        if not self.n:
            self.start = t
        self.end, self.n = t, self.n + 1
        return out

    def close(self):
        return [(self.start, self.end, self.n)] if self.n else []


@add("stream_max_session", """WITH RECURSIVE x AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events),
f AS (SELECT user_id, rn, t, t AS start, 0 AS no FROM x WHERE rn = 1 UNION ALL SELECT x.user_id, x.rn, x.t, CASE WHEN x.t - f.t > 14400000 OR x.t - f.start > 28800000 THEN x.t ELSE f.start END, CASE WHEN x.t - f.t > 14400000 OR x.t - f.start > 28800000 THEN f.no + 1 ELSE f.no END FROM f JOIN x ON x.user_id = f.user_id AND x.rn = f.rn + 1)
SELECT user_id, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n FROM f GROUP BY user_id, no""")
def stream_max_session(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.unix_millis("ts").alias("t"))
    return ordered_scan(e, ["user_id"], ["t", "event_id"], lambda: _Capped(14_400_000, 28_800_000), "start_ms bigint, end_ms bigint, n bigint")


@add("stream_dedup_boundary", "SELECT DISTINCT utt_id, job_id, utt_idx FROM utterances")
def stream_dedup_boundary(spark, d):
    """Each utterance once, though delivered again days later, read as a stream with a watermark."""
    rows = read_stream(spark, d, "utterances", table(spark, d, "utterances").schema)
    once = unique_events(rows.select("utt_id", "job_id", "utt_idx", "received_at"), ["utt_id"], "received_at", "30 days")
    return run_to_files(once.drop("received_at"), "append")


@add("first_deliveries", "SELECT utt_id, epoch_us(min(received_at)) AS received_us, count(*) AS deliveries FROM utterances GROUP BY utt_id")
def first_deliveries(spark, d):
    """Each utterance at its first delivery."""
    return table(spark, d, "utterances").groupBy("utt_id").agg(F.unix_micros(F.min("received_at")).alias("received_us"), F.count(F.lit(1)).alias("deliveries"))


@add("late_rows", """WITH x AS (SELECT utt_id, received_at, max(received_at) OVER (PARTITION BY job_id ORDER BY received_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen, min(received_at) OVER (PARTITION BY job_id) AS first FROM utterances)
SELECT (epoch_us(received_at) - epoch_us(first)) // 86400000000 AS days_late, count(*) AS n FROM x GROUP BY 1""")
def late_rows(spark, d):
    """How many rows came how many days after their meeting's first."""
    from pyspark.sql import Window as W

    first = F.min("received_at").over(W.partitionBy("job_id"))
    late = F.floor((F.unix_micros("received_at") - F.unix_micros(first)) / 86_400_000_000)
    return table(spark, d, "utterances").select(late.alias("days_late")).groupBy("days_late").agg(F.count(F.lit(1)).alias("n"))
