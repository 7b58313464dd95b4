import datetime as dt

from pyspark.sql import functions as F

from talkgrid.streaming import sessions as S
from tests.helpers import rows


def stream_of(spark, tmp_path, data, schema, parts=3):
    for i in range(parts):
        spark.createDataFrame(data[i::parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_interval_maps_hold_state_over_batches(spark, tmp_path):
    data = [("a", 0, 5), ("a", 4, 9), ("a", 20, 30), ("a", 9, 12), ("b", 3, 3), ("a", 0, 5), ("b", 1, 2), ("a", None, 4)]
    stream = S.interval_maps(stream_of(spark, tmp_path, data, "k string, s long, e long"), ["k"], "s", "e")
    got = S.run_available(stream, "maps", "update").collect()
    last = {r.k: r for r in got}
    final = [r for r in got if r.k == "a"][-1]
    assert [tuple(p) for p in final.periods] == [(0, 12), (20, 30)] and [tuple(g) for g in final.gaps] == [(12, 20)]
    assert [tuple(p) for p in last["b"].periods] == [(1, 2)]


def test_sessions_and_duplicates(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    data = [(1, at(0)), (1, at(3)), (1, at(20)), (2, at(1)), (1, at(3)), (9, at(50))]
    df = spark.createDataFrame(data, "k long, ts timestamp")
    assert [(r[0], r[3]) for r in rows(S.sessions(df, "k", "ts", "5 minutes"))] == [(1, 3), (1, 1), (2, 1), (9, 1)]
    once = S.unique_events(stream_of(spark, tmp_path, data, "k long, ts timestamp", 1), ["k", "ts"], "ts", "1 hour")
    assert len(rows(S.run_available(once, "once", "append"))) == 5


def test_capped_sessions(spark, tmp_path):
    data = [(1, dt.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 4, 8, 12, 40)] + [(2, dt.datetime(2024, 1, 1, 1))]
    stream = S.capped_sessions(S.event_time(stream_of(spark, tmp_path, data, "k long, ts timestamp", 1), "ts", "0 seconds"), "k", "ts", 10_000, 9_000)
    got = [(r.k, r.n) for r in S.run_available(stream, "capped", "append").orderBy("k", "start_ms").collect()]
    assert got[:2] == [(1, 3), (1, 1)]
