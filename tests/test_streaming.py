"""Streaming forms over small folders of files."""

import datetime as dt

from pyspark.sql import types as T

from tessera.streaming import incremental

SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType())])


def run(spark, stream, mode):
    q = stream.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(90)
    return spark.table("out").collect()


def rows(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    data = [(1, at(1, 0), 5.0), (1, at(1, 1), 200.0), (1, at(3, 0), 7.0), (2, at(1, 0), None), (2, at(1, 2), 3.0), (9, at(20, 0), 1.0)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return incremental.read_stream(spark, str(tmp_path / "in"), SCHEMA)


def test_sessions(spark, tmp_path):
    out = run(spark, incremental.episode_sessions(rows(spark, tmp_path), ["user_id"], "ts", "12 hours", "1 hour"), "append")
    got = sorted((r.user_id, r.onset.day, r.evidence) for r in out)
    assert got in ([(1, 1, 2), (1, 3, 1), (2, 1, 2)], [(1, 1, 2), (1, 3, 1), (2, 1, 2), (9, 20, 1)])


def test_previous_values_keep_state(spark, tmp_path):
    out = run(spark, incremental.previous_values(rows(spark, tmp_path), "user_id", "ts", "value"), "append")
    got = sorted((r.user_id, r.value if r.value is not None else -1, r.previous) for r in out if r.user_id == 1)
    assert got == [(1, 5.0, None), (1, 7.0, 200.0), (1, 200.0, 5.0)]
