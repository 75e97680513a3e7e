"""Streaming forms of the observation operators; additions, as the reference has none.

Files of observations arrive in a folder; late rows count up to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def episode_sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Episodes as session windows: a gap longer than ``gap`` begins a new one."""
    window = F.session_window(time, gap)
    out = stream.withWatermark(time, late).groupBy(*keys, window.alias("window")).agg(F.count("*").alias("evidence"))
    return out.select(*keys, F.col("window.start").alias("onset"), F.col("window.end").alias("closes"), "evidence")


def daily_abnormal(stream: DataFrame, keys: list[str], time: str, value: str, low: float, high: float, late: str) -> DataFrame:
    """Abnormal values of each day."""
    bad = (F.col(value) < low) | (F.col(value) > high)
    out = stream.withWatermark(time, late).groupBy(*keys, F.window(time, "1 day").alias("day")).agg(F.count("*").alias("total"), F.count_if(bad).alias("abnormal"))
    return out.select(*keys, F.col("day.start").alias("day"), "total", "abnormal")


def new_documents(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Documents whose content hash has not been seen within the watermark."""
    hashed = stream.withColumn("content_hash", F.sha2("text", 256)).withWatermark(time, late)
    return hashed.dropDuplicatesWithinWatermark(["content_hash"])


def previous_values(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """As-of previous value of a key, kept as state: (key, time, value, previous)."""
    output = T.StructType([T.StructField(key, T.LongType()), T.StructField(time, T.TimestampType()), T.StructField(value, T.DoubleType()), T.StructField("previous", T.DoubleType())])
    state_schema = T.StructType([T.StructField("last", T.DoubleType())])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([time, value])
        before = []
        for v in rows[value]:
            before.append(last)
            last = v if pd.notna(v) else last
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame({key: rows[key], time: rows[time], value: rows[value], "previous": before})

    return stream.groupBy(key).applyInPandasWithState(step, output, state_schema, "append", "NoTimeout")
