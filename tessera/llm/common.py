"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and all tasks run in this machine.
LOCAL_SCRATCH = "/tmp/checkpoints"
#: Rows that travel to a Python worker at a time.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, the context's checkpoint folder, else a local default on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or LOCAL_SCRATCH).rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the queries run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries run inside are removed as soon as each query ends."""
    return setting(spark, SHUFFLE_CLEANUP, "true")


def write_scratch(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation. drop_scratch() removes
    the files of tables that are read no more; those that a returned DataFrame still
    reads belong to the folder's owner, whose retention rule removes them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):  # the written files take their place
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Remove the files that write_scratch() wrote for these tables; no later plan may read them."""
    for df in tables:
        for path in {name[: name.index("/", name.index("/tessera-") + 1)] for name in df.inputFiles() if "/tessera-" in name}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str | Column) -> Column:
    """128 bits that identify a text; null for a null text."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


#: Bits of a key filter: some for each key, and at most so many (16 MB); with fewer than LEAST_BITS a key it would let most rows pass.
BITS_A_KEY, MOST_BITS, LEAST_BITS = 8, 1 << 27, 2


def key_filter(keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> Callable[[DataFrame, Column], tuple[DataFrame, DataFrame]]:
    """A function that parts rows: those whose key may be among ``keys``, and those whose key is surely not.

    A hashed bit map of at most ``most_bits`` bits is made in Spark and broadcast, so rows
    that no join can match need not be shuffled. It errs only by letting rows pass. For
    more keys than it can tell apart it is not made, and all rows may be among them. A
    null key is a key like others.
    """
    n = keys.count()
    if n * LEAST_BITS > most_bits:
        return lambda rows, value: (rows, rows.limit(0))
    size = max(1 << 15, min(most_bits, 1 << (BITS_A_KEY * max(n, 1) - 1).bit_length()))
    place = lambda value: F.xxhash64(F.lit(29), value).bitwiseAND(F.lit(size - 1))
    at = keys.select(place(F.col(key)).alias("_at"))
    made = at.groupBy(F.shiftright("_at", 15).alias("_part")).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit(32767))).alias("_bits"))
    made = write_scratch(made, "filter")

    def part(rows: DataFrame, value: Column) -> tuple[DataFrame, DataFrame]:
        names = rows.columns
        tag = "_" * (1 + max((len(c) for c in names), default=0))  # clashes with no column
        bits = F.broadcast(made.select(F.col("_part").alias(f"{tag}part"), F.col("_bits").alias(f"{tag}bits")))
        placed = rows.withColumn(f"{tag}at", place(value))
        joined = placed.join(bits, F.shiftright(f"{tag}at", 15) == F.col(f"{tag}part"), "left")
        inner = F.col(f"{tag}at").bitwiseAND(F.lit(32767))
        byte = F.conv(F.hex(F.substring(f"{tag}bits", (F.shiftright(inner, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.coalesce((byte / F.pow(F.lit(2), inner % 8)).cast("int") % 2 == 1, F.lit(False))
        return joined.where(bit).select(names), joined.where(~bit).select(names)

    return part


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls count as empty."""
    if array.null_count:
        array = pc.fill_null(array, "")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if offsets is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def list_array(values: np.ndarray, counts: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    """A list column from flat values; where ``present`` is false the row is null."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    offsets = pa.array(ends, mask=None if present is None else np.append(~present, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values))
