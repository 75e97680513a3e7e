"""An append-only ledger whose entries chain by hash, per subject."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64


def chained(entries: DataFrame, subject: str, order: str, payload: str) -> DataFrame:
    """Add seq, previous_hash and entry_hash = sha256(previous_hash, payload); a subject's entries in order.

    The chain of one subject is sequential by definition. Payloads are hashed where they
    are read; a task reads its subjects sorted, batch by batch, and keeps only the last
    hash, so a subject with most entries needs time but no memory. Ties of the order go
    by the payload's hash; a null payload is empty.
    """
    hashed = entries.select(subject, order, F.sha2(F.coalesce(F.col(payload), F.lit("")), 256).alias("payload_hash"))
    dealt = hashed.repartition(subject).sortWithinPartitions(subject, order, "payload_hash")
    schema = T.StructType([*dealt.schema, T.StructField("seq", T.LongType()), T.StructField("previous_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, seq, last, begun = None, 0, GENESIS, False
        for batch in batches:
            places, before, after = [], [], []
            for who, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or who != whose:
                    whose, seq, last, begun = who, 0, GENESIS, True
                seq += 1
                places.append(seq)
                before.append(last)
                last = hashlib.sha256(f"{last}|{value}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=schema.names)

    return dealt.mapInArrow(link, schema)


def verified(chain: DataFrame, subject: str) -> DataFrame:
    """Per subject: entries, and the first seq at which the chain breaks (null if it holds)."""
    w = Window.partitionBy(subject).orderBy("seq")
    before = F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS))
    own = F.sha2(F.concat_ws("|", "previous_hash", "payload_hash"), 256)
    ok = (F.col("previous_hash") == before) & (F.col("entry_hash") == own) & (F.col("seq") == F.row_number().over(w))
    return chain.withColumn("_ok", ok).groupBy(subject).agg(F.count("*").alias("entries"), F.min(F.when(~F.col("_ok"), F.col("seq"))).alias("first_break"))
