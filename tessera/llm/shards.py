"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; row r of n gets the fraction
(r - 0.5) / n; rows sorted by fraction interleave all sources in proportion, and
cutting that order into equal runs gives shards that each match the mixture.

Both ranks are made in two steps, so that neither a hot source nor the global order
meets in one task: rows are dealt into buckets by a prefix of the sort key, buckets
are counted, earlier buckets' counts are added up, and only inside a bucket are rows
numbered. The number of buckets follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
BUCKET_ROWS = 20_000
_BITS = 52


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Add the rank (from 0) of each row inside its group; ``bucket`` rises with the order."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = counts.select(*[F.col(c).alias(f"_{c}") for c in [*group, bucket]], before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) - 1
    numbered = rows.withColumn("_inner", inner)
    same = [numbered[c].eqNullSafe(earlier[f"_{c}"]) for c in [*group, bucket]]
    joined = numbered.join(earlier, same).withColumn(name, F.col("_inner") + F.col("_before"))
    return joined.drop("_inner", "_before", *[f"_{c}" for c in [*group, bucket]])


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 17, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with three more columns: _position in the whole order, shard, slot.

    Counts of shards differ by one at most, and so does, for every source, each shard's
    share from its exact proportion (by less than two rows). A null source is a source of
    its own. Repeated rows are separate rows; ties of the seeded order go by id, then
    text. An empty table gives an empty result. Other columns stay.
    """
    total = docs.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 64 - _BITS)
    rows = docs.withColumn("_key", key).withColumn("_bucket", F.floor(F.col("_key") / F.lit((1 << _BITS) / buckets)))
    ranked = _ranked(rows, [source_col], "_bucket", ["_key", id_col, text_col], "_rank")
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_size"))
    joined = ranked.join(sizes, ranked[source_col].eqNullSafe(sizes["_source"]))
    spread = joined.withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_size")).withColumn("_bucket", F.floor(F.col("_fraction") * buckets)).withColumn("_all", F.lit(0))
    placed = _ranked(spread, ["_all"], "_bucket", ["_fraction", "_key", id_col, text_col], "_position")
    out = placed.withColumn("shard", F.expr(f"cast((_position * {shards}) div {max(total, 1)} as int)")).withColumn("slot", F.expr(f"cast(_position - (shard * cast({total} as bigint) + {shards - 1}) div {shards} as bigint)"))
    return out.drop("_key", "_bucket", "_rank", "_source", "_size", "_fraction", "_all")


def shard_digest(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lean = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("text"))
    placed = interleave(lean, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17) -> None:
    """Write whole rows as Parquet, one folder shard=k for each shard, in slot order inside a file."""
    placed = interleave(docs, shards, seed).drop("_position")
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
