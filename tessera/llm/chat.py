"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A conversation may be logged again and again as it grows. Every turn gets a rolling
hash of the turns up to it (128 bits: exclusive-or of position-salted turn hashes);
a conversation whose whole hash is a proper-prefix hash of a longer one is a snapshot
and is dropped by an anti-join, and of equal conversations the least conv_id stays.
The others are rendered. Prefix keys are made distinct before the join and whole keys
are reduced to one row each, so a first turn or a conversation that a third of all
rows share stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text: distinct turns in order of turn, role, text, numbered from 1; nulls as empty.

    A null conv_id is one conversation; a null turn comes first.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return turns.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place, h1, h2: the hash of the first ``place`` turns, and turns: how many there are."""
    order = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolling = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "place", "role", "text")).over(order)
    return turns.select("conv_id", "place", rolling(1).alias("h1"), rolling(2).alias("h2"), F.count("*").over(Window.partitionBy("conv_id")).alias("turns"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, copies: conversations that are no prefix of a longer one, the least conv_id of equal ones."""
    prefixes = prefix_hashes(turns)
    whole = prefixes.where("place = turns").groupBy("turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = prefixes.where("place < turns").select(F.col("place").alias("turns"), "h1", "h2").distinct()
    return whole.join(proper, ["turns", "h1", "h2"], "left_anti").select("conv_id", F.col("turns").cast("long").alias("n_turns"), "copies")


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies (of the whole conversation), rendered: one row for each maximal conversation.

    Repeated turns count once; null roles and texts are empty; a null conv_id is a
    conversation of its own; an empty table gives an empty result; other columns are
    ignored. A rendered conversation is one string, so one conversation must fit a row.
    """
    turns = ordered_turns(conversations)
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "_kept")
    lines = turns.select("conv_id", F.struct("place", rendered(F.col("role"), F.col("text")).alias("line")).alias("line"))
    full = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    joined = kept.join(full, kept["_kept"].eqNullSafe(full["conv_id"]))
    return joined.select("conv_id", "n_turns", "copies", F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("rendered"))


ORACLE_SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS turns FROM d GROUP BY conv_id),
w AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS copies FROM o GROUP BY turns),
p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(generate_series(1, len(turns) - 1)) AS k FROM o))
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, copies,
       array_to_string(list_transform(turns, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || chr(10) || '<|end|>' || chr(10)), '') AS rendered
FROM w WHERE turns NOT IN (SELECT turns FROM p)
"""
