"""Vector best-fit packing: every sequence has a token, a document and an attention-cost capacity.

Documents are cut into pieces where they are tokenised; only piece lengths travel.
Pieces that fill a sequence alone never move. The others are dealt by a hash of their
row's place in the written table into groups of about GROUP_PIECES (so no group grows
with the input, and equal rows spread), and each group packs its pieces by decreasing length: among the open
sequences that keep within every capacity the one with the least weighted residual norm
(or the greatest weighted dot product of demand and residual) takes the piece. Each
group leaves at most a few sequences open, out of about four thousand.

With the query's own limits (1024 documents, the square of 1024 as attention cost) the
token limit implies the other two; smaller ones bind, as for an engine whose attention
cost is bounded below a full sequence's.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import encoder

TOKENS = 1024
END_ID = 2
GROUP_PIECES = 8_192
#: Weights of the token, document-count and attention-cost dimensions, each measured in shares of its capacity.
WEIGHTS = (1.0, 0.001, 0.01)
PIECES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``capacity`` ids, but the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(at, capacity) for at in range(first, n, capacity)]


def pieces_udf(capacity: int = TOKENS, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, special: bool = False):
    @F.arrow_udf(PIECES)
    def pieces(text: pa.Array) -> pa.Array:
        counts, out = [], []
        encode = encoder(vocabulary, special)
        for value in text:
            ids = array("I", encode(value.as_py() or ""))
            ids.append(end_id)
            parts, raw = cut(len(ids), capacity), memoryview(ids).cast("B")
            counts.append(len(parts))
            out.extend((at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])) for at, n in parts)
        flat = np.array(out, np.int64).reshape(-1, 3)
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "ids_crc32"]))

    return pieces


def vector_best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; no bin exceeds (tokens, pieces, sum of squared lengths)."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2]) / np.array(capacities, float)[:, None]
    if (demand > 1).any():
        raise ValueError("a piece exceeds a capacity by itself")
    order = np.argsort(-lengths, kind="stable")
    slack = 1e-12
    least = demand[:, order[-1]] - slack
    residual, used, number = np.empty((3, n)), np.empty(n, np.int64), np.empty(n, np.int64)
    w = np.array(weights, float)
    opened = live = 0
    for item in order:
        need = demand[:, item]
        at = live
        if live:
            left = residual[:, :live] - need[:, None]
            score = w @ (left * left) if rule == "norm" else -(w * need) @ residual[:, :live]
            score[left.min(axis=0) < -slack] = np.inf
            best = int(score.argmin())
            at = best if score[best] < np.inf else live
        if at == live:
            residual[:, at], used[at], number[at] = 1.0, 0, opened
            live, opened = live + 1, opened + 1
        bins[item], offsets[item] = number[at], used[at]
        residual[:, at] -= need
        used[at] += lengths[item]
        if (residual[:, at] < least).any():  # nothing fits any more: the last open bin takes its place
            live -= 1
            residual[:, at], used[at], number[at] = residual[:, live], used[live], number[live]
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = TOKENS, max_documents: int = TOKENS, max_attention: int = TOKENS * TOKENS, rule: str = "norm", group_pieces: int = GROUP_PIECES, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length``; all other columns stay.

    ``pieces`` must give the same rows each time it is read (a written table), as it is
    read once for the number of rows.
    """
    full = F.col("length") == capacity
    alone = pieces.where(full)
    rest = pieces.where(~full)
    groups = max(1, -(-rest.count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    caps = (capacity, max_documents, max_attention)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number, at = vector_best_fit(rows["length"].to_numpy(), caps, weights, rule)
        return rows.drop(columns="_group").assign(sequence_id=(number * groups + key[0]) * 2, offset=at)[schema.names]

    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    packed = rest.withColumn("_group", salt).groupBy("_group").applyInPandas(pack, schema)
    single = alone.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(single)


def document_pieces(docs: DataFrame, capacity: int = TOKENS, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id", special: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document. A null or empty text has the end id alone."""
    cut_up = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces_udf(capacity, vocabulary, end_id, special)(text_col)).alias("piece", "_p"))
    return cut_up.select("doc_id", "piece", "_p.start", "_p.length", "_p.ids_crc32")


def best_fit_sequences(docs: DataFrame, capacity: int = TOKENS, special: bool = False, **options) -> DataFrame:
    """Pack all of ``docs`` into sequences of at most ``capacity`` tokens under every constraint.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Repeated rows and null doc_ids are packed like any others; a null or empty text is a
    piece of one end id; an empty table gives an empty result; other columns are ignored.
    """
    from tessera.llm.common import write_scratch

    return pack_pieces(write_scratch(document_pieces(docs, capacity, special=special), "pieces"), capacity, **options)
