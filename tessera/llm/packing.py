"""Token-id output: best-fit-decreasing packing with segment-tree capacity search.

Documents are tokenised where they are read; ids travel as 16- or 32-bit little-endian
integers. Overlong documents are cut losslessly into pieces of the capacity. Pieces are
dealt by a hash of their row's place in the table into groups of about GROUP_BYTES of text, and each group packs its
pieces on its own: the longest first, each into the open row with the least sufficient
room, which a segment tree over room sizes finds in logarithmic time.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import encoder
from tessera.llm.vector_packing import END_ID, cut

CAPACITY = 2048
GROUP_BYTES = 8 << 20
PAD_ID = 0


class RoomTree:
    """Counts of open rows by room, as a segment tree; ``least(need)`` is the smallest room that suffices, or -1."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int:
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:  # up to the first ancestor with rows to the right, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows as lists of piece numbers, longest piece first; each row's lengths add up to at most ``capacity``."""
    tree, rows, by_room = RoomTree(capacity), [], [[] for _ in range(capacity + 1)]
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        if n > capacity:
            raise ValueError("a piece exceeds the capacity")
        room = tree.least(n)
        if room < 0:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(piece)
        by_room[room - n].append(row)
        tree.add(room - n, 1)
    return rows


_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())]))
_ROWS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_resets", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
    ]
)


def id_pieces_udf(capacity: int, vocabulary: str, end_id: int, width: int, special: bool = False):
    code = {2: "H", 4: "I"}[width]

    @F.arrow_udf(_PIECES)
    def pieces(text: pa.Array) -> pa.Array:
        encode, counts, starts, parts = encoder(vocabulary, special), [], [], []
        for value in text:
            ids = array(code, encode(value.as_py() or ""))
            ids.append(end_id)
            raw = ids.tobytes()
            places = cut(len(ids), capacity)
            counts.append(len(places))
            starts += [at for at, _ in places]
            parts += [raw[width * at : width * (at + n)] for at, n in places]
        ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["start", "ids"]))

    return pieces


def packed_rows(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, pad_id: int = PAD_ID, width: int = 2, text_col: str = "text", id_col: str = "doc_id", special: bool = False) -> DataFrame:
    """One row for each row of the packed id matrix.

    row_id (unique, no order), n_tokens, ids (``capacity`` ids of ``width`` bytes, padded
    by ``pad_id``), cu_seqlens (0 and each segment's end), position_resets (where position
    ids start again from 0; the padding counts as one more segment), doc_ids and starts (of
    each segment, the place in its document). Concatenating a document's segments by start
    gives its ids and the end id. ``docs`` is a table, whose files give the same rows
    each time they are read; equal rows spread over the groups. A null or empty text is one end id; null ids and repeated
    rows are packed like any others; an empty table gives an empty result; other columns
    are ignored.
    """
    size = docs.agg(F.sum(F.octet_length(text_col) + 8)).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(id_pieces_udf(capacity, vocabulary, end_id, width, special)(text_col)).alias("p")).select("doc_id", "p.start", "p.ids")
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        doc, start = table.column("doc_id").to_pylist(), table.column("start").to_pylist()
        lengths = np.array([len(x) // width for x in ids], np.int64)
        rows = best_fit_decreasing(lengths, capacity)
        ends = [np.append(0, np.cumsum(lengths[r])).tolist() for r in rows]
        pad = pad_id.to_bytes(width, "little")
        group = key[0].as_py()
        return pa.table(
            {
                "row_id": pa.array([i * groups + group for i in range(len(rows))], pa.int64()),
                "n_tokens": pa.array([e[-1] for e in ends], pa.int32()),
                "ids": pa.array([b"".join(ids[p] for p in r) + pad * (capacity - e[-1]) for r, e in zip(rows, ends, strict=True)], pa.binary()),
                "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
                "position_resets": pa.array([e if e[-1] < capacity else e[:-1] for e in ends], pa.list_(pa.int32())),
                "doc_ids": pa.array([[doc[p] for p in r] for r in rows], pa.list_(pa.int64())),
                "starts": pa.array([[start[p] for p in r] for r in rows], pa.list_(pa.int64())),
            }
        )

    return dealt.groupBy("_group").applyInArrow(pack, _ROWS)


def write_matrix(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet; a file's ``ids`` column is a matrix of fixed-width rows."""
    packed_rows(docs, **options).write.parquet(path)
