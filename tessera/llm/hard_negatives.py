"""Hard negatives by a vector-approximation file.

Each dimension is quantised into CELLS cells; the approximation of a row is one byte a
dimension. For an anchor two tables hold, for each dimension and cell, the least and the
greatest product its own component can have with a component of the cell, so adding
looked-up entries gives a lower and an upper bound of the row's score without its
vector. Only rows whose bounds leave open whether they enter a result are scored exactly,
by joining their vectors. Cell borders inside a dimension are quantiles of a bounded
sample; the outermost borders are the table's least and greatest components, so every
row is inside its cells and the bounds always hold.

The anchors and all rows are dealt to tiles of an anchor block and a row block; each tile
is a bounded task. Two such passes run: the first finds each anchor's positives, the
second the rows that may enter the score windows these open. Rows that share label and
whole-number vector also share all scores, so of each such group only the least
MEMBERS ids can ever be among the first TOP; the others leave before the passes, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import write_scratch

SCALE = 256
TOP = 5
#: An anchor itself may be one of the least ids of its group.
MEMBERS = TOP + 1
LOW, HIGH = 80, 100
CELLS = 256
#: Rows that fit the cell borders; anchors and rows of a tile; rows looked up at a time.
SAMPLE, ANCHORS, ROWS, STEP = 4096, 512, 4096, 1024
#: Scores are summed in 64-bit integers.
MOST = 1 << 62


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector (array<bigint>): the rows that take part, whole-numbered, labels changed where the id is divisible by 7."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("vec_id is not null and label is not null and vector is not null").where(F.forall("vector", number))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("vector", lambda x: F.floor(x * SCALE)).alias("vector"))
    first = Window.partitionBy("vec_id").orderBy("label", "vector")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _padded(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("vector"))))


class Cells:
    """Borders of each dimension's cells: cell c of dimension j holds whole numbers from low[j, c] to high[j, c]."""

    def __init__(self, least: np.ndarray, greatest: np.ndarray, sample: np.ndarray, cells: int = CELLS):
        d = len(least)
        inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower").T.astype(np.int64) if len(sample) else np.repeat(least[:, None], cells - 1, 1)
        self.starts = np.sort(np.clip(inner, least[:, None], greatest[:, None]), axis=1)
        self.low = np.concatenate([least[:, None], self.starts], 1)
        self.high = np.maximum(np.concatenate([self.starts - 1, greatest[:, None]], 1), self.low)
        self.offset = np.arange(d, dtype=np.intp) * cells

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each component."""
        out = np.empty(vectors.shape, np.uint8)
        for j, starts in enumerate(self.starts):
            out[:, j] = np.searchsorted(starts, vectors[:, j], "right")
        return out

    def tables(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of each component of ``anchor`` with each cell, flat."""
        a, b = anchor[:, None] * self.low, anchor[:, None] * self.high
        return np.minimum(a, b).ravel(), np.maximum(a, b).ravel()


def _ends(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many components the longest vector has, and the least and greatest of each place: one row for each task comes to the driver's aggregate."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, greatest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for vector in (np.asarray(v, np.int64) for v in batch.column(0).to_pylist()):
                if len(vector) > len(least):
                    more = vector[len(least) :]
                    least, greatest = np.append(least, more), np.append(greatest, more)
                least[: len(vector)] = np.minimum(least[: len(vector)], vector)
                greatest[: len(vector)] = np.maximum(greatest[: len(vector)], vector)
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(least)), "least": least, "greatest": greatest})

    found = rows.select("vector").mapInArrow(ends, "place long, least long, greatest long").groupBy("place").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).orderBy("place").collect()
    return len(found), np.array([r.least for r in found], np.int64), np.array([r.greatest for r in found], np.int64)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _bounds(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sum of each row's looked-up entries; ``cells`` are places in the flat table."""
    out = np.empty(len(cells), np.int64)
    for i in range(0, len(cells), STEP):
        out[i : i + STEP] = table[cells[i : i + STEP]].sum(1)
    return out


def _may_be_positive(quantiser: Cells):
    """For each anchor of a tile: the rows of its label whose upper bound reaches the TOP-th best lower bound."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        where, floor, ids, who = _laid_out(quantiser, anchors, rows)
        label = rows.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        begin, end = (np.searchsorted(label[order], anchors.column("label").to_numpy(), side) for side in ("left", "right"))
        out = []
        for i, (anchor, vector) in enumerate(zip(who, _matrix(anchors.column("vector"), len(who)), strict=True)):
            same = order[begin[i] : end[i]]
            same = same[ids[same] != anchor]
            low, high = (_bounds(where[same], t) for t in quantiser.tables(vector))
            least = np.partition(low, len(low) - TOP)[len(low) - TOP] if len(low) > TOP else floor
            open_ = high >= least
            out.append((np.full(open_.sum(), anchor), ids[same[open_]], high[open_], np.full(open_.sum(), least)))
        return _table(out, ("anchor_id", "vec_id", "high", "least"))

    return find


def _may_be_negative(quantiser: Cells):
    """For each window of a tile's anchors: the rows of other labels that may lie in it and may be among its first TOP."""

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        where, floor, ids, who = _laid_out(quantiser, anchors, rows)
        label, mine = rows.column("label").to_numpy(), anchors.column("label").to_numpy()
        out = []
        for i, (anchor, vector, scores) in enumerate(zip(who, _matrix(anchors.column("vector"), len(who)), anchors.column("scores").to_pylist(), strict=True)):
            lookup = quantiser.tables(vector)
            high = _bounds(where, lookup[1])
            may = np.flatnonzero((label != mine[i]) & (HIGH * high >= LOW * min(scores)))
            high, low = high[may], _bounds(where[may], lookup[0])
            for score in sorted(set(scores)):
                sure = low[(HIGH * low >= LOW * score) & (high <= score)]
                least = np.partition(sure, len(sure) - TOP)[len(sure) - TOP] if len(sure) >= TOP else floor
                open_ = (HIGH * high >= LOW * score) & (low <= score) & (high >= least)
                out.append((np.full(open_.sum(), anchor), ids[may[open_]], high[open_], np.full(open_.sum(), least), np.full(open_.sum(), score)))
        return _table(out, ("anchor_id", "vec_id", "high", "least", "positive_score"))

    return find


def _laid_out(quantiser: Cells, anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(len(rows), -1)
    return cells + quantiser.offset[: cells.shape[1]], np.iinfo(np.int64).min, rows.column("vec_id").to_numpy(), anchors.column("anchor_id").to_numpy()


def _table(parts: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(len(names))]
    return pa.table(dict(zip(names, columns, strict=True)))


def _tiled(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], find, schema: str) -> DataFrame:
    """``find`` on each tile of an anchor block and a row block; both sides are replicated to the other's blocks."""
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", block("anchor_id", blocks[0]).alias("_a")).select("*", each(blocks[1]).alias("_r"))
    right = rows.select("*", block("vec_id", blocks[1]).alias("_r")).select("*", each(blocks[0]).alias("_a"))
    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r")).applyInArrow(lambda a, r: find(a.drop(["_a", "_r"]), r.drop(["_a", "_r"])), schema)


def _still_open(candidates: DataFrame, *keys: str) -> DataFrame:
    """Candidates whose upper bound reaches the best of all tiles' TOP-th lower bounds."""
    return candidates.withColumn("_least", F.max("least").over(Window.partitionBy(*keys))).where("high >= _least").drop("high", "least", "_least")


@F.arrow_udf(T.LongType())
def score(a: pa.Array, b: pa.Array) -> pa.Array:
    """Inner products of whole-number vectors."""
    size = len(a)
    return pa.array(np.einsum("ij,ij->i", *[np.asarray(x.flatten()).reshape(size, -1) for x in (a, b)]) if size else np.zeros(0, np.int64), pa.int64())


def _scored(candidates: DataFrame, anchors: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    theirs = candidates.join(vectors.select("vec_id", F.col("vector").alias("_b")), "vec_id")
    both = theirs.join(anchors.select("anchor_id", F.col("vector").alias("_a")), "anchor_id")
    return both.withColumn(name, score("_a", "_b")).drop("_a", "_b")


def mined(embeddings: DataFrame, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor's first positives.

    ``anchor`` chooses the anchors by vec_id (those divisible by 100). Rows with a null
    id, label or vector or a null or non-finite component take no part. Of rows that
    share an id the one of least label and vector counts, so repeated rows count once. A
    vector shorter than the longest is taken as followed by zeros. An empty table, an
    anchor without another row of its label and a window without rows give no rows. Other
    columns are ignored. Scores are 64-bit integers: a table whose components are so large
    that a score could exceed them is refused.
    """
    spark = embeddings.sparkSession
    rows = write_scratch(usable(embeddings), "whole")
    size, least, greatest = _ends(rows)
    if size and sum(int(x) ** 2 for x in np.maximum(np.abs(least), np.abs(greatest))) * HIGH >= MOST:
        raise ValueError("components too large: a score could exceed 64 bits")
    rows = _padded(rows, size)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()  # fits the borders only
    sample = np.array([r.vector for r in sample], np.int64).reshape(len(sample), size)
    quantiser = Cells(np.minimum(least, 0), np.maximum(greatest, 0), sample)

    @F.arrow_udf(T.BinaryType())
    def cells(vectors: pa.Array) -> pa.Array:
        found = quantiser.of(np.asarray(vectors.flatten()).reshape(len(vectors), -1))
        return pa.array([row.tobytes() for row in found], pa.binary())

    group = Window.partitionBy("label", "vector").orderBy("vec_id")
    distinct = rows.withColumn("_n", F.row_number().over(group)).where(F.col("_n") <= MEMBERS).drop("_n")
    file = write_scratch(distinct.select("vec_id", "label", cells("vector").alias("cells")), "approximations")
    anchors = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor).withColumnRenamed("vec_id", "anchor_id")
    blocks = (max(1, -(-anchors.count() // ANCHORS)), max(1, -(-file.count() // ROWS)))

    found = _tiled(anchors, file, blocks, _may_be_positive(quantiser), "anchor_id long, vec_id long, high long, least long")
    scored = _scored(_still_open(found, "anchor_id"), anchors, rows, "positive_score")
    best = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "vec_id")
    positives = scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= TOP).select("anchor_id", F.col("vec_id").alias("positive_id"), "positive_score")
    positives = write_scratch(positives, "positives")

    opened = anchors.join(positives.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores")), "anchor_id")  # TOP at most
    found = _tiled(opened, file, blocks, _may_be_negative(quantiser), "anchor_id long, vec_id long, high long, least long, positive_score long")
    scored = _scored(_still_open(found, "anchor_id", "positive_score").select("anchor_id", "vec_id").distinct(), anchors, rows, "negative_score")
    inside = (F.lit(LOW) * F.col("positive_score") <= F.lit(HIGH) * F.col("negative_score")) & (F.col("negative_score") <= F.col("positive_score"))
    joined = positives.join(scored.withColumnRenamed("vec_id", "negative_id"), "anchor_id").where(inside)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return joined.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= TOP).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 5
"""
