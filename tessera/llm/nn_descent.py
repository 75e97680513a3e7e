"""Approximate nearest neighbours by NN-descent in blocks and greedy graph search.

Nearness in the graph is the squared distance of the vectors in double precision; as the
answers are ranked by inner product, every search also starts at the STARTS vectors of
largest norm. Equal vectors are one node with its least vec_ids as members. Each
round deals the nodes to blocks by a random-projection tree of its own (split points
from a bounded sample; over-full leaves are divided by a hash), brings every block's
nodes and their present neighbours together, and compares them, so neighbours of
neighbours meet through the node they share. Only partners nearer than a node's present
last one leave the block; every node keeps its best K. Rounds end when few lists change.
A query starts at its own node's list and follows the graph
from its best unexpanded nodes; scores are inner products of the original vectors in
double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import write_scratch

NEIGHBOURS = 24
#: Most nodes a block owns, and how many neighbours of each it brings in.
LEAF, BROUGHT = 256, 12
#: Of the nodes a block only brings in, so many best partners are handed on.
ECHO = 10
ROUNDS, LEAST_CHANGE = 6, 0.02
BEAM, EXPANDED, HOPS = 64, 24, 6
#: Nodes of largest norm that every query compares itself with.
STARTS = 64
#: Vectors that fit the projection trees, and the fewest of them in a leaf.
SAMPLE, LEAF_SAMPLE = 20_000, 24


def usable_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector of the rows that take part: no null id, no null, zero or non-finite vector; of the commonest length (the greater of equal ones); repeated rows once."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    rows = rows.where(F.forall("vector", number) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().agg(F.max(F.struct("count", "size"))["size"]).first()[0]
    return rows.where(F.size("vector") == F.lit(sizes or 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class ProjectionTree:
    """Median splits along random directions, as deep as the sample allows, then random half-spaces."""

    def __init__(self, sample: np.ndarray, nodes: int, seed: int):
        rng = np.random.default_rng(seed)
        want = max(0, int(np.ceil(np.log2(max(nodes, 1) / LEAF))))
        self.depth = max(0, min(want, int(np.log2(max(len(sample) / LEAF_SAMPLE, 1)))))
        d = sample.shape[1] if len(sample) else 1
        self.normals, self.cuts = np.zeros((1 << self.depth, d)), np.zeros(1 << self.depth)
        at = np.ones(len(sample), np.int64)
        for level in range(self.depth):
            for node in range(1 << level, 2 << level):
                own = sample[at == node]
                a, b = own[rng.integers(len(own), size=2)] if len(own) else np.zeros((2, d))
                self.normals[node] = (a - b) + rng.normal(size=d) * 1e-3
                self.cuts[node] = np.median(own @ self.normals[node]) if len(own) else 0.0
            at = self._down(sample, at)
        self.extra = rng.normal(size=(d, max(0, want - self.depth)))
        self.middle = np.median(sample, axis=0) if len(sample) else np.zeros(d)

    def _down(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 2 * at + (np.einsum("ij,ij->i", x, self.normals[at]) > self.cuts[at])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            at = self._down(x, at)
        for bit in (((x - self.middle) @ self.extra) > 0).T:
            at = 2 * at + bit
        return at


def _leaf_column(tree: ProjectionTree, vector: Column | str) -> Column:
    @F.arrow_udf(T.LongType())
    def leaf(rows: pa.Array) -> pa.Array:
        return pa.array(tree.leaf(_matrix(rows, len(rows))))

    return leaf(vector)


@F.arrow_udf(T.DoubleType())
def inner_product(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.einsum("ij,ij->i", _matrix(a, len(a)), _matrix(b, len(b))) if len(a) else np.zeros(0))


_EDGES = T.StructType([T.StructField("node", T.LongType()), T.StructField("other", T.LongType()), T.StructField("near", T.DoubleType())])


def _best_partners(near: np.ndarray, bound: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its k nearest columns that are nearer than the row's bound: row, column, near."""
    row, column = np.nonzero(near > bound[:, None])
    if len(row) > near.size // 64:  # many: find the best of each row before sorting
        most = min(int(k.max()), near.shape[1])
        column = np.argpartition(-near, most - 1, axis=1)[:, :most].ravel()
        row = np.repeat(np.arange(len(near)), most)
        nearer = near[row, column] > bound[row]
        row, column = row[nearer], column[nearer]
    value = near[row, column]
    order = np.lexsort((-value, row))
    row, column, value = row[order], column[order], value[order]
    take = np.arange(len(row)) - np.searchsorted(row, row) < k[row]
    return row[take], column[take], value[take]


def _compare(block: pa.Table) -> pa.Table:
    """Best partners inside one block that are nearer than a node's present last neighbour: up to NEIGHBOURS for
    nodes it owns, ECHO for those brought in.
    """
    node, own = block.column("node").to_numpy(), block.column("own").to_numpy(zero_copy_only=False).astype(bool)
    bound = block.column("bound").to_numpy(zero_copy_only=False)
    x = _matrix(block.column("vector").combine_chunks(), len(node))
    square = np.einsum("ij,ij->i", x, x)
    k = np.where(own, NEIGHBOURS, ECHO)
    out = []
    for i in range(0, len(node) if len(node) > 1 else 0, 512):
        near = 2 * (x[i : i + 512] @ x.T) - square[i : i + 512, None] - square
        near[np.isnan(near)] = -np.inf  # squares that overflow
        rows = np.arange(len(near))
        near[rows, i + rows] = -np.inf
        row, column, value = _best_partners(near, bound[i : i + 512], k[i : i + 512])
        out.append((node[i + row], node[column], value))
    join = lambda i, kind: np.concatenate([part[i] for part in out]).astype(kind) if out else np.zeros(0, kind)
    return pa.table({"node": join(0, np.int64), "other": join(1, np.int64), "near": join(2, np.float64)})


def _best(edges: DataFrame, k: int) -> DataFrame:
    once = edges.groupBy("node", "other").agg(F.max("near").alias("near"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("near"), "other"))).where(F.col("rank") <= k)


def neighbour_graph(points: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, other, near, rank: each node's list, from ``points`` (node, vector)."""
    n = points.count()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    sample = points.select("vector").where(F.rand(11) < share).limit(SAMPLE).toArrow().column("vector").combine_chunks()
    sample = _matrix(sample, len(sample)) if len(sample) else np.zeros((0, 1))
    graph = None
    for turn in range(rounds):
        tree = ProjectionTree(sample, n, 100 + turn)
        placed = points.select("node", _leaf_column(tree, "vector").alias("leaf"))
        placed = write_scratch(placed, "leaves")
        sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
        blocks = placed.join(sizes, "leaf").select("node", F.xxhash64("leaf", F.pmod(F.xxhash64("node", F.lit(turn)), "parts")).alias("block"))
        members = blocks.select("block", "node", F.lit(1).alias("own"))
        if graph is not None:
            brought = blocks.join(graph.where(F.col("rank") <= BROUGHT), "node").select("block", F.col("other").alias("node"), F.lit(0).alias("own"))
            members = members.unionByName(brought).groupBy("block", "node").agg(F.max("own").alias("own"))
        known = points.withColumn("bound", F.lit(float("-inf")))
        if graph is not None:
            last = graph.where(F.col("rank") == NEIGHBOURS).select("node", F.col("near").alias("bound"))
            known = points.join(last, "node", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        found = members.join(known, "node").groupBy("block").applyInArrow(_compare, _EDGES)
        now = write_scratch(_best(found if graph is None else found.unionByName(graph.drop("rank")), NEIGHBOURS), "graph")
        if graph is not None:
            changed = now.join(graph, ["node", "other"], "left_anti").count()
            graph = now
            if changed <= LEAST_CHANGE * NEIGHBOURS * n:
                break
        graph = now
        if n <= LEAF:
            break
    return graph


def greedy_search(starts: DataFrame, vectors: DataFrame, graph: DataFrame, beam: int = BEAM, hops: int = HOPS) -> DataFrame:
    """query, node, score: the best ``beam`` nodes for each query node of ``starts`` (query), itself among them.

    ``vectors``: node, vector, square.
    """
    large = vectors.orderBy(F.desc("square"), "node").limit(STARTS).select("node")
    vectors = vectors.select("node", "vector")
    lists = graph.select("node", "other")
    target = starts.join(vectors, starts["query"] == vectors["node"]).select("query", F.col("vector").alias("sought"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(vectors, "node").join(target, "query").select("query", "node", inner_product("sought", "vector").alias("score"))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    first = starts.select("query", F.col("query").alias("node")).unionByName(starts.join(lists, starts["query"] == lists["node"]).select("query", F.col("other").alias("node")))
    first = first.unionByName(starts.select("query").crossJoin(F.broadcast(large))).distinct()
    seen = scored(first).withColumn("expanded", F.col("node") == F.col("query"))
    for _ in range(hops):
        # what lies beyond the beam now can only sink; met again, it is scored again and sinks again
        kept = seen.withColumn("place", F.row_number().over(best)).where(F.col("place") <= beam)
        kept = write_scratch(kept.withColumn("now", (F.col("place") <= EXPANDED) & ~F.col("expanded")), "beam")
        frontier = kept.where("now").select("query", "node")
        seen = kept.select("query", "node", "score", (F.col("expanded") | F.col("now")).alias("expanded"))
        if frontier.isEmpty():
            break
        reached = frontier.join(lists, "node").select("query", F.col("other").alias("node")).distinct().join(kept.select("query", "node"), ["query", "node"], "left_anti")
        seen = seen.unionByName(scored(reached).withColumn("expanded", F.lit(False)))
    return seen.withColumn("place", F.row_number().over(best)).where(F.col("place") <= beam).select("query", "node", "score")


def search(embeddings: DataFrame, query_filter: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row that the filter (on vec_id) selects.

    Every usable row but the query's own is a candidate; ties go to the smaller vec_id.
    Vectors that are null, zero, hold null or non-finite components, or have another
    length than most take no part. Repeated rows count once; vec_ids are taken as unique
    otherwise. With fewer than k candidates all are returned. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = usable_vectors(embeddings)
    keyed = write_scratch(rows.select("vec_id", F.xxhash64(F.lit(1), "vector").alias("h1"), F.xxhash64(F.lit(2), "vector").alias("h2"), "vector").dropDuplicates(["vec_id", "h1", "h2"]), "vectors")
    # the k + 1 least members of each distinct vector are all that an answer can hold
    few = keyed.select("vec_id", "h1", "h2").withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    groups = write_scratch(few.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("members")), "groups")
    vectors = groups.join(keyed, (groups["node"] == keyed["vec_id"]) & (groups["h1"] == keyed["h1"]) & (groups["h2"] == keyed["h2"])).select("node", "vector")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    vectors = write_scratch(vectors.withColumn("square", square(F.col("vector"))), "points")
    graph = neighbour_graph(vectors.select("node", "vector"))
    askers = keyed.where(query_filter).select(F.col("vec_id").alias("query_id"), "h1", "h2").join(groups.select("h1", "h2", "node"), ["h1", "h2"]).select("query_id", "node")
    askers = write_scratch(askers, "queries")
    found = greedy_search(askers.select(F.col("node").alias("query")).distinct(), vectors, graph)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    spread = found.join(groups.select("node", "members"), "node").select("query", "score", F.explode("members").alias("vec_id"))
    top = spread.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    answers = askers.join(top, askers["node"] == top["query"]).where("query_id != vec_id")
    final = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")
