"""Greedy choices over pairs as rounds of mutual bests: joins and groupings of edge tables, no group in one task.

A greedy pass takes the best pair that is still allowed, again and again. A pair that is
the best of both its ends is taken whatever happens elsewhere, so all such pairs of a
round can be taken at once; what they rule out leaves, and the next round begins. The
result is the greedy one. Each round is written, so a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.rounds import Rounds


def one_to_one(pairs: DataFrame, left: str, right: str, left_prefers: Column, right_prefers: Column | None = None) -> DataFrame:
    """Rows of ``pairs`` in a one-to-one assignment, each end of which prefers the pair of greatest preference.

    ``left_prefers`` orders the pairs of one left end, ``right_prefers`` those of one
    right end (by default both go by the same order, which gives greedy best-first
    matching). If the right ends agree on an order of the left ends, the result is that
    of letting the left ends choose in this order. Pairs must differ and preferences
    of one end's pairs must too; add the ids as a last criterion. Pairs with a null end
    take no part. An empty table gives an empty result.
    """
    rounds = Rounds(pairs.sparkSession, "one-to-one")
    open_ = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    open_ = open_.withColumns({"_l": left_prefers, "_r": left_prefers if right_prefers is None else right_prefers})
    open_, taken = rounds.cut(open_), []
    while True:
        of_left = open_.groupBy(left).agg(F.max("_l").alias("_lbest"))
        of_right = open_.groupBy(right).agg(F.max("_r").alias("_rbest"))
        mutual = rounds.cut(open_.join(of_left, left).where("_l = _lbest").join(of_right, right).where("_r = _rbest").select(*open_.columns))
        taken.append(mutual)
        if mutual.isEmpty():
            rounds.cleared(*taken)
            return reduce(DataFrame.unionByName, taken).drop("_l", "_r")
        open_ = rounds.cut(open_.join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti"))


def degree_capped(pairs: DataFrame, within: str, score: str, k: int) -> DataFrame:
    """Greedy: best pairs (within, a, b, score, ...) of each subject first, skipping those with an end that has k pairs already.

    Ends are of their subject: the same name in another one is another end. Ties of the score go by (a, b). A pair is taken when it is among as many best pairs of
    either end as that end has room for, since even if all better ones are taken there
    is room; an end without room lets its other pairs go. Repeated pairs count once.
    """
    rounds = Rounds(pairs.sparkSession, "degree")
    open_, taken, room = rounds.cut(pairs.dropDuplicates([within, "a", "b"])), [], None
    while True:
        ends = open_.select(within, "a", "b", F.explode(F.array("a", "b")).alias("_end"), F.col(score).alias("_score"))
        rank = F.row_number().over(Window.partitionBy(within, "_end").orderBy(F.desc("_score"), "a", "b"))
        ends = ends.withColumn("_rank", rank).where(F.col("_rank") <= k)
        if room is not None:
            ends = ends.join(room, [within, "_end"], "left").where(F.col("_rank") <= k - F.coalesce("_used", F.lit(0)))
        both = ends.groupBy(within, "a", "b").agg(F.count("*").alias("_n")).where("_n = 2 or a = b").drop("_n")
        chosen = rounds.cut(open_.join(both, [within, "a", "b"]))
        taken.append(chosen)
        if chosen.isEmpty():
            rounds.cleared(*taken)
            return reduce(DataFrame.unionByName, taken)
        more = chosen.select(within, F.explode(F.array("a", "b")).alias("_end"), F.lit(1).cast("long").alias("_used"))
        room = rounds.cut((more if room is None else room.unionByName(more)).groupBy(within, "_end").agg(F.sum("_used").alias("_used")))
        full = room.where(F.col("_used") >= k).select(within, "_end")
        left = open_.join(chosen.select(within, "a", "b"), [within, "a", "b"], "left_anti")
        for end in ("a", "b"):
            left = left.join(full.withColumnRenamed("_end", end), [within, end], "left_anti")
        open_ = rounds.cut(left.select(*pairs.columns))


def chain_roots(parents: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, root) of a forest of (node, parent) pointers; roots point at themselves. Pointers double, so a chain of n takes log n joins."""
    now = rounds.cut(parents)
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = rounds.cut(now.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("node", F.col("parent").alias("root"))
        now = step.drop("moved")


def separated_components(edges: DataFrame, nodes: DataFrame, apart: DataFrame) -> DataFrame:
    """(node, component): components over edges (a, b, weight) that hold no pair (a, b) of ``apart``.

    As if edges were added strongest first (ties: lesser a, then b first) and one that
    would bring a forbidden pair together were left out: of any path between the two the
    weakest edge is cut. component is the least node of each.

    Each round every component chooses its strongest allowed edge to another one. A
    component without forbidden partners always joins along it, as no joining of others
    can forbid that; one with such partners joins only where the choice is mutual, as
    then neither end can change before this edge's turn. Chains of choices are followed
    in log n joins, and what has no constraint is gone after log n rounds. Self edges
    and pairs of a node with itself are ignored, repeated edges count once with their
    greatest weight, and nodes that only edges name are nodes too.
    """
    rounds = Rounds(edges.sparkSession, "separated")
    flat = lambda df, *more: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more).where("a != b")
    links = flat(edges, "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    # one total order: (weight, -place) with the place of ties by (a, b)
    links = rounds.cut(links.select("a", "b", F.struct("weight", (-F.col("a")).alias("x"), (-F.col("b")).alias("y")).alias("_w")))
    forbidden = rounds.cut(flat(apart).distinct())
    every = nodes.select(F.col(nodes.columns[0]).alias("node")).union(links.select(F.explode(F.array("a", "b")))).distinct()
    labels = rounds.cut(every.select("node", F.col("node").alias("component")))
    while True:
        links = rounds.cut(links.join(forbidden, ["a", "b"], "left_anti"))
        rounds.cleared(links, forbidden, labels)
        if links.isEmpty():
            return labels
        ends = links.select(F.col("a").alias("node"), F.struct("_w", F.col("b").alias("to")).alias("choice")).union(links.select(F.col("b").alias("node"), F.struct("_w", F.col("a").alias("to")).alias("choice")))
        chosen = rounds.cut(ends.groupBy("node").agg(F.max("choice").alias("choice")).select("node", "choice.*"))
        back = chosen.select(F.col("node").alias("to"), F.col("to").alias("theirs"))
        bound = forbidden.select(F.col("a").alias("node")).union(forbidden.select("b")).distinct().withColumn("bound", F.lit(True))
        mutual = F.col("theirs") == F.col("node")
        joins = F.when(mutual, F.least("node", "to")).when(F.col("bound").isNull(), F.col("to")).otherwise(F.col("node"))
        merged = chain_roots(chosen.join(back, "to").join(bound, "node", "left").select("node", joins.alias("parent")), rounds)
        names = merged.groupBy("root").agg(F.min("node").alias("name"))
        now = rounds.cut(merged.join(names, "root").select(F.col("node").alias("component"), F.col("name").alias("next")))
        labels = rounds.cut(labels.join(now, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        renamed = lambda df, *more: flat(df.join(now.select(F.col("component").alias("a"), F.col("next").alias("na")), "a", "left").join(now.select(F.col("component").alias("b"), F.col("next").alias("nb")), "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), *more), *more)
        links = renamed(links, "_w").groupBy("a", "b").agg(F.max("_w").alias("_w"))
        forbidden = rounds.cut(renamed(forbidden).distinct())
