"""Fragments of one fact that sit on neighbouring sentences, joined where nothing they say conflicts.

Facts come in reading order with the sentences they cite and a map of attributes (a
nested record is flattened to paths, ``a.b``). Islands are found by windows: a fact that
has another concept than the one before it, cites nothing, or lies beyond every sentence
cited so far begins one. Inside an island, whose facts all share a concept, the facts
are folded one after the other, since whether one joins depends on what has joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_REFS = 6


def concept(text: Column, most: int) -> Column:
    """A label for comparison: white space to one blank, cut, without regard to case."""
    return F.lower(F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, most))


def stated(attributes: Column) -> Column:
    """The attributes that say something: no null and no empty value; a null map says nothing."""
    return F.map_filter(F.coalesce(attributes, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != ""))


def conflict(left: Column, right: Column) -> Column:
    """True if two maps give one path two values, or one gives a value where the other has a record."""
    inside = lambda a, b: F.startswith(b, F.concat(a, F.lit(".")))
    clash = lambda k, v: F.exists(F.map_entries(left), lambda e: ((e["key"] == k) & (e["value"] != v)) | inside(e["key"], k) | inside(k, e["key"]))
    return F.exists(F.map_entries(right), lambda e: clash(e["key"], e["value"]))


def filled(left: Column, right: Column) -> Column:
    """The left map with the right one's paths that it lacks."""
    return F.map_concat(left, F.map_filter(right, lambda k, v: ~F.map_contains_key(left, k)))


def coalesced(facts: DataFrame, document: str, seq: str, category: str, entity: str, refs: str, attributes: str, most_refs: int = MOST_REFS) -> DataFrame:
    """document, seq, category, entity, refs, attributes, fragments: the facts of each document after joining.

    A fact joins the one before it (as joined so far) if both have the same category and
    entity, its first reference is at most one past the other's last, together they
    have at most ``most_refs``, and no attribute conflicts; missing attributes are filled
    in. The first fact's own fields stay. References are taken distinct and sorted, ones
    that are null or below 1 are dropped; a fact without references joins nothing and
    nothing joins it. ``seq`` orders a document's facts and must differ; other columns
    are dropped; an empty table gives an empty result.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(refs), F.array().cast("array<int>")), lambda x: x > 0)))
    rows = facts.select(document, seq, F.col(category).alias("category"), F.col(entity).alias("entity"), clean.alias("refs"), stated(F.col(attributes)).alias("attributes"))
    rows = rows.withColumn("_concept", F.struct(concept(F.col("category"), 100), concept(F.col("entity"), 300)))
    order = Window.partitionBy(document).orderBy(seq)
    before = F.lag("_concept").over(order)
    cut = before.isNull() | (before != F.col("_concept")) | (F.size("refs") == 0) | (F.lag(F.size("refs")).over(order) == 0)
    rows = rows.withColumn("_run", F.sum(cut.cast("int")).over(order))
    inside = Window.partitionBy(document, "_run").orderBy(seq)
    reach = F.max(F.try_element_at("refs", F.lit(-1))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    beyond = F.coalesce(F.get("refs", F.lit(0)) > reach + 1, F.lit(False))
    rows = rows.withColumn("_beyond", beyond).withColumn("_island", F.sum(F.col("_beyond").cast("int")).over(inside))

    one = F.struct(F.col(seq).alias("seq"), "category", "entity", "refs", "attributes", F.lit(1).alias("fragments"))
    islands = rows.groupBy(document, "_run", "_island").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["seq"] < b["seq"], -1).otherwise(1)).alias("parts"))
    kind = islands.schema["parts"].dataType.simpleString()

    def joined(a: Column, b: Column) -> Column:
        united = F.array_sort(F.array_union(a["refs"], b["refs"]))
        return F.struct(a["seq"].alias("seq"), a["category"].alias("category"), a["entity"].alias("entity"), united.alias("refs"), filled(a["attributes"], b["attributes"]).alias("attributes"), (a["fragments"] + 1).alias("fragments"))

    def step(done: Column, b: Column) -> Column:
        a = F.element_at(done, -1)
        near = (F.get(b["refs"], F.lit(0)) <= F.try_element_at(a["refs"], F.lit(-1)) + 1) & (F.size(F.array_union(a["refs"], b["refs"])) <= most_refs)
        fits = near & ~conflict(a["attributes"], b["attributes"])
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(a, b)))).otherwise(F.concat(done, F.array(b)))

    folded = F.when(F.size("parts") == 1, F.col("parts")).otherwise(F.aggregate(F.slice("parts", 2, F.size("parts")), F.slice("parts", 1, 1).cast(kind), step))
    return islands.select(document, F.explode(folded).alias("f")).select(document, F.col("f.seq").alias(seq), "f.category", "f.entity", "f.refs", "f.attributes", "f.fragments")
