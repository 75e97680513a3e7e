"""Ids that reviewed events keep when clusters are formed anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matching import one_to_one

#: Categories whose new episodes are named by their first evidence, not by their number.
ACUTE = ["symptom", "clinical_sign", "vital_sign", "adverse_event", "hospitalization", "discharge", "procedure", "surgery"]
#: The name space of addresses in RFC 4122.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stable_id(prefix: str, *parts: Column) -> Column:
    """The prefix and the name-based (version 5) UUID of the parts; a null part is empty."""
    name = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit(f"{prefix}_"), F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def carried(clusters: DataFrame, members: DataFrame, events: DataFrame, cited: DataFrame) -> DataFrame:
    """cluster, event_id, episode_id, previous_episode_id, is_carried: the id each cluster gets.

    ``clusters``: cluster, subject, category, entity, episode (its number among those of
    the subject, category and entity); ``members``: cluster, evidence_id, day, document_id;
    ``events``, known before: event_id, subject, category, entity, episode_id; ``cited``:
    event_id, evidence_id. In order of entity and episode the clusters of a subject and
    category choose among its known events not yet taken the one they share most evidence
    with, then one of their own entity, then the greatest id; without one they get a new
    id from subject, category, entity and their episode, for acute categories from their
    first evidence (by day, unknown days last, document, id). Clusters and events are
    unique; repeated members and citations count once; a null category or subject
    matches nothing.
    """
    shared = members.select("cluster", "evidence_id").distinct().join(cited.select("event_id", "evidence_id").distinct(), "evidence_id").groupBy("cluster", "event_id").agg(F.count("*").alias("overlap"))
    known = events.select("event_id", F.col("subject").alias("_s"), F.col("category").alias("_c"), F.col("entity").alias("_e"), F.col("episode_id").alias("_episode_id"))
    pairs = shared.join(clusters, "cluster").join(known, "event_id").where("subject = _s and category = _c")
    same = (F.col("entity").eqNullSafe(F.col("_e"))).cast("int")
    # the first to choose have the greatest preference of an event: order is by entity, then episode, as a rank
    turn = clusters.select("cluster", F.row_number().over(Window.partitionBy("subject", "category").orderBy("entity", "episode", "cluster")).alias("_turn"))
    chosen = one_to_one(pairs.join(turn, "cluster"), "cluster", "event_id", F.struct("overlap", same.alias("same"), "event_id"), -F.col("_turn")).select("cluster", "event_id", "_episode_id")

    first = members.groupBy("cluster").agg(F.min(F.struct(F.col("day").isNull().alias("n"), "day", "document_id", "evidence_id"))["evidence_id"].alias("_anchor"))
    rows = clusters.join(first, "cluster", "left").join(chosen, "cluster", "left")
    token = F.when(F.col("category").isin(ACUTE), F.col("_anchor").cast("string")).otherwise(F.col("episode").cast("string"))
    new = lambda prefix: stable_id(prefix, F.col("subject"), F.col("category"), F.col("entity"), token)
    taken = F.col("event_id").isNotNull()
    rows = rows.withColumns({
        "is_carried": taken,
        "episode_id": F.when(taken, F.coalesce("_episode_id", stable_id("EPI", F.col("event_id")))).otherwise(new("EPI")),
        "event_id": F.coalesce("event_id", new("EVT")),
    })
    before = F.lag("episode_id").over(Window.partitionBy("subject", "category", "entity").orderBy("episode", "cluster"))
    return rows.select("cluster", "event_id", "episode_id", before.alias("previous_episode_id"), "is_carried")
