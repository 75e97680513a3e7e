"""Near-duplicate classes by BagMinHash signatures over multisets of word shingles.

Each distinct shingle of a text, with its count as weight, runs Poisson processes
over the dyadic intervals [0,1), [1,2), [2,4), ... of the weight axis. A point has a
time, a level inside its interval (points at or above the weight do not count) and
one of the signature's registers; a register keeps its earliest time. Two texts
agree in a register with probability equal to their weighted Jaccard similarity.
Points are made in order of time and only up to the time by which all registers of
the text are filled.

Candidates come from bands of four registers. Equal texts are one node from the
start. A node's centrality is the number of nodes that share its buckets, over all
bands; each bucket's most central node, as a rule the text that its near copies were
made from, is compared with all its members. That joins most classes with work that is
linear in a bucket's size. Only buckets that then still hold two components go on: in
each, every node outside the largest component is compared with all others, in blocks of
bounded size, so no bucket is capped and nothing is lost; very large ones are first
divided by weight, which parts no two similar texts, so the classes are the same
whether a bucket is divided or not. Each comparison is the exact weighted Jaccard similarity of
the whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import key_filter, list_array, text_key, utf8, write_scratch
from tessera.llm.components import connected_components
from tessera.llm.words import KEPT, U, mix, multisets, shingles, weighted_jaccard, word_blocks

ROWS = 4
BANDS = 24
SHINGLE = 5
THRESHOLD = 0.8
#: Rows of a block: nodes outside the largest component, and members they are compared with.
OUTSIDE, INSIDE = 256, 1024
#: Open buckets with more members are divided by weight; the classes do not depend on it.
LARGE = 8192
_STEP = U(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(key: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Earliest times, texts x registers, of multisets given as words.multisets() makes them; infinite for texts without shingles."""
    owner, element = (key >> U(KEPT)).astype(np.int64), mix(key & U((1 << KEPT) - 1))
    # one stream for each dyadic interval that begins below the weight
    streams, rates, kept = [np.arange(len(key))], [np.ones(len(key))], [np.ones(len(key))]
    low = 1
    while (above := np.flatnonzero(count > low)).size:
        streams.append(above)
        rates.append(np.full(len(above), float(low)))
        kept.append(np.minimum(1.0, (count[above] - low) / low))
        low *= 2
    level = np.repeat(np.arange(len(streams)), [len(x) for x in streams])
    which, rate, kept = (np.concatenate(x) for x in (streams, rates, kept))
    owner, seed = owner[which], mix(element[which] + level.astype(U) * U(0xD1B54A32D192ED03))
    weight = np.bincount(owner, rate * kept, texts)
    until = np.divide(6.0 * registers, weight, out=np.zeros(texts), where=weight > 0)
    out = np.full(texts * registers, np.inf)
    past, index = np.zeros(len(seed)), np.zeros(len(seed), np.int64)
    active = np.arange(len(seed))
    while active.size:
        while active.size:
            ahead = int(min(64, max(1, 4096 // len(active))))
            places = index[active, None] + np.arange(1, ahead + 1)
            draw = mix(seed[active, None] + places.astype(U) * _STEP)
            times = past[active, None] - np.cumsum(np.log(_uniform(draw)), axis=1) / rate[active, None]
            inside = times <= until[owner[active], None]
            steps = inside.sum(axis=1)
            register = ((draw & U(0x7FF)) * U(registers) >> U(11)).astype(np.int64)
            counts = inside & (_uniform(mix(draw ^ _STEP)) < kept[active, None]) if level[-1] else inside
            flat = (owner[active, None] * registers + register)[counts]
            np.minimum.at(out, flat, times[counts])
            on = np.flatnonzero(steps)
            past[active[on]] = times[on, steps[on] - 1]
            index[active] += steps
            active = active[steps == ahead]
        empty = np.isinf(out.reshape(texts, registers)).any(axis=1) & (weight > 0)
        until[empty] *= 1.5
        active = np.flatnonzero(empty[owner])
    return out.reshape(texts, registers)


def sketch_udf(bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE):
    """Text to (weight, band keys); null keys for a text without words."""

    @F.arrow_udf(T.StructType([T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
    def sketch(text: pa.Array) -> pa.Array:
        data, offsets = utf8(text)
        weights, keys = np.zeros(len(text), np.int64), np.zeros((len(text), bands), np.int64)
        for i, j, hashes, ends, _ in word_blocks(data, offsets):
            value, owner = shingles(hashes, ends, k)
            key, count = multisets(value, owner)
            weights[i:j] = np.bincount(owner, minlength=j - i)
            times = signatures(key, count, j - i, bands * rows).view(U).reshape(j - i, bands, rows)
            band = np.full((j - i, bands), 1, U) * np.arange(1, bands + 1, dtype=U)
            for r in range(rows):
                band = mix(band * U(0x9FB21C651E98DF25) + times[:, :, r])
            keys[i:j] = band.view(np.int64)
        present = weights > 0
        return pa.StructArray.from_arrays([pa.array(weights), list_array(keys[present].ravel(), np.where(present, bands, 0), present)], ["weight", "bands"])

    return sketch


def similarity_udf(k: int = SHINGLE):
    """Exact weighted Jaccard similarity of two whole texts' k-word shingle multisets."""

    @F.arrow_udf(T.DoubleType())
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        (da, oa), (db, ob) = utf8(a), utf8(b)
        out = np.zeros(len(a))
        step = 256
        for i in range(0, len(a), step):
            j = min(i + step, len(a))
            bags = []
            for data, offsets in ((da, oa), (db, ob)):
                parts = [(v, o + p) for p, _, h, e, _ in word_blocks(data, offsets[i : j + 1]) for v, o in [shingles(h, e, k)]]
                bags.append(multisets(np.concatenate([v for v, _ in parts]), np.concatenate([o for _, o in parts])))
            out[i:j] = weighted_jaccard(*bags, j - i)
        return pa.array(out)

    return similarity


_BLOCK_LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _block_links(texts: pa.Array, outside: np.ndarray, component: np.ndarray, threshold: float, k: int) -> list[tuple[int, int]]:
    """Places (i, j) of one block: i outside the largest component, j in another component than i, similar enough."""
    data, offsets = utf8(texts)
    parts = [(v, o + i) for i, _, h, e, _ in word_blocks(data, offsets) for v, o in [shingles(h, e, k)]]
    key, count = multisets(np.concatenate([v for v, _ in parts]), np.concatenate([o for _, o in parts]))
    owner, element = (key >> U(KEPT)).astype(np.int64), key & U((1 << KEPT) - 1)
    n = len(texts)
    weight, begin = np.bincount(owner, count, n), np.searchsorted(owner, np.arange(n + 1))
    order = np.argsort(element, kind="stable")
    ranked, holder, times = element[order], owner[order], count[order]
    found = []
    for i in np.flatnonzero(outside):
        own = slice(begin[i], begin[i + 1])
        lo, hi = np.searchsorted(ranked, element[own]), np.searchsorted(ranked, element[own], "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(holder[at], np.minimum(times[at], np.repeat(count[own], size)), n)
        near = common >= (threshold - 1e-12) * (weight[i] + weight - common)
        found += [(int(i), int(j)) for j in np.flatnonzero(near & (component != component[i]))]
    return found


def _compare_blocks(threshold: float, k: int):
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("block").combine_chunks()
        blocks = table.column("block").to_numpy()
        cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        left, right = [], []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(blocks)), strict=True):
            part = table.slice(lo, hi - lo)
            names = part.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
            keys = part.column("key").to_pylist()
            links = _block_links(part.column("text").combine_chunks(), part.column("outside").to_numpy(zero_copy_only=False).astype(bool), names, threshold, k)
            left += [keys[i] for i, _ in links]
            right += [keys[j] for _, j in links]
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return compare


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, large: int = LARGE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least doc_id of its class), text_key.

    Classes are the components of "weighted Jaccard similarity of k-word shingle
    multisets is at least ``threshold``". Equal texts share a class. A null text, and a
    text without words that no other row equals, is alone (null texts: each row its own
    class_id; rows of blank equal texts share one). Repeated rows share a class; a null
    doc_id gets the least non-null doc_id of its class, if any. Texts of 1 to k-1 words
    have one shingle of all their words. Other columns are ignored. An empty table gives
    an empty result. Complete up to the banding's chance of a miss: 24 bands of 4
    registers miss a pair of similarity 0.8 with a probability of 3e-6.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = write_scratch(source.select("doc_id", text_key("text").alias("key"), sketch_udf(bands, rows, k)("text").alias("sketch")), "sketches")
    nodes = write_scratch(
        seen.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")).select("key", "least", "sketch.weight", "sketch.bands"), "nodes"
    )
    members = nodes.where("bands is not null").select("key", F.explode("bands").alias("bucket"))
    each = F.xxhash64("key")
    crowded = members.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(each).alias("x"), F.bit_xor(F.xxhash64(each)).alias("y")).where("size > 1")
    crowded = crowded.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket"), F.count("*").alias("bands")).select("bucket", "size", "bands")  # equal buckets once
    members = write_scratch(members.join(crowded, "bucket"), "buckets")
    central = write_scratch(members.groupBy("key").agg(F.sum(F.col("size") * F.col("bands")).alias("central")), "central")
    ranked = write_scratch(members.select("bucket", "key", "size").join(central, "key"), "members")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("central", "key"))["key"].alias("leader"))
    texts, _ = key_filter(central, "key")(source.select(text_key("text").alias("key"), "text"), F.col("key"))  # most texts share no bucket and stay where they are
    texts = texts.join(central.select("key"), "key", "left_semi").groupBy("key").agg(F.max("text").alias("text"))
    texts = write_scratch(texts, "texts")

    # stars: neither bag of words can hold the other's share if their sizes differ too much
    stars = ranked.select("bucket", "key").join(leaders, "bucket").where("key != leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    weigh = lambda x: nodes.select(F.col("key").alias(x), F.col("weight").alias(f"weight_{x}"))
    stars = stars.join(weigh("a"), "a").join(weigh("b"), "b").where(F.least("weight_a", "weight_b") >= threshold * F.greatest("weight_a", "weight_b") - 1e-9)
    left, right = (texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    scored = stars.select("a", "b").join(left, "a").join(right, "b").select("a", "b", similarity_udf(k)("text_a", "text_b").alias("similarity"))
    links = write_scratch(scored.where(F.col("similarity") >= threshold - 1e-12).select("a", "b"), "links")
    joined = connected_components(links)
    component = lambda df: df.join(joined.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))

    # buckets that still hold two components; of two members the one pair has been compared
    now = write_scratch(component(ranked.where("size > 2").select("bucket", "key", "size")), "open")
    now = write_scratch(_divided(now, nodes, large, threshold), "open") if not now.where(F.col("size") > large).isEmpty() else now
    shares = now.groupBy("bucket", "component").agg(F.count("*").alias("share"))
    apart = shares.groupBy("bucket").agg(F.sum("share").alias("all"), F.max(F.struct("share", "component")).alias("most")).where(F.col("all") > F.col("most.share"))
    apart = apart.select("bucket", F.col("most.component").alias("largest"), F.ceil(F.col("all") / INSIDE).alias("inner"), F.ceil((F.col("all") - F.col("most.share")) / OUTSIDE).alias("outer"))
    open_ = write_scratch(now.join(apart, "bucket").withColumn("outside", F.col("component") != F.col("largest")), "open")
    single = (F.col("inner") == 1) & (F.col("outer") == 1)
    cell = lambda i, j: F.xxhash64("bucket", i, j).alias("block")
    own = lambda parts: F.pmod(F.xxhash64("key", F.lit(5)), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)).alias("other")
    plain = open_.where(single).select(F.col("bucket").alias("block"), "key", "component", "outside")
    inside = open_.where(~single).select("*", every("outer")).select(cell(own("inner"), F.col("other")), "key", "component", F.lit(False).alias("outside"))
    outside = open_.where(~single & F.col("outside")).select("*", every("inner")).select(cell(F.col("other"), own("outer")), "key", "component", F.lit(True).alias("outside"))
    blocks = write_scratch(plain.unionByName(inside).unionByName(outside), "blocks")
    batches = max(1, -(-blocks.count() // (2 * INSIDE)))
    held = blocks.join(texts, "key").withColumn("batch", F.pmod(F.xxhash64("block"), F.lit(batches)))
    more = write_scratch(held.groupBy("batch").applyInArrow(_compare_blocks(threshold, k), _BLOCK_LINKS), "links")
    if not more.isEmpty():
        joined = connected_components(links.unionByName(more))

    classes = write_scratch(component(nodes.select("key", "least")), "classes")
    least = classes.groupBy("component").agg(F.min("least").alias("class_id"))
    of = classes.join(least, "component").select("key", "class_id")
    return seen.select("doc_id", "key").join(of, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("key").alias("text_key"))


def _divided(now: DataFrame, nodes: DataFrame, large: int, threshold: float) -> DataFrame:
    """Members of open buckets, those of large ones by weight.

    The weights of similar texts differ at most by the threshold's ratio. Classes of
    weight are as wide, and a member stands in its own class and the next, so two similar
    members always meet.
    """
    few, many = now.where(F.col("size") <= large), now.where(F.col("size") > large)
    width = -math.log(min(max(threshold - 1e-9, 1e-9), 1 - 1e-9)) * (1 + 1e-9)
    own = F.floor(F.log("weight") / width)
    finer = many.join(nodes.select("key", "weight"), "key").select("key", "component", "bucket", F.explode(F.array(own, own + 1)).alias("at"))
    return few.select("bucket", "key", "component").unionByName(finer.select(F.xxhash64("bucket", "at").alias("bucket"), "key", "component"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each near-duplicate class, with all columns of ``docs``.

    The row kept holds the text of a copy with the class's least doc_id. Rows with a null
    text are no copies of anything and all stay.
    """
    classes = write_scratch(near_duplicate_classes(docs, **options), "classes")
    # rows that are alone in their class stay where they are; only the others are dealt out by their text
    several = classes.groupBy("class_id").count().where("count > 1 or class_id is null")
    touched, _ = key_filter(write_scratch(several, "several"), "class_id")(classes, F.col("class_id"))
    part = key_filter(write_scratch(touched.select("text_key").distinct(), "touched"), "text_key")
    classes, _ = part(classes, F.col("text_key"))
    lead = classes.where(F.col("text_key").isNotNull()).groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("text_key")).alias("_alone")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("lead"))
    number = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    kept = lead.select(F.col("lead.text_key").alias("_key"), number("lead.doc_id").alias("_id"))
    key, row = "_key", "_id"
    while {key, row} & set(docs.columns):
        key, row = key + "_", row + "_"
    kept = kept.toDF(key, row)
    # the id in the join spreads copies of one text, and the same dealing serves the removal of repeated rows
    copies, alone = part(docs.where(docs["text"].isNotNull()), text_key("text"))
    rows = copies.withColumn(key, text_key("text")).withColumn(row, number("doc_id").cast("long"))
    leads = rows.join(kept, [key, row], "left_semi").dropDuplicates([key, row])
    return leads.select(docs.columns).unionByName(alone.select(docs.columns)).unionByName(docs.where(docs["text"].isNull()))
