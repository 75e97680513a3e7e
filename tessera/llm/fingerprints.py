"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the K smallest distinct 64-bit hashes of a text's runs of
five words (a text of one to four words has one shingle of all its words; one without
words has an empty sketch). Words are maximal runs of characters other than space and
tab to carriage return. The K smallest of a union are among the K smallest of its parts,
so sketches of parts merge into the sketch of the whole; resemblance, containment and
the number of distinct shingles follow from sketches alone. Below K shingles all three
are exact.

fingerprint_digest() compares each document with an edited text that borrows from the
next document. The order of ids is found on ids alone, range-partitioned; then texts are
dealt by doc_id once, and each document hands the needed beginning of its text and its
sketch to the one before it. No text stays in the driver and no task sees more than its
share of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import write_scratch

#: Hashes in a sketch: the standard error of a resemblance of one half is 0.044.
K = 128
SHINGLE = 5
SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """One 64-bit hash for each run of ``size`` words, in order."""

    def runs(hashes: Column) -> Column:
        first = F.slice(hashes, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(1)))
        return F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, size)]))

    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), runs)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The k smallest distinct shingle hashes of a text, ascending; empty for a null text or one without words."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, size))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together, from the parts' sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(rows: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """keys, sketch: the sketch of all rows of each key together; a key whose rows have no shingles gets an empty one.

    Hashes are made distinct before they are ranked and only k of a key leave a task, so
    a key that holds most rows is no burden. Null keys are keys; null sketches are empty.
    """
    each = rows.select(*keys, F.explode_outer(sketch_col).alias("_hash")).distinct()
    ranked = each.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last()))).where(F.col("_rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets (0 to 1); 1 for equal sketches, also for two empty ones."""
    both = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when(a == b, F.lit(1.0)).otherwise(both / F.greatest(F.size(merged(a, b, k)), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of all hashes up to the k-th."""
    share = (F.get(a, F.lit(k - 1)).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: resemblance times the union's size over a's; 1 if a has none.

    The union's size comes from the merged sketch, so with both below k it is exact.
    """
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")))


def _followers(docs: DataFrame) -> DataFrame:
    """doc_id, picked, before, needed: each distinct id, which of its texts counts, the next greater id, and how much of the text that one needs.

    The greatest id follows the least. Ids are put in order by range partitions; inside
    one they are numbered, and the few partitions' ends are joined.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"), F.min(F.xxhash64("text")).alias("picked"))
    ranged = ids.repartitionByRange(F.col("doc_id").desc()).withColumn("part", F.spark_partition_id())
    ranged = write_scratch(ranged, "ids")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").desc())
    linked = ranged.select("part", "doc_id", "picked", F.lag("doc_id").over(inside).alias("before"), F.lag("n").over(inside).alias("n"))
    ends = ranged.groupBy("part").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("last"))
    order = Window.orderBy("part")  # as many rows as partitions
    ends = ends.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("last"))
    joined = linked.join(ends, "part")
    first = F.col("before").isNull()
    return joined.select("doc_id", "picked", F.when(first, F.col("last.doc_id")).otherwise(F.col("before")).alias("before"), F.floor(F.when(first, F.col("last.n")).otherwise(F.col("n")) / 3).cast("int").alias("needed"))


def fingerprint_digest(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles: one row for each row of ``docs``.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document, by descending doc_id; the first follows the last,
    so a lone document follows itself. Rows that share a doc_id are each edited with the
    next id's text; of several rows with that id the text of least hash counts. A row without doc_id
    has no next document: nothing takes the place of its end, and near_next is null. Null
    texts are empty; likeness of two texts without words is 1. n_shingles estimates the
    distinct shingles. Other columns are ignored; an empty table gives an empty result.
    A text and its words must fit one row.
    """
    # doc_id as it is: renamed, the two readings below would be two plans and the texts would be dealt twice
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.where("doc_id is not null")
    # not an equality, which would make the text's hash a key of the join and deal the texts a second time
    counts = F.xxhash64("text").bitwiseXOR(F.col("picked")) == 0
    handed = dealt.join(_followers(texts), "doc_id").where(counts).select(F.col("before").alias("doc_id"), "picked", F.expr("substring(text, 1, needed)").alias("beginning"), sketch(F.col("text"), k).alias("next_sketch"))
    once = Window.partitionBy("doc_id").orderBy("picked")  # repeated rows hand on the same
    rows = dealt.join(handed.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n", "picked"), "doc_id")
    alone = texts.where("doc_id is null").withColumns({"beginning": F.lit(""), "next_sketch": F.lit(None).cast("array<bigint>")})
    n = F.char_length("text")
    rows = rows.unionByName(alone).select("doc_id", "text", n.cast("long").alias("n_chars"), sketch(F.col("text"), k).alias("own"), "next_sketch", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.substring("beginning", F.lit(1), F.floor(n / 3).cast("int"))).alias("edited"))
    rows = rows.withColumn("theirs", sketch(F.col("edited"), k))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("theirs")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("theirs"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"), distinct_shingles(F.col("own"), k).alias("n_shingles"),
    )
