"""Record linkage: keyed identity matching with conflicts, and grouping of evidence by shared fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import components


def keyed(field: str, value: Column, key: str) -> Column:
    """A digest of a field's value under a key (HMAC-like: key, digest of key and field and value); null for null."""
    inner = F.sha2(F.concat_ws("\x00", F.lit(key), F.lit(field), value), 256)
    return F.when(value.isNotNull(), F.sha2(F.concat_ws("\x00", F.lit(key), inner), 256))


def match(evidence: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Per evidence row: subject_id, reason, confidence, conflict.

    Both sides have code, hospital_id, name, birth (digests or null); ``registry`` also
    subject_id. A code decides before a hospital id before name with birth; two keys that
    point at different subjects, or a key that belongs to several, are a conflict.
    """

    def by(columns: list[str], name: str) -> DataFrame:
        held = registry.where(" and ".join(f"{c} is not null" for c in columns))
        return held.groupBy(*columns).agg(F.min("subject_id").alias(name), (F.count_distinct("subject_id") > 1).alias(f"{name}_many"))

    out = evidence
    for columns, name in ((["code"], "_code"), (["hospital_id"], "_hospital"), (["name", "birth"], "_pair")):
        out = out.join(by(columns, name), columns, "left")
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    many = F.coalesce("_code_many", F.lit(False)) | F.coalesce("_hospital_many", F.lit(False))
    conflict = many | differ("_code", "_pair") | differ("_hospital", "_pair") | differ("_code", "_hospital")
    subject = F.coalesce("_code", "_hospital", "_pair")
    reason = F.when(F.col("_code").isNotNull(), "code").when(F.col("_hospital").isNotNull(), "hospital_id").when(F.col("_pair").isNotNull(), "name_and_birth")
    confidence = F.when(reason == "code", 0.99).when(reason == "hospital_id", 0.98).when(reason == "name_and_birth", 0.96)
    return out.select(key, F.when(~conflict, subject).alias("subject_id"), F.when(~conflict, reason).alias("reason"), F.when(~conflict, confidence).alias("confidence"), conflict.alias("conflict"))


def subset_names(evidence: DataFrame, key: str, birth: str, name: str) -> DataFrame:
    """Edges (a, b) between rows of one birth date where all words of one name are among the other's.

    Equal names are first reduced to their least key. A name is then looked up only under
    its rarest word (of its birth date), which any name that holds all its words must
    hold too, so names are never compared in all pairs. Case and order of the words do not
    count; null or empty names and null dates match nothing.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.col(name)), r"(?U)\s+"), lambda w: w != "")))
    rows = evidence.select(F.col(key).alias("k"), F.col(birth).alias("birth"), words.alias("words")).where("birth is not null and size(words) > 0")
    least = rows.groupBy("birth", "words").agg(F.min("k").alias("a"))
    same = rows.join(least, ["birth", "words"]).where("a != k").select("a", F.col("k").alias("b"))
    each = least.select("birth", "a", "words", F.explode("words").alias("word"))
    often = each.groupBy("birth", "word").agg(F.count("*").alias("n"))
    rarest = each.join(often, ["birth", "word"]).groupBy("birth", "a", "words").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    held = each.select("birth", "word", F.col("a").alias("b"), F.col("words").alias("more"))
    inside = rarest.join(held, ["birth", "word"]).where((F.size("words") < F.size("more")) & (F.size(F.array_except("words", "more")) == 0))
    return same.unionByName(inside.select("a", "b"))


def groups(evidence: DataFrame, key: str, fingerprints: list[str], also: DataFrame | None = None) -> DataFrame:
    """(key, group): rows that share a fingerprint, or that an edge (a, b) of ``also`` links, over any number of steps; the group is its least key.

    Rows link to the least key that has the same fingerprint, not to each other, so a
    fingerprint that many rows share costs one edge a row.
    """
    edges = also
    for column in fingerprints:
        held = evidence.where(F.col(column).isNotNull()).select(F.col(key).alias("b"), F.col(column).alias("_f"))
        part = held.join(held.groupBy("_f").agg(F.min("b").alias("a")), "_f").where("a != b").select("a", "b")
        edges = part if edges is None else edges.unionByName(part)
    found = components(edges, evidence.select(F.col(key).alias("node")))
    return found.select(F.col("node").alias(key), F.col("component").alias("group"))


def group_conflicts(evidence: DataFrame, of: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of which a group holds more than one value."""
    each = evidence.join(of, key).groupBy("group").agg(*[F.count_distinct(f).alias(f) for f in fields], F.count("*").alias("members"))
    said = F.filter(F.array(*[F.when(F.col(f) > 1, f) for f in fields]), lambda x: x.isNotNull())
    return each.select("group", "members", said.alias("conflicts"))


def birth_of_code(code: Column, this_year: int) -> Column:
    """Birth date of a fiscal code; two-digit years above this year's belong to the last century."""
    months = F.create_map(*[x for i, c in enumerate("ABCDEHLMPRST", 1) for x in (F.lit(c), F.lit(i))])
    part = lambda at, n: F.substring(code, at, n).try_cast("int")
    year, day = part(7, 2), part(10, 2)
    full = F.when(year > this_year % 100, year + 1900).otherwise(year + 2000)
    stamp = F.format_string("%04d-%02d-%02d", full, F.try_element_at(months, F.upper(F.substring(code, 9, 1))), F.when(day > 40, day - 40).otherwise(day))
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd")).cast("date")


def sex_of_code(code: Column) -> Column:
    return F.when(F.substring(code, 10, 2).try_cast("int") > 40, "F").when(F.substring(code, 10, 2).try_cast("int").isNotNull(), "M")
