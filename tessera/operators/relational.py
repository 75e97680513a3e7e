"""Merges, overlays, manifests and other whole-table operations, each one join or one grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, excluded: dict[str, list] | None = None, **wanted) -> DataFrame:
    """Equality filters for the arguments that are given; ``excluded`` values are left out (nulls stay)."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, values in (excluded or {}).items():
        df = df.where(F.col(name).isNull() | ~F.col(name).isin(values))
    return df


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: list[str] | None = None, greatest: list[str] | None = None, guard: str | None = None) -> DataFrame:
    """Merge rows by key: the new row wins.

    Columns in ``keep_if_null`` keep the old value where the new one is null; those in
    ``greatest`` take the larger value; rows of ``old`` for which the boolean column
    ``guard`` is true stay as they are. Keys must be unique on either side.
    """
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, keys, "full")
    taken = F.coalesce(F.col("b._new"), F.lit(False))
    if guard:
        taken = taken & ~F.coalesce(F.col(f"a.{guard}"), F.lit(False))
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in (greatest or []):
            out.append(F.when(taken, F.greatest(f"a.{c}", f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        elif c in (keep_if_null or []):
            out.append(F.when(taken, F.coalesce(f"b.{c}", f"a.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            out.append(F.when(taken, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return joined.select(out)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(keys), keys, "left_anti"))


def replace_generated(old: DataFrame, new: DataFrame, keys: list[str], is_human: Column) -> DataFrame:
    """Old rows touched by a person stay; all others give way to the newly generated rows."""
    kept = old.where(is_human)
    return kept.unionByName(new.join(kept.select(keys), keys, "left_anti"))


def tagged_union(parts: dict[str, DataFrame], tag: str = "record_type") -> DataFrame:
    """All rows of all parts under the union of their columns, each with its part's name."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def stratified_top(df: DataFrame, stratum: str, order: list, most: int) -> DataFrame:
    """One row of each stratum, then the best others, ``most`` in all; strata beyond that go by order."""
    ranked = df.withColumn("_in", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    few = ranked.where(F.col("_in") <= most).withColumn("_lead", F.col("_in") > 1)
    return few.orderBy("_lead", *order).limit(most).drop("_in", "_lead")


def pending(items: DataFrame, manifest: DataFrame, key: list[str], versions: list[str]) -> DataFrame:
    """Items without a completed manifest row under the same key and one of the versions accepted."""
    done = manifest.where((F.col("status") == "completed") & F.col("version").isin(versions)).select(*key)
    return items.join(done, key, "left_anti")


def interrupted(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Runs that are still marked running after so long become interrupted."""
    stale = (F.col("status") == "running") & (F.col("started") < now - F.make_interval(mins=F.lit(minutes)))
    return runs.withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status")))


def active_overlay(base: DataFrame, overlays: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Base rows with the text of their highest active overlay version, if any."""
    best = overlays.where("active").groupBy(key).agg(F.max_by(text, "version").alias("_text"), F.max("version").alias("overlay_version"))
    return base.join(best, key, "left").withColumn(text, F.coalesce("_text", text)).drop("_text")


def bounded_pairs(df: DataFrame, keys: list[str], order: list[str], item: str, k: int, extra: list[str] | None = None) -> DataFrame:
    """Each row with each of its k predecessors inside the keys: columns with suffixes _a (later) and _b.

    Positions are dealt into runs of k; a row meets its own run and the one before it, so
    the equality join never sees more than 2k rows a row and a hot key spreads over runs.
    """
    cols = [item, *(extra or [])]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.select(*keys, *cols, place.alias("_n"))
    a = rows.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols], F.col("_n").alias("_na"), F.explode(F.array(F.floor(F.col("_n") / k), F.floor(F.col("_n") / k) - 1)).alias("_run"))
    b = rows.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols], F.col("_n").alias("_nb"), F.floor(F.col("_n") / k).alias("_run"))
    return a.join(b, [*keys, "_run"]).where((F.col("_na") > F.col("_nb")) & (F.col("_na") - F.col("_nb") <= k)).drop("_run", "_na", "_nb")
