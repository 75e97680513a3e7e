"""Ordered series of one subject and parameter: previous values, deltas, directions, phases, trends, bands.

Every operator takes ``keys`` (the series) and ``order`` (a total order inside it) and
works with windows partitioned by the keys, so a plan needs one shuffle on the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import offset_band
from tessera.functions.numbers import relative_change


def with_previous(df: DataFrame, keys: list[str], order: list, value: str, day: str) -> DataFrame:
    """Add previous_value and previous_day: of the last earlier row with a value (as-of join to oneself)."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(day).alias("d"))), ignorenulls=True).over(before)
    return df.withColumn("_last", last).withColumns({"previous_value": F.col("_last.v"), "previous_day": F.col("_last.d")}).drop("_last")


def significant_delta(value: Column, previous: Column, day: Column, previous_day: Column, window_days: int, threshold: float) -> Column:
    """True if the relative change within the window reaches the threshold; from zero any other value counts."""
    near = F.abs(F.datediff(day, previous_day)) <= max(1, window_days)
    return F.coalesce(near & (relative_change(previous, value) >= max(0.0, threshold)) & ~((previous == 0) & (value == 0)), F.lit(False))


def abnormality_reasons(value: Column, low: Column, high: Column, flag: Column, textual: Column, delta: Column) -> Column:
    """The reasons that hold, in fixed order: explicit flag, outside range, textual, significant delta."""
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    reasons = [("explicit_abnormal_flag", flag), ("outside_reference_range", outside), ("textual_abnormality", textual), ("significant_delta_within_range", delta)]
    return F.filter(F.array(*[F.when(test, name) for name, test in reasons]), lambda x: x.isNotNull())


def direction(first: Column, last: Column, count: Column, tolerance: float = 0.05) -> Column:
    """'increasing', 'decreasing' or 'stable' by the change relative to the first value; one point is not assessable."""
    change = (last - first) / F.greatest(F.abs(first), F.lit(1e-9))
    return F.when(count < 2, "not_assessable").when(change > tolerance, "increasing").when(change < -tolerance, "decreasing").otherwise("stable")


def series_summary(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per series: baseline, last, lowest, highest, count, absolute and percent change, direction."""
    at = F.struct(*order)
    held = df.where(F.col(value).isNotNull())
    out = held.groupBy(*keys).agg(
        F.min_by(value, at).alias("baseline"), F.max_by(value, at).alias("latest"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count("*").alias("points")
    )
    change = F.col("latest") - F.col("baseline")
    percent = F.when(F.col("baseline") != 0, 100 * change / F.abs("baseline"))
    return out.withColumns({"absolute_change": change, "percent_change": percent, "direction": direction(F.col("baseline"), F.col("latest"), F.col("points"))})


def trends(df: DataFrame, keys: list[str], order: list[str], value: str, day: str, abnormal: str) -> DataFrame:
    """Series with two abnormal values or a resolved one: dates, direction, resolution, counts.

    A series is resolved when its last value is normal and no abnormal value is later.
    """
    at = F.struct(*order)
    bad = F.col(abnormal)
    out = df.groupBy(*keys).agg(
        F.count("*").alias("value_count"),
        F.count_if(bad).alias("abnormal_count"),
        F.min(F.when(bad, F.col(day))).alias("start_date"),
        F.max_by(day, at).alias("end_date"),
        F.max_by(~bad, at).alias("resolved"),
        F.min_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), at)).alias("_first"),
        F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), at)).alias("_last"),
        F.count(value).alias("_points"),
    )
    kept = out.where((F.col("abnormal_count") >= 2) | ((F.col("abnormal_count") == 1) & F.col("resolved")))
    return kept.withColumn("direction", direction(F.col("_first"), F.col("_last"), F.col("_points"))).drop("_first", "_last", "_points")


def phases(df: DataFrame, keys: list[str], order: list[str], value: str, abnormal: str, hysteresis: float = 0.15) -> DataFrame:
    """Rows (keys, phase_index, direction, start_point, end_point, start_value, end_value), points from 1.

    An edge below the hysteresis continues the phase it is in; a turn ends a phase at its
    point, which also begins the next. A return to normal after the last abnormal value
    cuts the phases there and adds a 'normalized' phase from that value to the end.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    points = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_left", F.lag(value).over(w))
    edge = F.abs(F.col(value) - F.col("_left")) / F.greatest(F.abs(value), F.abs("_left"), F.lit(1e-9))
    turn = F.when(edge >= hysteresis, F.when(F.col(value) > F.col("_left"), "increasing").otherwise("decreasing"))
    points = points.withColumn("_turn", turn).withColumn("_was", F.last("_turn", ignorenulls=True).over(before))
    points = points.withColumn("_phase", F.sum(F.when(F.col("_turn") != F.col("_was"), 1).otherwise(0)).over(w))
    points = points.withColumns({"_n": F.count("*").over(whole), "_bad": F.max(F.when(F.col(abnormal), F.col("_i"))).over(whole)})
    edges = points.where("_left is not null").groupBy(*keys, "_phase").agg(
        F.min(F.col("_i") - 1).alias("start_point"), F.max("_i").alias("end_point"), F.coalesce(F.max("_turn"), F.lit("stable")).alias("direction"), F.first("_n").alias("_n"), F.first("_bad").alias("_bad")
    )
    normal = F.col("_bad").isNotNull() & (F.col("_bad") < F.col("_n"))
    trimmed = edges.where(~F.coalesce(normal, F.lit(False)) | (F.col("start_point") <= F.col("_bad")))
    trimmed = trimmed.withColumn("end_point", F.when(normal, F.least("end_point", "_bad")).otherwise(F.col("end_point")))
    back = edges.where(normal).groupBy(*keys).agg(F.first("_bad").alias("start_point"), F.first("_n").alias("end_point")).withColumn("direction", F.lit("normalized"))
    spans = trimmed.select(*keys, "start_point", "end_point", "direction").unionByName(back)
    spans = spans.withColumn("phase_index", F.row_number().over(Window.partitionBy(*keys).orderBy("start_point", "end_point", F.col("direction") == "normalized")))
    at = lambda name: points.select(*keys, F.col("_i").alias(f"{name}_point"), F.col(value).alias(f"{name}_value"))
    return spans.join(at("start"), [*keys, "start_point"]).join(at("end"), [*keys, "end_point"]).select(*keys, "phase_index", "direction", "start_point", "end_point", "start_value", "end_value")


def anchor_offsets(df: DataFrame, subject: str, day: str, is_anchor: Column) -> DataFrame:
    """Add anchor_day (the subject's first anchor), offset_days and band; subjects without anchor are undated."""
    anchor = F.min(F.when(is_anchor, F.col(day))).over(Window.partitionBy(subject))
    dated = df.withColumn("anchor_day", anchor).withColumn("offset_days", F.datediff(day, "anchor_day"))
    return dated.withColumn("band", offset_band(F.col("offset_days")))


def recurrence_index(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("recurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
