"""Reports over registry rows: workbook rows, cited ids, retrieval of events, systems by terms, number checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def cited_id(value: Column) -> Column:
    """An id without blanks around it and number signs before it."""
    return F.ltrim(F.trim(value), F.lit("#"))


def workbook_rows(reports: DataFrame, findings: DataFrame, patient: str) -> DataFrame:
    """One row for each finding (patient, organs, organ, cited, ...) with its report's columns.

    The organ shown is the list of organs, else the single one; cited ids become one text.
    """
    several = F.array_join("organs", ", ")
    shown = F.when(F.coalesce(several, F.lit("")) != "", several).otherwise(F.coalesce("organ", F.lit("")))
    cited = F.array_join(F.transform(F.coalesce("cited", F.array().cast("array<string>")), cited_id), ", ")
    return findings.join(reports, patient).withColumns({"organ": shown, "cited": cited}).drop("organs")


def workbook_skipped(reports: DataFrame, findings: DataFrame, patient: str) -> DataFrame:
    """Patients of reports without a finding."""
    return reports.join(findings, patient, "left_anti").select(patient).distinct()


def cited_ids(own: Column, notes: Column, of_organs: Column, pattern: str) -> Column:
    """The ids a finding cites, each once: its own list, else those in its notes, else those of its organs' findings."""
    clean = lambda ids: F.array_distinct(F.filter(F.transform(ids, cited_id), lambda x: x != ""))
    filled = lambda ids: F.when(F.size(ids) > 0, clean(ids))
    return F.coalesce(filled(own), filled(F.regexp_extract_all(notes, F.lit(pattern), F.lit(0))), clean(of_organs))


def with_cited_ids(entries: DataFrame, findings: DataFrame, key: str, pattern: str) -> DataFrame:
    """Entries (key, organs, cited, notes) with the ids of findings (organ, cited) where they name none themselves.

    Only entries without ids of their own meet the findings, whose ids are gathered once an organ.
    """
    by_organ = findings.select("organ", F.explode("cited").alias("_id")).groupBy("organ").agg(F.array_sort(F.collect_set("_id")).alias("_ids"))
    bare = entries.where((F.coalesce(F.size("cited"), F.lit(0)) <= 0) & (F.size(F.regexp_extract_all(F.coalesce("notes", F.lit("")), F.lit(pattern), F.lit(0))) == 0))
    each = bare.select(key, F.explode("organs").alias("organ")).distinct().join(by_organ, "organ").groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("_of_organs"))
    none = F.array().cast("array<string>")
    ids = cited_ids(F.coalesce("cited", none), F.coalesce("notes", F.lit("")), F.coalesce("_of_organs", none), pattern)
    return entries.join(each, key, "left").withColumn("cited", ids).drop("_of_organs")


def retrieved(events: DataFrame, evidence: DataFrame, subject: str, key: str, day: str, chosen: Column, in_intent: Column, hits: Column, active: Column, administrative: Column, most: int) -> DataFrame:
    """A subject's best ``most`` chosen events in order of their day, without those whose evidence is all administrative.

    Rank: intent, term hits, activity, latest day. An event without evidence stays; an
    unknown day comes last.
    """
    ranked = events.where(chosen).withColumn("_n", F.row_number().over(Window.partitionBy(subject).orderBy(in_intent.cast("int").desc(), hits.desc(), active.cast("int").desc(), F.col(day).desc_nulls_last(), F.col(key).desc())))
    best = ranked.where(F.col("_n") <= most).drop("_n")
    only = evidence.groupBy(key).agg(F.bool_and(administrative).alias("_all")).where("_all").select(key)
    order = Window.partitionBy(subject).orderBy(F.col(day).asc_nulls_last(), key)
    return best.join(only, key, "left_anti").withColumn("place", F.row_number().over(order))


def system_of(text: Column, systems: dict[str, list[str]]) -> Column:
    """The system with most of its terms in the text, the first of equal ones; null without a term."""
    hits = {name: reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms]) for name, terms in systems.items()}
    best = F.greatest(*[F.struct(n.alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, n) in enumerate(hits.items())])
    return F.when(best["n"] > 0, best["name"])


def introduced_numbers(sources: DataFrame, outputs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, more): numbers that an output holds more often than its source."""
    each = lambda df, sign: df.select(key, F.explode(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))).alias("number"), F.lit(sign).alias("_s"))
    return each(outputs, 1).unionByName(each(sources, -1)).groupBy(key, "number").agg(F.sum("_s").alias("more")).where("more > 0")


def observed_date(text: Column, fallback: Column) -> Column:
    """ISO text of a day or month written year-month-day, year-month or day, month, year; else the fallback, else empty."""
    t = F.trim(text)
    iso, european = r"^([0-9]{4})-([0-9]{1,2})(?:-([0-9]{1,2}))?$", r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{4})$"
    part = lambda pattern, i: F.regexp_extract(t, pattern, i).try_cast("int")

    def form(year: Column, month: Column, day: Column) -> Column:
        first = F.when((year >= 1) & month.between(1, 12), F.make_date(year, month, F.lit(1)))
        return F.when(day.isNull(), F.date_format(first, "yyyy-MM")).when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_format(F.date_add(first, day - 1), "yyyy-MM-dd"))

    ways = F.when(F.rlike(t, F.lit(iso)), form(part(iso, 1), part(iso, 2), part(iso, 3))).when(F.rlike(t, F.lit(european)), form(part(european, 3), part(european, 2), part(european, 1)))
    return F.coalesce(ways, fallback, F.lit(""))
