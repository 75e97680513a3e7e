"""Queries over dates as notes write them: expressions answered by hand, and headings among the sentences of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clinical_dates as cd
from tessera.plans.registry import query, read

#: What is written, and its start, end, precision and source by hand; {day}, {year} are the report's, durations are SQL over the report's day.
WRITTEN = [
    ("il 6/5/2023", "'2023-05-06'", "NULL", "day", "explicit_or_retroactive"),
    ("circa il 06.05.23", "'2023-05-06'", "NULL", "approximate", "explicit_or_retroactive"),
    ("maggio 2023", "'2023-05'", "NULL", "month", "explicit_or_retroactive"),
    ("nel 2019", "'2019'", "NULL", "year", "explicit_or_retroactive"),
    ("dal 3 al 7 maggio 2022", "'2022-05-03'", "'2022-05-07'", "interval", "explicit_or_retroactive"),
    ("dal 3 al 7 maggio", "year || '-05-03'", "year || '-05-07'", "interval", "explicit_or_retroactive"),
    ("il 12 marzo", "year || '-03-12'", "NULL", "day", "explicit_or_retroactive"),
    ("tra 2019 e 2021", "'2019'", "'2021'", "interval", "explicit_or_retroactive"),
    ("dolore da circa tre settimane", "CAST(day - INTERVAL 21 DAY AS DATE)::VARCHAR", "NULL", "approximate", "retrospective_duration"),
    ("da un mese", "CAST(day - INTERVAL 1 MONTH AS DATE)::VARCHAR", "NULL", "approximate", "retrospective_duration"),
    ("da 2 anni", "CAST(day - INTERVAL 2 YEAR AS DATE)::VARCHAR", "NULL", "approximate", "retrospective_duration"),
    ("mai", "NULL", "NULL", "unknown", "unknown"),
]


def _case(k: int) -> str:
    return "CASE w " + " ".join(f"WHEN {i} THEN {row[k] if k < 3 else chr(39) + row[k] + chr(39)}" for i, row in enumerate(WRITTEN)) + " END"


@query(f"""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, CAST(year(ts) AS VARCHAR) AS year, event_id % {len(WRITTEN)} AS w FROM events)
  SELECT event_id, {_case(1)} AS start_date, {_case(2)} AS end_date, {_case(3)} AS precision, {_case(4)} AS source FROM e""")
def clinical_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.get(F.array(*[F.lit(row[0]) for row in WRITTEN]), (F.col("event_id") % len(WRITTEN)).cast("int"))
    df = read(spark, sf_dir, "events", "event_id", "ts").select("event_id", cd.normalized(written, F.date_format("ts", "yyyy-MM-dd")).alias("d"))
    return df.select("event_id", F.col("d.start").alias("start_date"), F.col("d.end").alias("end_date"), "d.precision", "d.source")


#: Sentences put between a document's own, by place.
INSERTED = {3: "12/03/2024 - Visita", 8: "In tale data ricovero", 11: "il 1/1/2020 fu operato di ernia e poi dimesso in buone condizioni generali", 15: "In data 3 aprile"}


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+ ')) AS s, generate_subscripts(string_split_regex(text, '[.!?]+ '), 1) - 1 AS p FROM documents),
  k AS (SELECT doc_id, p, (doc_id + p) % 17 AS k FROM s),
  d AS (SELECT *, CASE k WHEN 3 THEN '12/03/2024' WHEN 11 THEN '1/1/2020' WHEN 15 THEN '3 aprile' END AS written, k IN (3, 15) AS heading, k = 8 AS back FROM k),
  g AS (SELECT *, last_value(CASE WHEN heading THEN p END IGNORE NULLS) OVER w AS h, last_value(CASE WHEN written IS NOT NULL THEN p END IGNORE NULLS) OVER w AS a FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, CASE WHEN back THEN a ELSE h END AS at FROM g)
  SELECT f.doc_id, CAST(f.p AS INT) AS sentence_no, d.written AS governing_date, CAST(f.at AS INT) AS governing_no FROM f JOIN d ON d.doc_id = f.doc_id AND d.p = f.at""")
def governing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "[.!?]+ ")).alias("sentence_no", "sentence"))
    at, said = (F.col("doc_id") + F.col("sentence_no")) % 17, F.lit("a sentence")
    for k, text in INSERTED.items():
        said = F.when(at == k, text).otherwise(said)
    out = cd.with_governing_date(rows.withColumn("sentence", said), "doc_id", "sentence_no", "sentence")
    return out.where("governing_date is not null").select("doc_id", "sentence_no", "governing_date", F.col("governing_number").alias("governing_no"))
