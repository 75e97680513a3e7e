"""Dates of notes, answered by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import clinical_dates as c

REPORT = "2024-03-31"
ANSWERS = [
    # value, end, stated: start, end, precision, source, approximate
    ("2023-05-06", None, None, ("2023-05-06", None, "day", "explicit_or_retroactive", False)),
    ("il 6/5/2023", None, None, ("2023-05-06", None, "day", "explicit_or_retroactive", False)),
    ("circa il 06.05.23", None, None, ("2023-05-06", None, "approximate", "explicit_or_retroactive", True)),
    ("2023-5", None, None, ("2023-05", None, "month", "explicit_or_retroactive", False)),
    ("maggio 2023", None, None, ("2023-05", None, "month", "explicit_or_retroactive", False)),
    ("nel 2019", None, None, ("2019", None, "year", "explicit_or_retroactive", False)),
    ("dal 3 al 7 maggio 2022", None, None, ("2022-05-03", "2022-05-07", "interval", "explicit_or_retroactive", False)),
    ("dal 3 al 7 maggio", None, None, ("2024-05-03", "2024-05-07", "interval", "explicit_or_retroactive", False)),
    ("il 12 marzo", None, None, ("2024-03-12", None, "day", "explicit_or_retroactive", False)),
    ("12 marzo", "al 20 marzo", None, ("2024-03-12", "2024-03-20", "interval", "explicit_or_retroactive", False)),
    ("2023-01-02", "2023-02-03", None, ("2023-01-02", "2023-02-03", "interval", "explicit_or_retroactive", False)),
    ("tra 2019 e 2021", None, None, ("2019", "2021", "interval", "explicit_or_retroactive", False)),
    ("da circa tre settimane", None, None, ("2024-03-10", None, "approximate", "retrospective_duration", True)),
    ("da un mese", None, None, ("2024-02-29", None, "approximate", "retrospective_duration", True)),
    ("dolore da 2 anni", None, None, ("2022-03-31", None, "approximate", "retrospective_duration", True)),
    ("2023", None, "approximate", ("2023", None, "approximate", "explicit_or_retroactive", False)),
    ("da anni", None, None, (None, None, "unknown", "unknown", True)),
    ("2023-02-30", None, None, (None, None, "unknown", "unknown", False)),
    ("", None, None, (None, None, "unknown", "unknown", False)),
    (None, None, None, (None, None, "unknown", "unknown", False)),
]


def test_normalized(spark):
    df = spark.createDataFrame([(i, v, e, s) for i, (v, e, s, _) in enumerate(ANSWERS)], "i int, v string, e string, s string")
    got = [tuple(r[1]) for r in df.select("i", c.normalized(F.col("v"), F.lit(REPORT), F.col("e"), F.col("s"))).orderBy("i").collect()]
    assert got == [a for *_, a in ANSWERS]


def test_without_a_report(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["12 marzo", "da tre giorni", "dal 3 al 7 maggio"])], "i int, v string")
    assert {r[0]["start"] for r in df.select(c.normalized(F.col("v"), F.lit(None).cast("string"))).collect()} == {None}
    assert spark.range(1).select(c.counted_back(F.lit("da tre giorni"), F.lit("2024-03"))).first()[0] is None


@pytest.mark.parametrize(("quote", "category", "said"), [("Dolore da due giorni, visto il 3/4/2024", "symptom", "da due giorni"), ("ricovero dal 3 al 7 maggio 2022", "hospitalization", "dal 3 al 7 maggio 2022"), ("TC del 12/03/2024", "imaging_finding", "12/03/2024"), ("ultima somministrazione il 1/2/2024", "symptom", None), ("ultima somministrazione il 1/2/2024", "medication", "1/2/2024"), ("marzo 2021", None, "marzo 2021"), (None, None, None)])
def test_chosen_expression(spark, quote, category, said):
    assert spark.range(1).select(c.chosen_expression(F.lit(quote).cast("string"), F.lit(category).cast("string"))).first()[0] == said


@pytest.mark.parametrize(("expression", "quote", "governing", "day"), [("da tre giorni", "da tre giorni", "12/03/2024", "2024-03-12"), ("da tre giorni", "il 1/3/2024 dolore da tre giorni", "12/03/2024", "2024-03-01"), ("da tre giorni", "da tre giorni", "marzo 2024", REPORT), ("2023", "2023", "12/03/2024", REPORT), ("da un mese", None, None, REPORT)])
def test_duration_anchor(spark, expression, quote, governing, day):
    text = lambda x: F.lit(x).cast("string")
    assert spark.range(1).select(c.duration_anchor(text(expression), text(quote), text(governing), F.lit(REPORT))).first()[0] == day


def test_governing_dates_are_near_headings(spark):
    rows = ["12/03/2024 - Visita", "dolore", "il paziente riferisce che il 1/1/2020 fu operato di ernia inguinale", "in tale data ebbe febbre", "a", "b", "c", "d", None, "In data 3 aprile:", "stabile"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows, 1)] + [(2, 1, "altro")], "d int, n int, s string")
    got = {(r.d, r.n): (r.governing_date, r.governing_number) for r in c.with_governing_date(df, "d", "n", "s").collect()}
    assert got == {
        (1, 1): (None, None), (1, 2): ("12/03/2024", 1), (1, 3): ("12/03/2024", 1), (1, 4): ("1/1/2020", 3), (1, 5): ("12/03/2024", 1), (1, 6): ("12/03/2024", 1), (1, 7): ("12/03/2024", 1),
        (1, 8): (None, None), (1, 9): (None, None), (1, 10): (None, None), (1, 11): ("3 aprile", 10), (2, 1): (None, None),
    }


def test_a_note_is_read_in_few_passes(spark):
    from tessera.functions import dates

    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("t")).select(c(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(dates.parse_italian).count("regexp_extract(") <= 40  # were 128: every part of every form for each mention of it
    days = [("3/2/49 e poi", "2049-02-03"), ("31/02/2020 poi 7 Aprile 2021", "2021-04-07"), ("06/2018", "2018-06-01"), ("0/2018", None), ("marzo 9, 2020", "2020-03-09"), ("12 5 50", "1950-05-12"), ("9/9/99999", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(days)], "i int, t string")
    assert [r[1] for r in df.select("i", dates.parse_italian(F.col("t"))).orderBy("i").collect()] == [d for _, d in days]
