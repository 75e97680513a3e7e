"""Hand-written cases of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, numbers, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "lo", "hi", "precision"),
    [
        ("2024", dt.date(2024, 1, 1), dt.date(2024, 12, 31), "year"),
        ("2024-02", dt.date(2024, 2, 1), dt.date(2024, 2, 29), "month"),
        ("2023-05-07", dt.date(2023, 5, 7), dt.date(2023, 5, 7), "day"),
        ("2023-02-30", None, None, "day"),
        ("unknown", None, None, "unknown"),
    ],
)
def test_partial_dates(spark, value, lo, hi, precision):
    c = F.lit(value)
    assert one(spark, dates.lower_bound(c)) == lo
    assert one(spark, dates.upper_bound(c)) == hi
    assert one(spark, dates.precision(c)) == precision


@pytest.mark.parametrize(
    ("said", "iso"),
    [
        ("visita del 03/04/2021 ore 10", "2021-04-03"),
        ("il 12 marzo 2019", "2019-03-12"),
        ("2020-1-5", "2020-01-05"),
        ("rx 01-02-49", "2049-02-01"),
        ("rx 01-02-50", "1950-02-01"),
        ("da 06/2018", "2018-06-01"),
        ("31/02/2020", None),
        ("nessuna data", None),
    ],
)
def test_italian_dates(spark, said, iso):
    assert one(spark, dates.parse_italian(F.lit(said))) == iso


def test_unknown_distance_stays_unknown(spark):
    day, none = F.lit(dt.date(2024, 1, 1)), F.lit(None).cast("date")
    assert one(spark, dates.distance(day, day, none, none)) is None
    assert one(spark, dates.distance(day, day, F.date_add(day, 9), F.date_add(day, 20))) == 9


def test_leap_day_minus_a_year(spark):
    assert one(spark, dates.subtract(F.lit(dt.date(2024, 2, 29)), F.lit(1), F.lit("year"))) == dt.date(2023, 2, 28)


@pytest.mark.parametrize(("said", "value"), [("1.234,56", 1234.56), ("1.234.567", 1234567.0), ("12.5", 12.5), (" 7 ", 7.0), ("-3,5", -3.5), ("abc", None), ("", None)])
def test_italian_numbers(spark, said, value):
    assert one(spark, numbers.italian_number(F.lit(said))) == value


def test_check_letter(spark):
    assert one(spark, numbers.check_letter(F.lit("RSSMRA85T10A562"))) == "S"
    assert one(spark, numbers.check_letter(F.lit("short"))) is None


def test_entity_key_folds_marks_and_stop_words(spark):
    assert one(spark, text.entity_key(F.lit("Dolore della Città, 5%"))) == "dolore_citta_5%"


def test_redaction_in_order(spark):
    said = "Sig. Rossi scrive a.b@c.it, tel. 06 1234567, IP 10.0.0.1"
    assert one(spark, text.redacted(F.lit(said))) == "[NAME] scrive [EMAIL], [LABELLED_PHONE], IP [ADDRESS]"
    counts = one(spark, text.redaction_counts(F.lit(said)))
    assert counts["email"] == counts["name"] == counts["labelled_phone"] == counts["address"] == 1


def test_safe_refs(spark):
    assert one(spark, numbers.safe_refs(F.array(*map(F.lit, ["S3", "2", "x", "S9", "3"])), F.lit(5))) == [2, 3]
