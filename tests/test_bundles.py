"""Bundles on rows with nulls, ties and nothing at all; writing a table without a gap."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import bundles, evidence
from tessera.sources import sinks


def test_reduction_of_null_and_unknown_values(spark):
    rows = [(1, None, None, None, None, None), (2, "high", "suspected", "present", True, 1), (2, "odd", "confirmed", "absent", True, 2), (3, "critical", "excluded", "absent", False, 1)]
    df = spark.createDataFrame(rows, "k int, significance string, certainty string, assertion string, verified boolean, document_id int")
    got = {r.k: (r.significance, r.certainty, r.assertion, r.confidence) for r in bundles.reduced(df, ["k"]).collect()}
    assert got[1] == ("uncertain", "unknown", "unknown", 0.7)
    assert got[2] == ("high", "confirmed", "present", 0.45) and got[3] == ("critical", "excluded", "absent", 0.55)
    assert bundles.reduced(df.limit(0), ["k"]).count() == 0


def test_mode_ties_and_first_filled(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, None, 0), (1, "", 0), (2, None, 1)], "k int, v string, i int")
    assert {(r.k, r.m) for r in bundles.mode(df.where("v != ''"), ["k"], "v", "m").collect()} == {(1, "a")}
    assert {(r.k, r.v) for r in bundles.first_filled(df, ["k"], "v", ["i"]).collect()} == {(1, "b")}


def test_remap_keeps_order_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, "[3,1,3]", "x"), (2, "[]", "y"), (3, None, "z")], "k int, ids string, old string")
    moved = spark.createDataFrame([(3, 30)], "old long, new long")
    assert {r.k: r.ids for r in bundles.remapped(df, "k", "ids", moved).collect()} == {1: "[30,1,30]", 2: "[]", 3: None}


@pytest.mark.parametrize(("said", "iso"), [("12/04/2026", "2026-04-12"), ("1929-08-26", "1929-08-26"), ("Esame 22 10 2014", "2014-10-22"), ("aprile 12, 2026", "2026-04-12"), ("05/2019", None), ("31/02/2020", None), ("", None), ("30/1/49", "2049-01-30"), ("30/1/50", "1950-01-30")])
def test_five_forms_of_dates(spark, said, iso):
    assert spark.range(1).select(dates.parse_italian(F.lit(said), month_year=False)).first()[0] == iso


def test_rules_on_null_and_empty_quotes(spark):
    df = spark.createDataFrame([(None,), ("",), ("Attualmente non si esclude frattura",), ("NEGATIVI PER K",), ("NEGATIVA PER K",)], "q string")
    none = F.lit(None).cast("string")
    got = [tuple(r) for r in df.select(evidence.lifecycle(F.col("q"), none), evidence.directly_negated(F.col("q")), evidence.certainty(F.lit("diagnosis"), none, F.lit("unknown"), F.col("q"), none, F.lit(False))).collect()]
    assert got == [(None, False, "unknown"), (None, False, "unknown"), (None, False, "unknown"), (None, False, "unknown"), (None, False, "excluded")]


def test_swap_in_puts_back_what_a_crash_left(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        sinks.swap_in(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    (tmp_path / "t").rename(tmp_path / "t.old")
    sinks.swap_in(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_words_side_by_side_share_a_blank_and_marks_part_words(spark):
    families = {"secrets": ["token", "key"], "english": ["the", "and"]}
    said = [("the the token", "secrets"), ("the and the, key", "english"), ("thé", "none"), ("The key. THE end", "english"), ("tokens", "none"), ("", "none")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string")
    assert [r[1] for r in df.select("i", bundles.most_hit(F.col("t"), families, "none")).orderBy("i").collect()] == [f for _, f in said]
