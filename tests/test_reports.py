"""Edge cases of the report operators."""

from pyspark.sql import functions as F

from tessera.operators import reports


def test_observed_date_forms(spark):
    cases = [("2024-2-3", "2024-02-03"), ("2024-11", "2024-11"), ("5/1/2023", "2023-01-05"), ("29.02.2023", "doc"), ("2024-13", "doc"), ("0000-01", "doc"), ("1/2/24", "doc"), (" 2024-1-9 ", "2024-01-09"), (None, "doc"), ("", "doc")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [(r.t, r.got) for r in df.select("t", reports.observed_date(F.col("t"), F.lit("doc")).alias("got")).collect()] == cases
    assert df.select(reports.observed_date(F.lit("x"), F.lit(None).cast("string"))).first()[0] == ""


def test_own_ids_stay_and_others_are_filled_in(spark):
    schema = "id long, organs array<string>, cited array<string>, notes string"
    rows = [(1, ["a"], ["#E_2", "E_2", " "], "see E_9"), (2, ["a"], [], "see #E_9 and E_9"), (3, ["a", "b", "a"], None, None), (4, None, None, ""), (5, ["c"], [], "none")]
    findings = spark.createDataFrame([("a", ["#E_4", "E_3"]), ("b", ["E_3", "E_5"]), ("b", None)], "organ string, cited array<string>")
    got = {r.id: r.cited for r in reports.with_cited_ids(spark.createDataFrame(rows, schema), findings, "id", "#?E_[0-9]+").collect()}
    assert got[1] == ["E_2"] and got[2] == ["E_9"] and sorted(got[3]) == ["E_3", "E_4", "E_5"] and got[4] == [] and got[5] == []


def test_retrieval_keeps_events_without_evidence_and_unknown_days_last(spark):
    events = spark.createDataFrame([(1, 1, None, True), (2, 1, "2020", True), (3, 1, "2019", True), (4, 1, "2021", False)], "e long, s long, d string, ok boolean")
    evidence = spark.createDataFrame([(2, True), (3, True), (3, False)], "e long, admin boolean")
    out = reports.retrieved(events, evidence, "s", "e", "d", F.col("ok"), F.lit(True), F.lit(0), F.lit(True), F.col("admin"), 9)
    assert [(r.e, r.place) for r in out.orderBy("place").collect()] == [(3, 1), (1, 2)]


def test_introduced_numbers_count_repeats(spark):
    source = spark.createDataFrame([(1, "5 of 5, 1.20"), (2, None)], "k long, t string")
    output = spark.createDataFrame([(1, "5, 5, 5 and 1.20"), (2, "7")], "k long, t string")
    assert sorted(tuple(r) for r in reports.introduced_numbers(source, output, "k", "t").collect()) == [(1, "5", 1), (2, "7", 1)]


def test_first_system_wins_ties_and_none_without_terms(spark):
    df = spark.createDataFrame([("x y",), ("y",), ("z",), (None,)], "t string")
    got = [r[0] for r in df.select(reports.system_of(F.col("t"), {"one": ["x"], "two": ["y"]})).collect()]
    assert got == ["one", "two", None, None]
