"""Operators that no query reaches, by hand-made rows."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import dates, numbers
from tessera.operators import identity, labs, relational, toxicity
from tessera.sources import files, sinks


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


def test_organs_go_by_the_first_stem(spark):
    texts = ["Rash diffuso", "diarrea e rash", "EPATITE", "astenia", "astenia, dispnea", "altro", "", None]
    assert column(spark, texts, "string", toxicity.organ) == ["skin", "skin", "liver", "generic", "lung", None, None, None]
    assert column(spark, ["nodulo osseo"], "string", lambda t: toxicity.organ(t, {"bone": ["oss"]}, ["x"])) == ["bone"]


def test_values_within_the_limit_are_not_specific(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 2.0, "<"), (2.0, 2.0, ">="), (3.0, 2.0, None), (None, 2.0, None), (1.0, None, None)], "v double, u double, o string")
    assert [r[0] for r in df.select(toxicity.specific(F.col("v"), F.col("u"), F.col("o"))).collect()] == [False, False, True, True, True, True]
    rows = spark.createDataFrame([("unlikely",), ("possible",), ("probable",), (None,)], "p string")
    assert [r.standing for r in toxicity.final_and_suspect(rows, "p").collect()] == ["suspect", "suspect", "final", "final"]


def test_pipe_rows_of_five_layouts(spark):
    lines = ["| Potassio | 6,1 | H | mmol/L | 3-5 |", "| Sodio | 140 | mmol/L | 135-145 |", "| Cloro | 114 * | mmol/L | 90-110 |", "| Ferro | 50 | | ug/dL | |", "| Titolo | x | y |", "testo", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: (r.parameter, r.value, r.unit, r.low, r.high, r.flag) for r in labs.pipe_rows(df).collect()}
    assert got == {0: ("Potassio", 6.1, "mmol/L", 3.0, 5.0, "H"), 1: ("Sodio", 140.0, "mmol/L", 135.0, 145.0, None), 2: ("Cloro", 114.0, "mmol/L", 90.0, 110.0, "H"), 3: ("Ferro", 50.0, "μg/dL", None, None, None)}


def test_specimens_carry_forward(spark):
    lines = [(1, 1, "Sodio 140"), (1, 2, "ESAME URINE"), (1, 3, "Proteine: 3"), (1, 4, "SIERO"), (1, 5, "x"), (2, 1, "Materiale: Urina"), (2, 2, "y"), (3, 1, "Materiale: Urina"), (3, 2, "Materiale: Sangue")]
    df = spark.createDataFrame(lines, "d int, line_no int, line string")
    assert [r.specimen for r in labs.with_specimen(df, "d").orderBy("d", "line_no").collect()] == [None, "urine", "urine", None, None, "urine", "urine", "urine", None]
    assert {r.d: r.specimen for r in labs.document_specimen(df, "d").collect()} == {2: "urine", 3: None}


def test_birth_and_sex_of_codes(spark):
    codes = ["RSSMRA80A01H501U", "VRDNNA05D55F205X", "short", None]
    assert column(spark, codes, "string", lambda c: identity.birth_of_code(c, 2026)) == [dt.date(1980, 1, 1), dt.date(2005, 4, 15), None, None]
    assert column(spark, codes, "string", identity.sex_of_code) == ["M", "F", None, None]


def test_groups_with_two_values_conflict(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "y"), (4, "c", None)], "k int, code string, birth string")
    of = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "k int, `group` int")
    assert {r.group: (r.members, r.conflicts) for r in identity.group_conflicts(rows, of, "k", ["code", "birth"]).collect()} == {1: (2, ["code"]), 3: (2, [])}


def test_stale_runs_are_interrupted(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("running", now - dt.timedelta(hours=2)), ("running", now), ("done", now - dt.timedelta(hours=2)), ("running", None)], "status string, started timestamp")
    assert [r.status for r in relational.interrupted(rows, F.lit(now), 30).collect()] == ["interrupted", "running", "done", "running"]


def test_children_nest_under_parents(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "p int, name string")
    events = spark.createDataFrame([(1, 9, "z"), (1, 3, "y"), (7, 1, "lost")], "p int, n int, what string")
    got = {r.p: [tuple(e) for e in r.events] for r in sinks.nested(parents, "p", {"events": events}).collect()}
    assert got == {1: [(3, "y"), (9, "z")], 2: []}


def test_staging_names_earlier_copies(spark):
    new = spark.createDataFrame([("x", "h1"), ("y", "h2"), ("z", None)], "path string, file_hash string")
    known = spark.createDataFrame([(5, "h1"), (3, "h1"), (4, None)], "document_id int, file_hash string")
    assert {r.path: r.duplicate_of for r in files.staged(new, known).collect()} == {"x": 3, "y": None, "z": None}


def test_unreadable_gold_lines_are_kept(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text(json.dumps({"id": 1}) + "\n{broken\n")
    rows = files.read_gold(spark, str(tmp_path / "gold.jsonl"), T.StructType([T.StructField("id", T.IntegerType())])).cache().collect()
    assert [(r.id, r._corrupt) for r in rows] == [(1, None), (None, "{broken")]


def test_numbers_and_sort_keys(spark):
    assert column(spark, [1.0, None], "double", lambda v: numbers.converted(v, F.lit(2.0), F.lit(0.5))) == [2.5, None]
    assert column(spark, [-1.0, 0.5, 7.0, None], "double", lambda v: numbers.clamp(v, 0.0, 1.0)) == [0.0, 0.5, 1.0, None]
    assert column(spark, ["2024", "2024-02", "2024-02-03", "x", None], "string", dates.sort_key) == [dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 2, 3), dt.date(9999, 12, 31), dt.date(9999, 12, 31)]
