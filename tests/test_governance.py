"""Governance operators on nulls, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import governance


@pytest.mark.parametrize(("said", "base"), [(None, "other"), ("", "other"), (" CLINICAL_SYNDROME ", "diagnosis"), ("care_plan", "care_plan"), ("mood", "other")])
def test_categories_fold(spark, said, base):
    assert spark.range(1).select(governance.folded_category(F.lit(said).cast("string"))).first()[0] == base


def test_codes_of_null_concepts_and_without_mappings(spark):
    items = spark.createDataFrame([(1, None, "mg"), (2, "hb", None), (2, "hb", None), (3, "hb", "kg")], "id int, c string, u string")
    reviewed = spark.createDataFrame([], "c string, u string, code string")
    builtin = spark.createDataFrame([("hb", "B", ["mg"]), ("hb", "A", ["g"])], "c string, code string, units array<string>")
    got = sorted((r.id, r.code, r.code_source) for r in governance.coded(items, reviewed, builtin, "c", "u").collect())
    assert got == [(1, None, "none"), (2, "A", "builtin"), (2, "A", "builtin"), (3, None, "none")]


def test_replacement_keeps_rows_without_a_scope(spark):
    schema = "id int, document int, method string, v int"
    current = spark.createDataFrame([(1, 1, "a", 0), (2, 1, "a", 0), (3, 1, "b", 0), (4, None, "a", 0)], schema)
    incoming = spark.createDataFrame([(2, 1, "a", 9), (5, 1, "a", 9)], schema)
    scopes = spark.createDataFrame([(1, "a"), (1, "a")], "document int, method string")
    assert sorted((r.id, r.v) for r in governance.replaced(current, incoming, scopes, "id").collect()) == [(2, 9), (3, 0), (4, 0), (5, 9)]


def test_merged_subjects_share_documents_of_one_hash(spark):
    documents = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("b", 4, "y"), ("b", 5, None), ("c", 6, "x"), ("a", 7, None)], "s string, d int, h string")
    moves = spark.createDataFrame([("b", "a"), ("c", "a")], "source string, target string")
    guarded = spark.createDataFrame([("c",)], "source string")
    got = sorted(tuple(r) for r in governance.merged_documents(documents, moves, guarded, "s", "d", "h").collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("a", 3, 1), ("a", 4, 4), ("a", 5, 5), ("a", 7, 7), ("c", 6, 6)]


def test_evidence_goes_with_its_last_document(spark):
    evidence = spark.createDataFrame([(1,), (2,), (3,)], "e int")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "e int, d int")
    gone = spark.createDataFrame([(1,)], "d int")
    assert [tuple(r) for r in governance.without_documents(evidence, links, gone, "e", "d").collect()] == [(1, 1, 2)]
