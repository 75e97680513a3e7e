"""Bundles, headers and the gold workflow on hand-made rows."""

import datetime as dt

from tessera.operators import graph, projections, texts


def test_bundles_merge_only_as_cliques(spark):
    d = dt.date(2024, 1, 1)
    base = "patient started treatment with drug alpha at full dose today"
    rows = [
        (1, 1, base, d, "c", "present", 0.5), (1, 2, base + "!", d, "c", "present", 0.9), (1, 3, base.replace("started", "stopped"), d, "c", "absent", 0.9),
        (1, 4, "a wholly different sentence about the liver", d, "c", "present", 0.9), (2, 5, base, d, "c", "present", 0.9),
    ]
    df = spark.createDataFrame(rows, "s long, k long, t string, d date, c string, p string, f double")
    graph._checkpoint_dir(df)
    got = {r.k: r.survivor for r in projections.merge_bundles(df, "s", "k", "t", "d", "c", "p", "f").collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5}


def test_header_metadata(spark):
    text = "OSPEDALE\nReparto: Oncologia Medica\nEsame: TC torace\nEsame: RX\nEsame: TC torace\ncorpo"
    df = texts.lines(spark.createDataFrame([(1, text), (2, "nulla")], "doc_id long, text string"))
    (row,) = projections.header_metadata(df, "doc_id").collect()
    assert (row.doc_id, row.department, row.services, row.specialty, row.confidence) == (1, "Oncologia Medica", ["TC torace", "RX"], "oncology", 0.95)


def test_lockable_cases(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    notes = spark.createDataFrame([(1, "a", True, True, None), (1, "b", True, True, None), (2, "a", True, False, None), (2, "b", True, True, "x")], "case_id long, reviewer string, submitted boolean, agreed boolean, adjudicated string")
    assert {r.case_id: r.lockable for r in projections.lockable(cases, notes).collect()} == {1: True, 2: False, 3: False}
