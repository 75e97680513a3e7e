"""Signals of sentences and what covers them, answered by hand."""

from pyspark.sql import functions as F

from tessera.operators import coverage

SENTENCES = {
    "TC addome: nulla": [], "RM encefalo mostra lesione": ["radiology_finding"], "etc evidenzia": [], "tosse scomparsa": [], "Affetto da melanoma metastatico": ["diagnosis"], "Biopsia cutanea": ["procedure"], "RT alla mammella": ["procedure"],
    "SpO2 98%": ["vital_sign"], "in programma follow-up": ["clinical_decision"], "accesso in PS": ["hospitalization"], "dimessa": ["discharge"], "PD-L1 50%": ["biomarker"], "": [], None: [],
}


def test_signal_types(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SENTENCES)], "i int, s string")
    assert [r[1] for r in df.select("i", coverage.signal_types(F.col("s"))).orderBy("i").collect()] == list(SENTENCES.values())


def plan(spark, sentences, facts):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sentences, 1)], "d int, n int, s string")
    given = spark.createDataFrame([(1, kind, refs) for kind, refs in facts], "d int, fact_type string, refs array<int>")
    missing = coverage.missing_signals(rows, given, "d", "n", "s")
    return sorted((r.n, r.fact_type) for r in missing.collect()), [(r.sentences, r.fact_types) for r in coverage.recovery_plan(missing, "d", "n").collect()]


def test_facts_cover_equivalent_types(spark):
    sentences = ["TC: evidenza di nodulo", "FC 80", "si propone biopsia", "Esame istologico: diagnosi di melanoma", "Eseguita biopsia epatica", "tosse"]
    assert plan(spark, sentences, [])[1] == [([1, 2, 3, 4, 6], ["clinical_decision", "diagnosis", "procedure", "radiology_finding", "symptom", "vital_sign"])]
    covered = [("instrumental_finding", [1]), ("clinical_sign", [2]), ("procedure", [3]), ("histopathology", [4]), ("symptom", [6, None]), ("symptom", [6]), (None, [1])]
    assert plan(spark, sentences, covered) == ([], [])
    assert plan(spark, sentences[5:], [("clinical_sign", [1]), ("symptom", [2]), ("symptom", None)])[0] == [(1, "symptom")]
