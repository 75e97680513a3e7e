"""Tables of several layouts, answered by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import lab_tables as lt
from tessera.operators import labs

TABLES = {
    "wide": [["Esame", "Risultato", "U.M.", "Valori di riferimento"], ["Emoglobina", "10,5", "g/dl", "12-16"], ["Glicemia", "95", "mg/dL", "(70-110)"], ["HIV", "Positivo", "", ""], ["Sodio", "nan", "mEq/L", ""], ["", "3", "", ""], ["Pagina", "3", "%", ""]],
    "turned": [["Range", "Unit", "Value", "Parameter"], ["<5", "mg/L", "7,2", "PCR"], ["4.000-10.000", "/μL", "5.200", "Leucociti"], ["", "", "debolmente  positivo", "HBsAb"], ["", "", "abc", "PCR"], ["", "kg", "80", "Peso"]],
    "grid": [["", "A", "B"], ["Emoglobina", "10", "g/dl"]],
    "single": [["Esame"], ["Emoglobina"]],
    "no value": [["Esame", "Unità"], ["Emoglobina", "g/dl"]],
    "twice": [["Test", "Valore", "Valore precedente"], ["Potassio", "4,1", "3,9"]],
    "header only": [["Esame", "Valore"]],
}


def results(spark, tables):
    cells = [(name, r, c, x, "extra") for name, rows in tables.items() for r, row in enumerate(rows) for c, x in enumerate(row)]
    out = lt.table_results(spark.createDataFrame(cells, "t string, r int, c int, x string, value string"), ["t"], "r", "c", "x")
    return {(r.t, r.r): tuple(r)[2:] for r in out.collect()}


def test_layouts(spark):
    assert results(spark, TABLES) == {
        ("wide", 1): ("Emoglobina", "emoglobina", 10.5, None, "g/dL", 12.0, 16.0, True, "L"),
        ("wide", 2): ("Glicemia", "glucosio", 95.0, None, "mg/dL", 70.0, 110.0, False, None),
        ("wide", 3): ("HIV", "hiv", None, "POSITIVO", "", None, None, True, "*"),
        ("turned", 1): ("PCR", "proteina_c_reattiva", 7.2, None, "mg/L", None, 5.0, True, "H"),
        ("turned", 2): ("Leucociti", "leucociti", 5200.0, None, "/μL", 4.0, 10.0, True, "H"),
        ("turned", 3): ("HBsAb", "hbsab", None, "DEBOLE POSITIVO", "", None, None, False, None),
        ("twice", 1): ("Potassio", "potassio", 3.9, None, "", None, None, False, None),
    }


def test_nothing_and_nulls(spark):
    assert results(spark, {}) == {}
    assert results(spark, {"t": [["Esame", None, "Valore"], [None, "x", "1"], ["Sodio", None, "140"], ["Sodio", "x", None]]}) == {("t", 2): ("Sodio", "sodio", 140.0, None, "", None, None, False, None)}


def test_plausible_analytes(spark):
    cases = {("[3] Emoglobina", ""): True, ("Peso", "kg"): False, ("Altro", "mg/dL"): True, ("Altro", "MG/DL"): True, ("Laboratorio analisi", "%"): False, ("123", "%"): False, ("", "%"): False, ("x" * 101, "%"): False, (None, None): False, ("PT (INR)", ""): True}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, n string, u string")
    assert [r[1] for r in df.select("i", lt.plausible_analyte(F.col("n"), F.col("u"))).orderBy("i").collect()] == list(cases.values())


def test_lines_of_text(spark):
    lines = [
        "PAGINA 1", "Emoglobina: 10,5 * g/dL (12-16)", "[0] Leucociti 5.200 /µL 4000 - 10000", "Sodio 140 mmol/L", "HIV: NEGATIVO", "HBsAg Positivo *", "--- PAGINA 2 ---", "ESAME URINE", "Proteine: 30 mg/dL", "Glucosio assente",
        "Laboratorio: 3 %", "Tel: 0532 123456", "Testo senza risultato", None, "", "| Esame | Esito | Flag | U.M. | Int |", "|---|---|---|---|---|", "| Potassio | 6,1 | H | mmol/L | 3-5 |", "fine", "| Cloro | 100 | | mmol/L | 90-110 |", "PCR < 0,5 mg/dL", "CA 19-9: 12 U/mL <37",
    ]
    df = spark.createDataFrame([(1, i, x, "x") for i, x in enumerate(lines)] + [(2, 0, "Ferro 50 ug/dL", "x")], "d int, line_no int, line string, page string")
    got = {(r.d, r.line_no): (r.page, r.specimen, r.name, r.value, r.value_text, r.operator, r.unit, r.low, r.high, r.flag) for r in lt.text_results(df, "d").collect()}
    assert got == {
        (1, 1): (1, None, "emoglobina", 10.5, None, None, "g/dL", 12.0, 16.0, "L"), (1, 2): (1, None, "leucociti", 5200.0, None, None, "/μL", 4000.0, 10000.0, None), (1, 3): (1, None, "sodio", 140.0, None, None, "mmol/L", None, None, None),
        (1, 4): (1, None, "hiv", None, "NEGATIVO", None, "", None, None, None), (1, 5): (1, None, "hbsag", None, "POSITIVO", None, "", None, None, "*"), (1, 8): (2, "urine", "proteine_urine", 30.0, None, None, "mg/dL", None, None, None),
        (1, 9): (2, "urine", "glucosio", None, "ASSENTE", None, "", None, None, None), (1, 17): (2, "urine", "potassio", 6.1, None, None, "mmol/L", 3.0, 5.0, "H"), (1, 20): (2, "urine", "proteina_c_reattiva", 0.5, None, "<", "mg/dL", None, None, None),
        (1, 21): (2, "urine", "ca_19-9", 12.0, None, None, "U/mL", None, 37.0, None), (2, 0): (None, None, "ferro", 50.0, None, None, "μg/dL", None, None, None),
    }


@pytest.mark.parametrize("name, pattern, most", [("lab_result_lines", labs.RESULT, 7), ("lab_text_results", lt.NUMERIC_RESULT, 6)])
def test_each_part_of_a_line_is_matched_once(spark, name, pattern, most):
    """Conditions on what a pattern found do not match it again: one match for the test, one for each part."""
    from tessera.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(pattern) <= most
