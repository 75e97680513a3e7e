"""Laboratory results out of text: result lines, pipe rows, units, flags, specimens, in-document deduplication.

All rules are column expressions over lines, so a report is parsed by windows over its
lines and never as one Python object.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import italian_number, reference_range
from tessera.functions.text import computed, fold, let

#: Units by their compact lower-case form.
UNITS = {
    "mg/dl": "mg/dL", "mg/100ml": "mg/dL", "g/dl": "g/dL", "g/100ml": "g/dL", "ng/ml": "ng/mL", "ng/l": "ng/L", "pg/ml": "pg/mL", "mg/l": "mg/L", "g/l": "g/L", "ug/l": "μg/L", "μg/l": "μg/L", "μg/ml": "μg/mL", "ug/ml": "μg/mL", "μg/dl": "μg/dL", "ug/dl": "μg/dL",
    "u/l": "U/L", "ui/l": "U/L", "iu/l": "U/L", "meq/l": "mEq/L", "mmol/l": "mmol/L", "μmol/l": "μmol/L", "umol/l": "μmol/L", "ml/min": "mL/min", "μu/ml": "μU/mL", "uu/ml": "μU/mL", "pmol/l": "pmol/L", "nmol/l": "nmol/L",
    "ratio": "Ratio", "inr": "INR", "fl": "fL", "pg": "pg", "%": "%", "mm/h": "mm/h", "mm3": "mm³", "μl": "/μL", "ul": "/μL", "/μl": "/μL", "103/μl": "×10³/μL", "106/μl": "×10⁶/μL", "x10^3/μl": "×10³/μL", "x10^6/μl": "×10⁶/μL",
}
#: Names of analytes, in the order in which they are replaced.
SYNONYMS = {
    "hb": "emoglobina", "hgb": "emoglobina", "plt": "piastrine", "got": "ast", "gpt": "alt", "ast": "aspartato_aminotransferasi", "alt": "alanina_aminotransferasi", "creat.": "creatinina", "glicemia": "glucosio", "azotemia": "urea",
    "ves": "velocita_eritrosedimentazione", "gb": "globuli_bianchi", "wbc": "globuli_bianchi", "gr": "globuli_rossi", "rbc": "globuli_rossi", "hct": "ematocrito", "mcv": "volume_corpuscolare_medio", "mch": "contenuto_emoglobinico_medio",
    "mchc": "concentrazione_emoglobinica_media", "rdw": "ampiezza_distribuzione_eritrocitaria", "neutrofili": "neutrofili", "linfociti": "linfociti", "monociti": "monociti", "eosinofili": "eosinofili", "basofili": "basofili",
    "pt": "tempo_protrombina", "pt (inr)": "tempo_protrombina_inr", "pt(inr)": "tempo_protrombina_inr", "pt (ratio)": "tempo_protrombina_ratio", "pt(ratio)": "tempo_protrombina_ratio", "ptt": "tempo_tromboplastina_parziale",
    "aptt": "tempo_tromboplastina_parziale_attivata", "inr": "rapporto_normalizzato_internazionale", "fibrinogeno": "fibrinogeno", "d-dimero": "d_dimero", "pcr": "proteina_c_reattiva", "proteina_c_reattiva": "proteina_c_reattiva",
    "tsh": "ormone_tireostimolante", "ft3": "triiodotironina_libera", "ft4": "tiroxina_libera", "t3": "triiodotironina", "t4": "tiroxina", "ldh": "lattato_deidrogenasi", "cpk": "creatinfosfochinasi", "ck": "creatinchinasi",
    "troponina": "troponina", "nt-probnp": "nt_pro_bnp", "pro_bnp": "pro_bnp", "ca125": "ca_125", "ca 125": "ca_125", "cea": "antigene_carcinoembrionario", "afp": "alfa_fetoproteina", "psa": "antigene_prostatico_specifico",
    "ca19-9": "ca_19_9", "ca 19.9": "ca_19_9", "bilirubina_totale": "bilirubina_totale", "bilirubina_diretta": "bilirubina_diretta", "bilirubina_indiretta": "bilirubina_indiretta", "colesterolo_totale": "colesterolo_totale",
    "hdl": "colesterolo_hdl", "ldl": "colesterolo_ldl", "trigliceridi": "trigliceridi", "proteine_totali": "proteine_totali", "albumina": "albumina", "calcio": "calcio", "potassio": "potassio", "sodio": "sodio", "cloro": "cloro",
    "magnesio": "magnesio", "ferro": "ferro", "ferritina": "ferritina", "transferrina": "transferrina", "acido_urico": "acido_urico", "uricemia": "acido_urico", "amilasi": "amilasi", "lipasi": "lipasi", "pct": "procalcitonina",
    "egfr": "egfr", "vel. filtr. glomerulare (egfr)": "egfr", "iga": "immunoglobulina_a", "igg": "immunoglobulina_g", "igm": "immunoglobulina_m", "ige": "immunoglobulina_e",
}
#: Cells counted both ways, and analytes that another material makes another analyte, for some units (None: for any).
DIFFERENTIAL = ["neutrofili", "linfociti", "monociti", "eosinofili", "basofili", "eritroblasti"]
BY_MATERIAL = {
    "emoglobina": {"urine": ["mg/dL"]}, "proteine": {"urine": ["mg/dL"], "liquor": ["mg/dL"]}, "glucosio": {"urine": None}, "leucociti": {"urine": None}, "eritrociti": {"urine": None}, "creatinina": {"urine": ["mg/24h", "g/24h"]},
    "potassio": {"urine": ["mmol/24h"]}, "sodio": {"urine": ["mmol/24h"]}, "cloro": {"urine": ["mmol/24h"]}, "calcio": {"urine": ["mg/24h"]},
}
#: Results given in words.
WORD_RESULTS = {"positivo": "POSITIVO", "positiva": "POSITIVO", "negativo": "NEGATIVO", "negativa": "NEGATIVO", "assente": "ASSENTE", "presente": "PRESENTE", "rilevabile": "RILEVABILE", "alterato": "ALTERATO", "tracce": "TRACCE"}
PATHOGEN_MARKERS = ["hiv", "hcv", "hbsag", "sars", "tpha", "vdrl", "antigene", "tampone"]
PROTECTIVE_MARKERS = ["hbsab", "anti_hbs", "anticorpi_anti_hbs"]
#: Materials named in section headings.
MATERIALS = {"urin": "urine", "liquor": "liquor", "feci": "feci", "saliv": "saliva", "siero": "", "sangue": "", "plasma": ""}

RESULT = r"^\s*([A-Za-zÀ-ÿ][^:|]{0,99}?)\s*:\s*(<=|>=|<|>)?\s*([+-]?\d[\d.,]*)\s*(\*{1,3}|!|[HL]\b)?\s*([A-Za-zμµ%/×^0-9]*?)\s*(?:[\[(]\s*([^\])]*?)\s*[\])])?\s*(\*{1,3}|!|[HL])?\s*$"
WORDED = r"(?i)^\s*([A-Za-zÀ-ÿ][^:|]{0,99}?)\s*:\s*(" + "|".join(WORD_RESULTS) + r")\b.*$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normal_unit(unit: Column) -> Column:
    """The canonical form of a unit; one without an entry stays as it is, trimmed."""
    compact = F.regexp_replace(F.translate(F.lower(F.trim(unit)), "µ×", "μx"), r"\s|^[.,;:]+|[.,;:]+$", "")
    compact = F.regexp_replace(compact, r"^x10(?:\^|\*\*)?([36])/", r"x10^$1/")
    return F.coalesce(_lookup(UNITS, compact), F.trim(unit))


def normal_parameter(name: Column, unit: Column, material: Column) -> Column:
    """The canonical name of an analyte.

    A name in SYNONYMS is replaced as a whole; in any other every synonym that stands in
    it as whole words is replaced, one after the other, so a replacement can be replaced
    again (got, ast). Blanks become '_'. Cells of the differential get '_percentuale' or
    '_assoluti' by their unit, and analytes of BY_MATERIAL the material's name, if a unit
    is given and fits. A null or empty name is empty.
    """
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[.,;: ]+$", "")
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in SYNONYMS.items()])
    whole = lambda k: F.concat(F.lit(r"(?iU)\b\Q"), k, F.lit(r"\E\b"))
    replaced = lambda text: F.aggregate(table, text, lambda t, x: F.when(F.contains(t, x["k"]), F.regexp_replace(t, whole(x["k"]), x["v"])).otherwise(t))
    key = let(bare, lambda b: F.regexp_replace(F.replace(F.coalesce(_lookup(SYNONYMS, b), replaced(b)), F.lit(" "), F.lit("_")), "_+", "_"))

    def suffixed(row: Column) -> Column:
        k, u, m = row["key"], row["unit"], row["material"]
        counted = k.isin(DIFFERENTIAL)
        k2 = F.when(counted & (u == "%"), F.concat(k, F.lit("_percentuale"))).when(counted & u.isin("/μL", "×10³/μL", "×10⁶/μL"), F.concat(k, F.lit("_assoluti"))).otherwise(k)
        gate = F.lit(False)
        for analyte, gates in BY_MATERIAL.items():
            for where, units in gates.items():
                gate = gate | ((k2 == analyte) & (m == where) & (u.isin(units) if units else F.lit(True)))
        return F.when(gate & (u != ""), F.concat_ws("_", k2, m)).otherwise(k2)

    return let(F.struct(key.alias("key"), F.coalesce(normal_unit(unit), F.lit("")).alias("unit"), F.lower(F.trim(F.coalesce(material, F.lit("")))).alias("material")), suffixed)


def out_of_range(value: Column, low: Column, high: Column, reference: Column, marker: Column) -> Column:
    """struct(abnormal, flag): one-sided references without '=' count the limit itself as outside; a printed marker decides."""
    compact = F.regexp_replace(F.coalesce(reference, F.lit("")), r"\s", "")
    above = F.when(compact.rlike("^<(?!=)"), value >= high).otherwise(value > high)
    below = F.when(compact.rlike("^>(?!=)"), value <= low).otherwise(value < low)
    computed = F.when(F.coalesce(above, F.lit(False)), "H").when(F.coalesce(below, F.lit(False)), "L")
    said = F.upper(F.coalesce(marker, F.lit("")))
    flag = F.when(said.isin("H", "↑"), "H").when(said.isin("L", "↓"), "L").when(said.isin("*", "**", "***", "!"), F.coalesce(computed, F.lit("*"))).otherwise(computed)
    return F.struct(flag.isNotNull().alias("abnormal"), flag.alias("flag"))


def worded_abnormal(name: Column, result: Column) -> Column:
    """'altered' always; positive only for markers of a pathogen, never for protective antibodies."""
    positive = result.isin("POSITIVO", "PRESENTE", "RILEVABILE")

    def of_pathogen(key: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(key, F.lit(marker)) for marker in PATHOGEN_MARKERS]) & ~key.isin(PROTECTIVE_MARKERS)

    return F.when(result.isNotNull(), (result == "ALTERATO") | (positive & let(fold(name), of_pathogen)))


def result_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add parameter, operator, value, value_text, unit, reference, low, high, abnormal, flag to lines that are results."""
    got = lambda pattern, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    rows = computed(lines, {"_n": got(RESULT, 1)})
    rows = computed(rows, {"_w": F.when(F.col("_n").isNull(), got(WORDED, 1))}).where("_n is not null or _w is not null")
    numeric = lambda i: F.when(F.col("_n").isNotNull(), F.regexp_extract(line, RESULT, i))
    rows = computed(rows, {f"_g{i}": numeric(i) for i in range(2, 8)})
    said = lambda i: F.nullif(f"_g{i}", F.lit(""))
    rows = computed(
        rows,
        {
            "parameter": F.regexp_replace(F.coalesce("_n", "_w"), r"\s+", " "),
            "operator": said(2),
            "value": italian_number(F.regexp_replace("_g3", "[.,]$", "")),
            "value_text": F.when(F.col("_n").isNull(), _lookup(WORD_RESULTS, F.lower(F.regexp_extract(line, WORDED, 2)))),
            "unit": F.when(F.col("_n").isNotNull(), normal_unit(F.col("_g5"))),
            "reference": said(6),
            "_marker": F.coalesce(said(4), said(7)),
        },
    ).drop(*[f"_g{i}" for i in range(2, 8)])
    rows = rows.withColumn("_r", reference_range(F.col("reference"))).withColumns({"low": F.col("_r.low"), "high": F.col("_r.high")})
    status = out_of_range(F.col("value"), F.col("low"), F.col("high"), F.col("reference"), F.col("_marker"))
    rows = rows.withColumn("_s", status)
    abnormal = F.when(F.col("value_text").isNotNull(), worded_abnormal(F.col("parameter"), F.col("value_text"))).otherwise(F.col("_s.abnormal"))
    return rows.withColumns({"abnormal": abnormal, "flag": F.when(F.col("value_text").isNotNull(), F.when(abnormal, "*")).otherwise(F.col("_s.flag"))}).drop("_n", "_w", "_r", "_s", "_marker")


def pipe_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows 'name | value | [flag] | unit | range': the flag may have a cell, follow the value, or leave a cell empty."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.withColumn("_c", cells).where(F.size("_c") >= 3)
    c = lambda i: F.coalesce(F.get("_c", F.lit(i)), F.lit(""))
    flagged = c(2).isin("*", "**", "***", "!", "H", "L")
    star = c(1).rlike(r"\*+$")
    shift = F.when(flagged | ((c(2) == "") & (F.size("_c") >= 5)), 1).otherwise(0)
    unit = F.when(shift == 1, c(3)).otherwise(c(2))
    reference = F.when(shift == 1, c(4)).otherwise(c(3))
    rows = rows.withColumns({"parameter": c(0), "value": italian_number(F.regexp_replace(c(1), r"\*+$", "")), "unit": normal_unit(unit), "reference": reference}).where("value is not null and parameter != ''")
    rows = rows.withColumn("_r", reference_range(F.col("reference")))
    status = out_of_range(F.col("value"), F.col("_r.low"), F.col("_r.high"), F.col("reference"), F.when(flagged, c(2)).when(star, "*"))
    return rows.withColumn("_s", status).select(*lines.columns, "parameter", "value", "unit", "reference", F.col("_r.low").alias("low"), F.col("_r.high").alias("high"), F.col("_s.abnormal").alias("abnormal"), F.col("_s.flag").alias("flag"))


def with_specimen(lines: DataFrame, document: str, number: str = "line_no", line: str = "line") -> DataFrame:
    """Add specimen: the material of the latest section heading; the default material resets it to null."""
    t = F.lower(F.trim(line))
    said = F.lit(None).cast("string")
    for stem, material in MATERIALS.items():
        said = F.coalesce(said, F.when(F.contains(t, F.lit(stem)), material))
    heading = F.when((F.length(t) <= 60) & ~F.contains(t, F.lit(":")) & ~t.rlike(r"\d"), said).otherwise(F.when(t.startswith("materiale:"), said))
    w = Window.partitionBy(document).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("specimen", F.nullif(F.last(heading, ignorenulls=True).over(w), F.lit("")))


def document_specimen(lines: DataFrame, document: str, line: str = "line") -> DataFrame:
    """The one material that all 'Materiale:' lines of a document name, unless it is the default or mixed with it."""
    t = F.lower(F.trim(line))
    said = F.lit(None).cast("string")
    for stem, material in MATERIALS.items():
        said = F.coalesce(said, F.when(F.contains(t, F.lit(stem)), material))
    named = lines.where(t.startswith("materiale:")).groupBy(document).agg(F.collect_set(said).alias("_m"))
    return named.select(document, F.when((F.size("_m") == 1) & (F.get("_m", F.lit(0)) != ""), F.get("_m", F.lit(0))).alias("specimen"))


def best_copies(results: DataFrame, document: str, order: str) -> DataFrame:
    """One of equal results (name, value, text, unit) of a document: best described, first on ties."""
    score = F.when(F.coalesce("unit", F.lit("")) != "", 0.2).otherwise(0.0) + F.when(F.col("low").isNotNull() | F.col("high").isNotNull(), 0.3).otherwise(0.0)
    w = Window.partitionBy(document, "parameter", "value", "value_text", "unit").orderBy(F.desc("_q"), order)
    return results.withColumn("_q", score).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_q", "_n")


def without_restated(narrative: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Narrative findings that no parsed result restates: same keys; date, value and unit count where both sides have them."""
    n, r = narrative.alias("n"), results.alias("r")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    either = lambda c, test: F.col(f"n.{c}").isNull() | F.col(f"r.{c}").isNull() | test
    close = F.abs(F.col("n.value") - F.col("r.value")) <= 1e-6 * F.greatest(F.abs("n.value"), F.abs("r.value"))
    conditions = [*same, either("day", F.col("n.day") == F.col("r.day")), either("value", close), either("unit", F.col("n.unit") == F.col("r.unit"))]
    cond = conditions[0]
    for c in conditions[1:]:
        cond = cond & c
    return n.join(r, cond, "left_anti")
