"""Laboratory results out of tables and text: what a column holds is read from its header, whatever the layout.

Cells are rows (table, row, column, text), so a table of any size is a few groupings and
joins by table. A table whose header names no analyte or no value column is a page's
layout and gives nothing; text_results() is for such text: result lines with or without
a colon and blocks of pipe rows, with the page and specimen in force where they stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import italian_number, reference_range
from tessera.functions.text import computed, let
from tessera.operators.labs import normal_parameter, normal_unit, out_of_range, pipe_rows, with_specimen, worded_abnormal

#: Parts of header names by what the column holds; the first that fits a header counts.
ROLES = {"parameter": ["parametro", "esame", "analita", "test", "parameter"], "value": ["valore", "risultato", "value", "result"], "unit": ["unità", "unita", "unit", "u.m."], "reference": ["range", "riferimento", "intervallo", "ref"]}
#: Results in words, and those with another canonical form.
WORDED = r"(?i)^\s*(?:NEGATIVO|POSITIVO|DEBOLE\s*POSITIVO|DEBOLMENTE\s*POSITIVO|ASSENTE|PRESENTE|NON\s*RILEVABILE|RILEVABILE|NELLA\s*NORMA|ALTERATO|SCARSI|NUMEROSI|RARI|DEBOLE|FORTEMENTE\s*POSITIVO|NEGATIVITA|POSITIVITA)\s*$"
CANONICAL = {"DEBOLMENTE POSITIVO": "DEBOLE POSITIVO", "NEGATIVITA": "NEGATIVO", "POSITIVITA": "POSITIVO"}
#: What no analyte's name holds, what an analyte's name may hold, and units that make a name an analyte.
NO_ANALYTE = [
    "referto", "richiesta", "pagina", "pag.", "data nascita", "data di nascita", "età", "telefono", "cellulare", "fax", "codice fiscale", "materiale", "risultati validati", "dott.", "dott.ssa", "ai sensi", "ogni informazione",
    "centro prelievi", "laboratorio", "legenda", "valido dal", "lod", "limite di rilevabilità", "direttore",
]
ANALYTES = [
    "globuli", "leucocit", "eritrocit", "emoglobina", "hgb", "hct", "mcv", "mch", "mchc", "rdw", "plt", "piastrin", "eritroblast", "neutrofil", "linfocit", "monocit", "eosinofil", "basofil", "glucos", "glicem", "urea", "azotem", "creatinin",
    "egfr", "filtr", "bilirubin", "sodio", "potassio", "cloro", "calcio", "fosforo", "magnesio", "ferro", "ferritin", "transferrin", "proteine", "albumin", "globuline", "ast", "alt", "got", "gpt", "ggt", "ldh", "cpk", " ck", "amilasi",
    "lipasi", "isoamilasi", "pcr", "procalciton", "pct", "troponin", "pt ", "pt(", "inr", "aptt", "ptt", "fibrinogeno", "d-dimero", "tsh", "ft3", "ft4", "hba1c", "vitamina", "folati", "cortisolo", "acth", "prolattina", "estradiolo",
    "testosterone", "paratormone", "immunoglobulin", "iga", "igg", "igm", "ige", "hbs", "hbc", "hbe", "hcv", "hiv", "cea", "afp", "psa", "ca 125", "ca125", "ca 19",
]
ANALYTE_UNITS = ["mg/dl", "g/dl", "ng/ml", "ng/l", "pg/ml", "μg/ml", "μg/dl", "u/l", "mmol/l", "μmol/l", "meq/l", "fl", "pg", "%", "mm/h", "/μl", "×10³/μl", "×10⁶/μl", "ml/min", "μu/ml", "pmol/l", "nmol/l", "inr", "ratio"]
#: Fixed values, patterns: numbers, units and references of results, names that are a page's furniture, lines that number a page.
NUMBER = r"[+-]?(?:\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d+)?"
UNIT = (
    r"(?:[x×]\s*10\s*(?:\^|\*\*)?\s*[36]\s*/\s*[µμu]?[lL]|(?:mg|g|ng|pg|µg|μg|ug|mmol|µmol|μmol|umol|mEq|U|UI|IU|µU|μU|uU|mL|ml|L|fL|fl|pmol|nmol|kU)"
    r"\s*/\s*(?:dL|dl|mL|ml|L|l|µL|μL|uL|min|24h)|/[\s]*(?:µL|μL|uL|mm3)|%|fL|fl|pg|INR|Ratio|mm/h|mm3|m²)"
)
REFERENCE = rf"(?:{NUMBER}\s*[-–]\s*{NUMBER}|[<>]=?\s*{NUMBER})"
WORDS = r"(?:NEGATIVO|POSITIVO|DEBOLE\s*POSITIVO|DEBOLMENTE\s*POSITIVO|FORTEMENTE\s*POSITIVO|ASSENTE|PRESENTE|NON\s*RILEVABILE|RILEVABILE|NELLA\s*NORMA|ALTERATO|SCARSI|NUMEROSI|RARI|DEBOLE|NEGATIVITA|POSITIVITA)"
NUMERIC_RESULT = rf"(?iuU)^\s*([<>]=?)?\s*({NUMBER})\s*(\*{{1,3}}|!|H|L|↑|↓)?\s*({UNIT})?\s*(?:\(?\s*({REFERENCE})\s*\)?)?(?:\s+.*)?$"
WORDED_RESULT = rf"(?iuU)^\s*({WORDS})\s*(\*{{1,3}}|!|H|L|↑|↓)?\s*(?:({UNIT})\s*)?(?:\(?\s*({REFERENCE})\s*\)?)?(?:\s+.*)?$"
WITHOUT_COLON = rf"(?iuU)^\s*([A-Za-zÀ-ÿΑ-ωµμ][^\n:]{{1,100}}?)\s+((?:[<>]=?\s*)?(?:{NUMBER}|{WORDS}).*)$"
PAGE_LINE = r"(?i)(?:---\s*)?(?:PAGINA|\[PAGINA)\s*:?\s*(\d+)"
FURNITURE = [r"(?i)^coordinatrice", r"\d[\d.,]*\s+[-–]\s+\d", r"(?:^|[\s(])[-–]\s*\d", r"^\(?\s*\d[\d\s]{2,}\s+[-–]", r"in\s+data[\s_:]*\d", r"(?i)^ingresso[\s_]*\d"]


def role_of(header: Column) -> Column:
    """What a column with this header holds, or null."""
    text = F.lower(F.coalesce(header, F.lit("")))
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts]), role) for role, parts in ROLES.items()])


def plausible_analyte(name: Column, unit: Column) -> Column:
    """True for a name of at most 100 characters with a letter that holds nothing administrative and is known as an analyte's, or has an analyte's unit."""

    def judged(row: Column) -> Column:
        has = lambda parts: reduce(lambda a, b: a | b, [F.contains(row["low"], F.lit(p)) for p in parts])
        formed = F.length(row["name"]).between(1, 100) & row["name"].rlike("[A-Za-zÀ-ÿΑ-ω]")
        furniture = reduce(lambda a, b: a | b, [row["name"].rlike(p) for p in FURNITURE])
        return formed & ~furniture & ~has(NO_ANALYTE) & (has(ANALYTES) | F.lower(F.translate(row["unit"], "µ", "μ")).isin(ANALYTE_UNITS))

    bare = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\[\d+\]\s*", ""))
    return let(bare, lambda x: let(F.struct(x.alias("name"), F.lower(x).alias("low"), F.coalesce(unit, F.lit("")).alias("unit")), judged))


def worded_result(text: Column) -> Column:
    """The canonical form of a result in words, null for other text."""
    said = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    table = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return F.when(text.rlike(WORDED), F.coalesce(F.try_element_at(table, said), said))


def counted_value(text: Column, unit: Column) -> Column:
    """The number of a result; for cells a microlitre a dot before three digits is a thousands mark."""
    thousands = (unit == "/μL") & F.trim(text).rlike(r"^\d{1,3}\.\d{3}$")
    return F.when(thousands, F.replace(F.trim(text), F.lit("."), F.lit("")).try_cast("double")).otherwise(italian_number(text))


def table_results(cells: DataFrame, table: list[str], row: str, column: str, text: str, material: Column | None = None) -> DataFrame:
    """table, row, parameter, name, value, value_text, unit, low, high, abnormal, flag: one row for each result.

    ``cells`` has one row for each cell; row 0 is the header. Of several columns with one
    role the last counts. Rows without an analyte or a value, with 'nan' in either, with
    no plausible analyte or a value that is neither a number nor a result in words are
    left out, as are tables of one column or without both roles. ``material`` names the
    specimen. Cells are unique by table, row and column; a null cell is empty.
    """
    cell = F.trim(F.coalesce(F.col(text), F.lit("")))
    given = cells.select(*table, row, column, cell.alias("_cell"))
    head = given.where(F.col(row) == 0).withColumn("_role", role_of(F.col("_cell")))
    wide = head.groupBy(*table).agg(F.count("*").alias("_columns"), *[F.max(F.when(F.col("_role") == role, F.col(column))).alias(f"_{role}") for role in ROLES])
    wide = wide.where("_columns >= 2 and _parameter is not null and _value is not null").drop("_columns")
    at = lambda role: F.coalesce(F.max(F.when(F.col(column) == F.col(f"_{role}"), F.col("_cell"))), F.lit("")).alias(role)
    rows = given.where(F.col(row) > 0).join(wide, table).groupBy(*table, row).agg(*[at(role) for role in ROLES])
    rows = rows.where("parameter != '' and value != '' and lower(parameter) != 'nan' and lower(value) != 'nan'").withColumnRenamed("value", "_said").withColumn("unit", normal_unit(F.col("unit")))
    rows = rows.where(plausible_analyte(F.col("parameter"), F.col("unit"))).withColumn("value_text", worded_result(F.col("_said")))
    rows = rows.withColumn("value", F.when(F.col("value_text").isNull(), counted_value(F.col("_said"), F.col("unit")))).where("value is not null or value_text is not null")
    span = reference_range(F.regexp_replace(F.col("reference"), r"^[\s()\[\]]+|[\s()\[\]]+$", ""))
    rows = rows.withColumn("_r", F.when(F.col("value_text").isNull(), span))
    rows = rows.withColumn("_s", out_of_range(F.col("value"), F.col("_r.low"), F.col("_r.high"), F.col("reference"), F.lit(None).cast("string")))
    worded = worded_abnormal(F.col("parameter"), F.col("value_text"))
    name = normal_parameter(F.col("parameter"), F.col("unit"), F.lit(None).cast("string") if material is None else material)
    in_words = F.col("value_text").isNotNull()
    return rows.select(
        *table, row, "parameter", name.alias("name"), "value", "value_text", "unit", F.col("_r.low").alias("low"), F.col("_r.high").alias("high"),
        F.when(in_words, worded).otherwise(F.col("_s.abnormal")).alias("abnormal"), F.when(in_words, F.when(worded, "*")).otherwise(F.col("_s.flag")).alias("flag"),
    )


def text_results(lines: DataFrame, document: str, number: str = "line_no", line: str = "line") -> DataFrame:
    """document, number, page, specimen, parameter, name, value, value_text, operator, unit, low, high, abnormal, flag, confidence: the results that lines state.

    A result line is 'name: result' or 'name result', where a result is a number or words
    with an optional flag, unit and reference; a pipe row counts if another stands next to
    it. The page is the latest page line's, the specimen the latest section heading's. A
    line that is no plausible analyte's is left out; null lines are empty; lines are
    unique by document and number.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    order = Window.partitionBy(document).orderBy(number)
    rows = lines.select(document, number, text.alias("_line"))
    rows = with_specimen(rows, document, number, "_line")
    page = F.regexp_extract("_line", PAGE_LINE, 1).try_cast("int")
    rows = rows.withColumns({"_page": page, "_pipe": F.ltrim("_line").startswith("|")})
    beside = F.coalesce(F.lag("_pipe").over(order), F.lit(False)) | F.coalesce(F.lead("_pipe").over(order), F.lit(False))
    rows = rows.withColumns({"page": F.last("_page", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_block": F.col("_pipe") & beside}).where("_page is null")

    bare = F.trim(F.regexp_replace(F.trim("_line"), r"^\[\d+\]\s*", ""))
    plain = computed(rows.where("not _pipe"), {"_bare": bare})
    plain = computed(plain, {"_colon": F.instr("_bare", ":")})
    part = lambda i: F.when(F.col("_colon") == 0, F.regexp_extract("_bare", WITHOUT_COLON, i))
    name = F.coalesce(part(1), F.substring("_bare", F.lit(1), F.col("_colon") - 1))
    said = F.coalesce(part(2), F.substring("_bare", F.col("_colon") + 1, F.length("_bare")))
    plain = computed(plain, {"parameter": F.regexp_replace(F.regexp_replace(name, r"\s+", " "), "^[ -]+|[ -]+$", "")}).where("parameter != ''")
    plain = computed(plain, {"_said": said})
    plain = computed(plain, {"_numeric": F.col("_said").rlike(NUMERIC_RESULT)})
    plain = plain.where(F.col("_numeric") | F.col("_said").rlike(WORDED_RESULT))
    got = lambda n, w: F.trim(F.when(F.col("_numeric"), F.regexp_extract("_said", NUMERIC_RESULT, n)).otherwise(F.regexp_extract("_said", WORDED_RESULT, w)))
    plain = computed(plain, {"_unit": got(4, 3), "_reference": got(5, 4), "_flag": F.upper(got(3, 2)), "operator": F.nullif(F.when(F.col("_numeric"), F.regexp_extract("_said", NUMERIC_RESULT, 1)), F.lit(""))})
    plain = computed(plain, {"unit": normal_unit(F.col("_unit"))})
    plain = plain.where(plausible_analyte(F.col("parameter"), F.col("unit")))
    result = F.when(F.col("_numeric"), F.regexp_extract("_said", NUMERIC_RESULT, 2)).otherwise(F.regexp_extract("_said", WORDED_RESULT, 1))
    plain = computed(plain, {"_result": result})
    plain = computed(plain, {"value": F.when(F.col("_numeric"), counted_value(F.col("_result"), F.col("unit"))), "value_text": F.when(~F.col("_numeric"), worded_result(F.col("_result")))})
    plain = plain.where("value is not null or value_text is not null").withColumn("_r", F.when(F.col("_numeric"), reference_range(F.col("_reference"))))
    status = out_of_range(F.col("value"), F.col("_r.low"), F.col("_r.high"), F.col("_reference"), F.col("_flag"))
    marked = F.when(F.col("_flag").isin("H", "↑"), "H").when(F.col("_flag").isin("L", "↓"), "L").when(F.col("_flag") != "", "*")
    flag = F.when(F.col("_numeric"), status["flag"]).otherwise(F.coalesce(marked, F.when(worded_abnormal(F.col("parameter"), F.col("value_text")), "*")))
    plain = plain.withColumn("flag", flag).select(document, number, "page", "specimen", "parameter", "value", "value_text", "operator", "unit", F.col("_r.low").alias("low"), F.col("_r.high").alias("high"), "flag", F.when(F.col("_reference") != "", 0.98).otherwise(0.92).alias("confidence"))

    piped = pipe_rows(rows.where("_block"), "_line").where(plausible_analyte(F.col("parameter"), F.col("unit")))
    none = F.lit(None).cast("string")
    piped = piped.select(document, number, "page", "specimen", "parameter", "value", none.alias("value_text"), none.alias("operator"), "unit", "low", "high", "flag", F.lit(0.9).alias("confidence"))
    both = plain.unionByName(piped)
    return both.select(document, number, "page", "specimen", "parameter", normal_parameter(F.col("parameter"), F.col("unit"), F.col("specimen")).alias("name"), "value", "value_text", "operator", "unit", "low", "high", F.col("flag").isNotNull().alias("abnormal"), "flag", "confidence")
