"""Cleaning of clinical reports: furniture, personal data and repeated lines go, clinical prose stays.

Ten phases in order, each also a function of its own. Most are column expressions over
the text. Sections are skipped by a two-state automaton over lines: every line is a map
of the states (a blank line or another heading leads to keeping, a section heading
toggles, other lines change nothing), maps compose, so the state before a line is the
parity of the section headings since the last line that fixes it: a running sum and its value there. What
labels take away of the lines above them is a stack whose depth is a running sum less
its running minimum. Both are windows, so no line waits for a loop over the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.texts import let, without_repeated_lines

#: What the phases look for. Patterns are given with their flags: i for any case, m for each line by itself.
BLOCK_STARTS = [r"dati\s+anagrafici\s+del\s+paziente", r"dati\s+anagrafici", r"prestazioni\s+erogate", r"richiedenti"]
LABELS = [
    "nome e cognome", "cognome e nome", "luogo e data di nascita", "data di nascita", "indirizzo", "telefono", "sesso", "codice fiscale", "codice u.o.", "data/ora accettazione",
    "ente", "ospedale", "reparto/ambulatorio", "medico", "unità operativa", "unita operativa",
]
ORPHANS = [
    "provenienza", "richiedenti", "ente", "ospedale", "reparto/ambulatorio", "reparto", "medico", "unità operativa", "unita operativa", "day service oncologia", "nosologico", "codice fiscale", "nr figlia", "mmg",
    "diagnosi di ingresso", "diagnosi di dimissione", "data/ora accettazione", "copia informatica del referto", "professore", "dott.", "dott.ssa", "day service oncologia clinica", "amb. oncologia terapie", "dh oncologico",
    ")", "(>)", ">", "m", "f",
]
ORPHAN_LINES = [(r"^[A-Z]\d{6,10}$", "i"), (r"^(?:nr\s+figlia|mmg|medico\s+curante)\b", "i")]
DEPARTMENTS = [r"UO\s+[\w\s./]+", r"DIP\.\s+[\w\s./]+", r"U\.O\.\s+[\w\s./]+", r"UNITÀ\s+OPERATIVA\s+[\w\s./]+", r"DAY\s+SERVICE\s+[\w\s./()-]+", r"AMB\.\s+[\w\s./()-]+", r"AMBULATORIO\s+[\w\s./()-]+"]
DOCTOR = (r"(?:Prof\.|Prof\.ssa|Dott\.|Dott\.ssa|Dr\.|Dr\.ssa)\s+[A-ZÀ-Ü]{2,}(?:\s+[A-ZÀ-Ü]{2,}){0,3}", "i")
REMOVED = [
    (r"\[MEDICO\]\s*\.?(?:ssa|Prof\.|Dott\.)?\s*[A-ZÀ-Ü]{2,}(?:\s+[A-ZÀ-Ü]{2,}){0,3}\s*'?\s*", ""),
    (r"\b(?:Prof\.|Prof\.ssa|Dott\.|Dott\.ssa|Dr\.|Dr\.ssa)\s+[A-ZÀ-Ü]{2,}(?:\s+[A-ZÀ-Ü]{2,}){0,3}", "i"),
    (r"^\s*(?:##\s*)?(?:Medico\s+in\s+Formazione|Dirigente\s+Medico|Medico\s+Specializzando|Medico\s+Curante|Medico\s+Responsabile|Specializzando|Medico\s+Radiologo|Medico\s+Oncologo)\s*$", "im"),
    (r"^\s*(?:PIEVE\s+DI\s*\w*|FRACTION\s+OF\s*\w*)\s*$", "im"),
    (r"^\s*[-–]\s*\d{5}\s+[A-ZÀ-Ü\s]+\s*\(?\s*[A-Z]{2}\s*\)?\s*$", "m"),
    (r"^\s*PROVENIENZA\s*:?\s*.*$", "im"),
    (r"^\s*(?:DAY\s+)?SERVICE\s+\w+\s*$", "im"),
    (r"_{3,}", ""),
    (r"^([A-ZÀ-Ü]{2,}(?:\s+[A-ZÀ-Ü]{2,}){1,4})\s+(?:NOME\s+E\s+COGNOME|COGNOME\s+E\s+NOME|LUOGO\s+E\s+DATA\s+DI\s+NASCITA|DATA\s+DI\s+NASCITA)\s*$", "m"),
    (r"^[A-ZÀ-Ü\s]+\s+\[NATO\]\s+LUOGO\s+E\s+DATA\s+DI\s+NASCITA\s*$", "im"),
    (r"^[A-ZÀ-Ü]{3,}\s*\([A-Z]{2}\)\s*$", "m"),
    (r"^\s*(?:Documento\s+provvisto\s+di|documento\s+informatico|documento\s+firmato\s+digitalmente|documento\s+riservato).*$", "im"),
    (r"(?:ai\s+sensi\s+(?:dell|del)|codice\s+dell.amministrazione\s+digitale|firma\s+digitale|firmato\s+digitalmente).*$", "im"),
    (r"^\s*REFERTO\s*$", "m"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", ""),
    (r"^\s*(?:Via|Piazza|Viale|Corso|Strada|Località|Contrada)\s+[\w\s,()/-]+?\d+.*$", "im"),
    (r"^\s*(?:Via|Piazza|Viale)\s+[\w\s,()/-]+?\d{5}\s+[\w\s()]+$", "im"),
    (r"Pag\.:\s*\d+\s*/\s*\d+", "i"),
    (r"^\s*(?:Azienda\s+Ospedaliero[-\s]Universitaria|Azienda\s+Ospedaliera|Arcispedale|Ospedale|Policlinico|Istituto\s+Clinico)\s+[\w\s'-]+$", "im"),
    (r"^\s*##\s*SERVIZIO\s+SANITARIO\s+(?:REGIONALE|NAZIONALE)\s+[\w\s'-]+\s*$", "im"),
    (r"^\s*SERVIZIO\s+SANITARIO\s+(?:REGIONALE|NAZIONALE)\s+[\w\s'-]+\s*$", "im"),
    (r"^\s*(?:PROVENIENZA|PROVENIENZA:?)\s*(?:DAY\s+SERVICE|AMBULATORIO|REPARTO|DH)?\s*[\w\s./()-]*$", "im"),
    (r"\[\[?\s*(?:PAZIENTE|NATO|MEDICO|INDIRIZZO|CF|TEL)\s*\]?\]", ""),
    (r"^\s*##\s*DATI\s*(?:NOME\s+E\s+COGNOME|ANAGRAFICI)?\s*$", "m"),
    (r"^\s*(?:NOME\s+E\s+COGNOME|COGNOME\s+E\s+NOME|LUOGO\s+E\s+DATA\s+DI\s+NASCITA)\s*$", "m"),
    (r"\[(?:NATO|INDIRIZZO|CF|TEL|PAZIENTE|MEDICO)\]\s*\d{1,2}:\d{2}(?::\d{2})?\s*", ""),
    (r"^\s*\[(?:NATO|INDIRIZZO|CF|TEL|PAZIENTE|MEDICO)\]\s*$", "m"),
    (r"referto\s+del\s+\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\s+delle\s+ore\s+\d{1,2}:\d{2}:\d{2}", "i"),
    (r"^\s*(?:VISITA\s+(?:ONCOLOGICA|OCULISTICA|SPECIALISTICA|DERMATOLOGICA|CARDIOLOGICA|ORTOPEDICA|NEUROLOGICA|DI\s+CONTROLLO)\s*(?:DI\s+CONTROLLO)?|MEDICAZIONE\s+USTIONI)\s*$", "im"),
    (r"^\s*##\s*REFERTO\s*$", "im"),
    (r"\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?", ""),
    (r"\[INDIRIZZO\]\s*/\d+\s*[-–]\s*\d{5}\s*[A-ZÀ-Ü\s]+\s*\(?\s*[A-Z]{2}\s*\)?\s*", ""),
    (r"\[INDIRIZZO\]\s*[-–]\s*\d{5}\s*[A-ZÀ-Ü\s]+\s*\(?\s*[A-Z]{2}\s*\)?\s*", ""),
    (r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", ""),
    (r"\b\d{9,11}\b", ""),
    (r"\b[A-Z]{2}-\d{2}\s*\(?\d+\)?\b", ""),
    (r"\b\d{10}\b", ""),
    (r"copia\s+informatica\s+del\s+referto.*?(?:\n|$)", "i"),
    (r"<!--\s*image\s*-->", ""),
    (r"^\s*(?:UO|U\.O\.|DIP\.|UNITÀ\s+OPERATIVA)\s+[\w\s./()-]+$", "im"),
    (r"arcispedale\s+s\.?\s*anna.*?(?:\n|$)", "i"),
    (r"dipartimento\s+ad\s+attività\s+integrata.*?(?:\n|$)", "i"),
    (r"(?:firma|firmato)\s*(?:digitalmente|elettronicamente|il\s+medico)?.*?(?:\n|$)", "i"),
    (r"(?:documento\s+riservato|informazioni\s+riservate|riservato\s+agli\s+operatori).*?(?:\n|$)", "i"),
    (r"(?:regolamento\s+(?:ue|europeo)\s+\d+/\d+|gdpr|trattamento\s+dei\s+dati).*?(?:\n|$)", "i"),
    (r"^\s*##\s*$", "m"),
    (r"^\s*##\s*DATI\s*$", "m"),
]
PATIENT_DATA = [
    (r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", "", "[CF]"),
    (r"\b\d{9,11}\b", "", "[TEL]"),
    (r"via\s+\w[\w\s,]*?\d+.*?(?:\d{5}|\(?\s*[A-Z]{2}\s*\)?)?", "i", "[INDIRIZZO]"),
    (r"\b[A-ZÀ-Ü]{3,}\s*,?\s*\d{1,2}\.\d{1,2}\.\d{4}\b", "", "[NATO]"),
    (r"\b[A-ZÀ-Ü]{4,}\s*(?=,\s*\d{1,2}\.\d{1,2}\.\d{4})", "", "[CITTÀ]"),
]
RESIDUES = [
    (r"\[(?:NATO|INDIRIZZO|CF|TEL)\]\s*\d{1,2}:\d{2}(?::\d{2})?\s*", ""),
    (r"\[INDIRIZZO\]\s*(?:/\d+\s*)?[-–]\s*\d{5}\s*[A-ZÀ-Ü\s]+\s*\(?\s*[A-Z]{2}\s*\)?\s*", ""),
    (r"^\s*\[(?:NATO|INDIRIZZO|CF|TEL|PAZIENTE|MEDICO)\]\s*$", "m"),
    (r"^\s*[-–]\s*\d{5}\s+[A-ZÀ-Ü\s]+\s*\(?\s*[A-Z]{2}\s*\)?\s*$", "m"),
    (r"^\s*(?:PIEVE\s+DI\s*\w*)\s*$", "im"),
    (r"^\s*PROVENIENZA\s*:?\s*.*$", "im"),
    (r"^\s*(?:DAY\s+)?SERVICE\s+\w+\s*$", "im"),
    (r"^\s*##\s*DATI\s*(?:NOME\s+E\s+COGNOME|ANAGRAFICI)?\s*$", "m"),
    (r"^\s*##\s*(?:Medico|Dirigente|Specializzando)\s+.*$", "im"),
]
#: For the patterns of REMOVED and RESIDUES in their order: no text without one of these (in the pattern's case, or folded where the pattern takes any case) can match; none given: always tried.
REMOVED_NEED = [
    ["[MEDICO]"], ["prof.", "dott.", "dr."], ["medico", "dirigente", "specializzando"], ["pieve", "fraction"], ["-", "–"], ["provenienza"], ["service"], ["___"], ["COGNOME", "NASCITA"], ["[nato]"],
    ["("], ["documento"], ["sensi", "codice", "firma"], ["REFERTO"], ["@"], ["via", "piazza", "corso", "strada", "localit", "contrada"], ["via", "piazza"], ["pag.:"], ["aziend", "spedal", "policlinico", "istituto"],
    ["servizio"], ["servizio"], ["provenienza"], ["PAZIENTE", "NATO", "MEDICO", "INDIRIZZO", "CF", "TEL"], ["DATI"], ["COGNOME", "NASCITA"], ["["], ["["], ["referto"], ["visita", "medicazione"], ["referto"],
    [":"], ["[INDIRIZZO]"], ["[INDIRIZZO]"], [], [], ["-"], [], ["informatica"], ["<!--"], ["uo", "u.o.", "dip.", "unit"], ["arcispedale"], ["dipartimento"], ["firma"], ["riservat"], ["regolamento", "gdpr", "trattamento"],
    ["##"], ["DATI"],
]
RESIDUES_NEED = [["["], ["[INDIRIZZO]"], ["["], ["-", "–"], ["pieve"], ["provenienza"], ["service"], ["DATI"], ["medico", "dirigente", "specializzando"]]
NAME_LABEL = r"\b(?:NOME\s+E\s+COGNOME|COGNOME\s+E\s+NOME)\b"
NO_NAME = [
    "NOME", "COGNOME", "LUOGO", "DATA", "NASCITA", "SESSO", "CODICE", "FISCALE", "REPARTO", "AMBULATORIO", "UNITA", "UNITÀ", "OPERATIVA", "DAY", "SERVICE", "OSPEDALE", "AZIENDA", "SANITARIA", "DATI", "ANAGRAFICI", "PRESTAZIONI",
    "EROGATE", "REFERTO", "MEDICO", "DIRETTORE", "ONCOLOGIA", "CARDIOLOGIA", "NEUROLOGIA", "RADIOLOGIA", "LABORATORIO",
]
NO_PERSON = [
    "OSPEDALE", "OSPEDALIERO", "AZIENDA", "UNITA", "OPERATIVA", "COMPLESSA", "PATOLOGIA", "CLINICA", "DAY", "SERVICE", "AMBULATORIO", "REPARTO", "DIPARTIMENTO", "DIREZIONE", "DIAGNOSTICA", "LABORATORIO", "ANALISI", "TERAPIA",
    "ONCOLOGIA", "CHIRURGIA", "MEDICINA", "RADIOLOGIA", "FERRARA", "ARGENTA", "BOLOGNA", "MILANO", "ROMA", "TORINO", "REFERTO", "DATI", "ANAGRAFICI", "RICHIEDENTI", "ACCETTAZIONE", "ROUTINE", "URGENTE", "LEGENDA", "ESEGUITE", "GLOBULI",
    "EMOCROMO", "BIANCHI", "ROSSI", "FRAZIONATA", "DIRETTA", "TOTALE", "SESSO", "TELEFONO", "INDIRIZZO", "CODICE", "FISCALE", "NOME", "COGNOME", "LUOGO", "NASCITA", "DATA",
]


def _pattern(pattern: str, flags: str = "") -> str:
    """Letters, digits and spaces of any alphabet; only \\n ends a line."""
    return f"(?{flags}duU){pattern}"


def _stripped(line: Column) -> Column:
    """``line`` is a column or a variable: it is named more than once. Only lines that begin or end with white space are searched for it."""
    ends = F.concat(F.substring(line, 1, 1), F.substring(line, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(line, r"(?U)^\s+|\s+$", "")).otherwise(line)


def _folded(text: Column) -> Column:
    """Letters as patterns of any case compare them: the four letters beyond ASCII that equal one of it (ſ, ı, K, İ) become that one."""
    return F.lower(reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), ["İi", "ſs", "ıi"], text))


def _without(text: Column, patterns: list[tuple[str, str]], needs: list[list[str]] | None = None) -> Column:
    """The text without what the patterns match, one after another; a pattern is tried only where the text, as it then is, holds what a match needs."""
    if needs is None:
        return reduce(lambda t, p: F.regexp_replace(t, _pattern(*p), ""), patterns, text)
    both = lambda x: F.struct(x.alias("t"), _folded(x).alias("f"))
    steps = [F.struct(F.lit(_pattern(*p)).alias("pattern"), F.lit("i" in p[1]).alias("folds"), F.array(*[F.lit(n) for n in need]).cast("array<string>").alias("needs")) for p, need in zip(patterns, needs, strict=True)]

    def drop(now: Column, step: Column) -> Column:
        # a text that a pattern leaves alone is not folded again
        tried = let(F.regexp_replace(now["t"], step["pattern"], F.lit("")), lambda x: F.when(x == now["t"], now).otherwise(both(x)))
        among = F.when(step["folds"], now["f"]).otherwise(now["t"])
        return F.when((F.size(step["needs"]) == 0) | F.exists(step["needs"], lambda n: among.contains(n)), tried).otherwise(now)

    return F.aggregate(F.array(*steps), let(text, both), drop)["t"]


def without_patterns(text: Column) -> Column:
    """Phase 1: time stamps, codes, addresses, signatures and the like."""
    return _without(text, REMOVED, REMOVED_NEED)


def _kept_lines(text: Column, keep) -> Column:
    """The lines for which keep(lines, line, place) holds."""
    return let(F.split(text, "\n"), lambda rows: F.array_join(F.filter(rows, lambda line, i: keep(rows, line, i)), "\n"))


def without_departments(text: Column) -> Column:
    """Phase 2: lines that name a department, begin with ')' or are a bare '##'."""
    named = _pattern(rf"^(?:{'|'.join(DEPARTMENTS)})$", "i")

    def keep(rows: Column, line: Column, i: Column) -> Column:
        bare = _stripped(line)
        return ~(bare.rlike(named) | bare.startswith(")") | (bare == "##"))

    return _kept_lines(text, keep)


def without_doctors(text: Column) -> Column:
    """Phases 2 and 7: titled names in capitals become [MEDICO]."""
    return F.regexp_replace(text, _pattern(*DOCTOR), "[MEDICO]")


def _as_name(value: Column) -> Column:
    """The value if it reads like a name of two to six words beside a label, else null."""
    bare = F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), r"^[ :|-]+|[ :|-]+$", "")
    shaped = bare.rlike(r"^[A-Za-zÀ-ÖØ-öø-ÿ'’-]{2,}(?: [A-Za-zÀ-ÖØ-öø-ÿ'’-]{2,}){1,5}$")
    words = F.transform(F.split(F.upper(bare), " "), lambda w: F.regexp_replace(w, "^['’-]+|['’-]+$", ""))
    return F.when(shaped & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in NO_NAME])), bare)


def _beside_label(text: Column) -> Column:
    """The first name on a label's line or up to three lines away, or of two one-word lines next to it."""
    label = _pattern(NAME_LABEL, "i")

    def near(rows: Column, line: Column, i: Column) -> Column:
        after, before = (F.regexp_extract(line, _pattern(rf"^(.*?){NAME_LABEL}(.*)$", "i"), g) for g in (2, 1))
        word = lambda k: F.when(F.get(rows, i + k).rlike(r"^[^ ]+$"), F.get(rows, i + k))
        pairs = [F.concat_ws(" ", word(a), word(b)) for a, b in ((1, 2), (-2, -1))]
        found = F.array(*[_as_name(x) for x in (after, before, *[F.get(rows, i + k) for k in (-1, 1, -2, 2, -3, 3)], *pairs)])
        return F.when(line.rlike(label), F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))

    rows = F.when(_folded(text).contains("cognome"), F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))))
    return let(rows, lambda r: F.get(F.filter(F.transform(r, lambda line, i: near(r, line, i)), lambda x: x.isNotNull()), F.lit(0)))


def _below_heading(text: Column) -> Column:
    """The first line of two or more capital words below the heading of the personal data, before any line in other letters."""
    rest = F.regexp_extract(text, _pattern(r"##\s*DATI\s+ANAGRAFICI[^\n]*\n([\s\S]*)$", "i"), 1)
    rows = F.filter(F.transform(F.split(rest, "\n"), _stripped), lambda x: x != "")
    whole = lambda x: x.rlike(_pattern(r"^[A-ZÀ-Ü]{3,}(?:\s+[A-ZÀ-Ü]{3,})+$"))
    other = lambda x: ~whole(x) & ((F.length(x) < 3) | ~x.rlike(_pattern(r"^[A-ZÀ-Ü\s]+$")))
    first = let(rows, lambda r: F.get(F.filter(F.transform(r, lambda x: F.when(whole(x), x).when(other(x), F.lit(""))), lambda x: x.isNotNull()), F.lit(0)))
    return F.nullif(first, F.lit(""))


def _often_capital(text: Column) -> Column:
    """The commonest run of two capital words, of eight letters or more, that stands twice or more and names no place or ward; the earliest of equally common ones."""
    runs = F.regexp_extract_all(text, F.lit(_pattern(r"\b([A-ZÀ-Ü]{3,}(?:\s+[A-ZÀ-Ü]{3,}){1,3})\b")), F.lit(1))

    def best(each: Column) -> Column:
        counted = F.transform(F.array_distinct(each), lambda x, i: F.struct((-F.size(F.filter(each, lambda y: x == y))).alias("n"), i.alias("i"), x.alias("x")))
        words = lambda x: F.split(F.upper(x), r"(?U)\s+")
        fits = lambda c: (c["n"] <= -2) & (F.length(c["x"]) >= 8) & (F.size(F.array_distinct(words(c["x"]))) == 2) & ~F.arrays_overlap(words(c["x"]), F.array(*[F.lit(w) for w in NO_PERSON]))
        return F.get(F.filter(F.slice(F.array_sort(counted), 1, 20), fits), F.lit(0))["x"]

    return let(runs, best)


def patient_name(text: Column, guess: bool = True) -> Column:
    """The patient's name, or null: beside its label, below the heading of the personal data, above or after a label in running text; else, if ``guess``, a name often written in capitals."""
    text = F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("\r\n"), F.lit("\n"))
    run = r"([A-ZÀ-Ü]{2,}(?:\s+[A-ZÀ-Ü]{2,}){1,4})"
    below = r"\s*\n\s*(?:NOME\s+E\s+COGNOME|COGNOME\s+E\s+NOME)"
    # the first match never begins inside a word, and no word or blank is given back: what follows it is no part of it
    first_run = r"(?<![A-ZÀ-Ü])([A-ZÀ-Ü]{2,}+(?:\s++[A-ZÀ-Ü]{2,}+){1,4})"

    def find(state: Column) -> Column:
        text, folded = state["t"], state["f"]
        said = lambda pattern: let(F.regexp_extract(text, _pattern(pattern, "i"), 1), lambda x: F.nullif(_stripped(x), F.lit("")))
        labelled = lambda test, found: F.when(folded.contains("cognome") & test, found)
        headed = F.when(folded.contains("anagrafici"), _below_heading(text))
        # a run ends right before the line end, so texts without a letter there are not searched for runs
        above = labelled(text.rlike(_pattern(rf"[A-ZÀ-Ü]{below}", "i")), said(rf"{first_run}{below}"))
        found = [_beside_label(text), headed, above, labelled(F.lit(True), said(rf"(?:Cognome\s+e\s+nome)\s*:?\s*{run}"))]
        return F.coalesce(*found, *([_often_capital(text)] if guess else []))

    return let(let(text, lambda x: F.struct(x.alias("t"), _folded(x).alias("f"))), find)


def without_patient(text: Column, name: Column) -> Column:
    """Phase 3: the name, and each of its words of four letters or more, become [PAZIENTE]; a name under five letters is left."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    whole = F.regexp_replace(text, F.concat(F.lit("(?iu)"), quoted(name)), F.lit("[PAZIENTE]"))
    words = F.split(name, r"(?U)\s+")
    parts = F.filter(words, lambda w: (F.length(w) >= 4) & (F.size(words) >= 2))
    each = F.aggregate(parts, whole, lambda t, w: F.regexp_replace(t, F.concat(F.lit(r"(?iuU)\b"), quoted(w), F.lit(r"\b")), F.lit("[PAZIENTE]")))
    return F.when(F.length(name) >= 5, each).otherwise(text)


def without_sections(rows: DataFrame, document: str, number: str = "line_no", line: str = "line") -> DataFrame:
    """Phase 4: lines without boilerplate sections, labels and the values above labels.

    A section begins at a '##' heading of BLOCK_STARTS and ends before a blank line or the
    next '##' heading, whichever that names. A label line goes, and with it the nearest
    line above that is still there, unless that is blank.
    """
    bare = _stripped(F.col(line))
    heading = bare.rlike(r"(?U)^##\s")
    lower = F.lower(bare)
    kind = F.when(bare == "", 1).when(heading & lower.rlike(_pattern("|".join(BLOCK_STARTS))), 2).when(heading, 3).when(lower.isin(LABELS), 4).otherwise(0)
    marked = rows.withColumn("_kind", kind.cast("byte"))
    # every sum is taken over the whole document in one order, and what a part of it began with is subtracted: one sort serves them all
    order = Window.partitionBy(document).orderBy(number)
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda test: F.coalesce(F.sum(test.cast("int")).over(before), F.lit(0))
    blank, start, fixes, label = ((F.col("_kind") == k) for k in (1, 2, 3, 4))
    fixes = blank | fixes
    marked = marked.withColumn("_starts", count(start))
    marked = marked.withColumn("_skips", (F.col("_starts") - F.coalesce(F.last(F.when(fixes, F.col("_starts")), ignorenulls=True).over(before), F.lit(0))) % 2 == 1).drop("_starts")
    kept = marked.where(F.when(F.col("_skips"), fixes | start).otherwise(~start))
    kept = kept.withColumn("_step", F.when(blank, 0).when(label & ~F.col("_skips"), -1).otherwise(1)).drop("_skips", "_kind")

    # runs between blank lines: a number with the run in front and the value behind orders values by run
    step, run, wide = F.col("_step"), F.col("_run"), F.lit(1 << 32)
    kept = kept.withColumns({"_run": count(step == 0), "_sum": F.sum("_step").over(so_far)})
    kept = kept.withColumn("_sum", F.col("_sum") - F.coalesce(F.last(F.when(step == 0, F.col("_sum")), ignorenulls=True).over(before), F.lit(0)))
    least = F.min(F.when(step != 0, F.col("_sum") - run * wide)).over(so_far) + run * wide
    kept = kept.withColumn("_depth", run * wide + F.col("_sum") - F.least(F.lit(0), least)).drop("_sum", "_run")
    after = Window.partitionBy(document).orderBy(F.desc(number)).rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("_later", F.min(F.when(step != 0, F.col("_depth"))).over(after))
    stays = (step == 0) | (step == 1) & (F.coalesce(F.col("_later") >= F.col("_depth"), F.lit(True)))
    return kept.where(stays).select(rows.columns)


def without_label_lines(text: Column) -> Column:
    """Phase 6: label lines and the lines above them, and a sex of one letter below its label with the label."""
    lower = lambda x: F.lower(_stripped(x))
    label = lambda x: F.coalesce(lower(x).isin(LABELS), F.lit(False))
    sex = lambda above, x: F.coalesce((lower(above) == "sesso") & lower(x).isin("m", "f"), F.lit(False))

    def keep(rows: Column, line: Column, i: Column) -> Column:
        below = F.get(rows, i + 1)
        return ~(label(line) | (label(below) & (_stripped(line) != "")) | sex(F.get(rows, i - 1), line) | sex(line, below))

    return _kept_lines(text, keep)


def without_orphans(text: Column) -> Column:
    """Phase 6b: labels left alone, single signs, hospital codes."""

    def keep(rows: Column, line: Column, i: Column) -> Column:
        bare = _stripped(line)
        alone = F.regexp_replace(F.lower(bare), ":+$", "").isin(ORPHANS)
        return ~reduce(lambda a, b: a | b, [bare.rlike(_pattern(*p)) for p in ORPHAN_LINES], alone)

    return _kept_lines(text, keep)


def without_patient_data(text: Column) -> Column:
    """Phase 8: codes, telephone numbers, addresses, places and dates of birth become tags."""
    return reduce(lambda t, p: F.regexp_replace(t, _pattern(p[0], p[1]), p[2]), PATIENT_DATA, text)


def without_residues(text: Column) -> Column:
    """Phase 9: what earlier phases leave of addresses, places and headings."""
    return _without(text, RESIDUES, RESIDUES_NEED)


def whitespace_cleaned(text: Column) -> Column:
    """Phase 10: rules of dashes or underscores go, three or more line ends become two, blanks at ends go."""
    ruled = _without(text, [(r"^_{3,}\s*$", "m"), (r"^\s*-{3,}\s*$", "m")])
    blanks = lambda x: F.regexp_replace(x, r"(?dmU)[\s&&[^\n]]+$", "")
    return let(let(F.regexp_replace(ruled, r"\n{3,}", "\n\n"), lambda x: blanks(_stripped(x))), _stripped)


def cleaned(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, text: every row's text after all phases; key names one row.

    A null or empty text gives an empty text; other columns are dropped; an empty table
    gives an empty result. A text must fit one row; between phases its lines are rows.
    """
    first = F.coalesce(F.col(text), F.lit(""))
    named = df.select(key, without_doctors(without_departments(without_patterns(first))).alias("_text"))
    named = named.withColumn("_name", patient_name(F.col("_text")))
    named = named.select(key, F.coalesce(without_patient(F.col("_text"), F.col("_name")), "_text").alias("_text"))
    rows = named.select(key, F.posexplode(F.split("_text", "\n")).alias("line_no", "line"))
    kept = without_sections(rows, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    joined = df.select(key).join(kept, key, "left").select(key, F.coalesce(F.array_join(F.col("_lines.line"), "\n"), F.lit("")).alias("_text"))
    later = without_orphans(without_label_lines(without_repeated_lines(F.col("_text"))))
    return joined.select(key, whitespace_cleaned(without_residues(without_patient_data(without_doctors(later)))).alias("text"))
