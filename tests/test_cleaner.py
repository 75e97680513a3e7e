"""The report cleaner against a plain version that works line by line, and cases by hand."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import cleaner as c


def compiled(pattern, flags=""):
    return re.compile(pattern, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))


def drop(text, patterns):
    for p in patterns:
        text = compiled(*p).sub("", text)
    return text


def departments(text):
    named = [compiled(p, "i") for p in c.DEPARTMENTS]
    return "\n".join(x for x in text.split("\n") if not (any(p.fullmatch(x.strip()) for p in named) or x.strip().startswith(")") or x.strip() == "##"))


def name_like(value):
    value = re.sub(r"\s+", " ", value).strip(" :-|")
    words = value.split()
    good = 2 <= len(words) <= 6 and all(re.fullmatch(r"[A-Za-zÀ-ÖØ-öø-ÿ'’\-]{2,}", w) for w in words)
    return value if good and not {w.upper().strip("'’-") for w in words} & set(c.NO_NAME) else None


def find_name(text):
    rows = [re.sub(r"\s+", " ", x).strip() for x in text.replace("\r\n", "\n").split("\n")]
    at = lambda i: rows[i] if 0 <= i < len(rows) else ""
    for i, row in enumerate(rows):
        if m := compiled(c.NAME_LABEL, "i").search(row):
            pairs = [f"{at(i + a)} {at(i + b)}" if len(at(i + a).split()) == len(at(i + b).split()) == 1 else "" for a, b in ((1, 2), (-2, -1))]
            for value in (row[m.end() :], row[: m.start()], *[at(i + k) for k in (-1, 1, -2, 2, -3, 3)], *pairs):
                if name_like(value):
                    return name_like(value)
    if m := re.search(r"##\s*DATI\s+ANAGRAFICI.*?\n", text, re.I):
        for row in filter(None, (x.strip() for x in text[m.end() :].split("\n"))):
            if re.fullmatch(r"[A-ZÀ-Ü]{3,}(\s+[A-ZÀ-Ü]{3,})+", row):
                return row
            if len(row) < 3 or not re.fullmatch(r"[A-ZÀ-Ü\s]+", row):
                break
    run = r"([A-ZÀ-Ü]{2,}(?:\s+[A-ZÀ-Ü]{2,}){1,4})"
    for p in (rf"{run}\s*\n\s*(?:NOME\s+E\s+COGNOME|COGNOME\s+E\s+NOME)", rf"(?:Cognome\s+e\s+nome)\s*:?\s*{run}"):
        if m := re.search(p, text, re.I):
            return m[1].strip()
    counts = Counter(re.findall(r"\b([A-ZÀ-Ü]{3,}(?:\s+[A-ZÀ-Ü]{3,}){1,3})\b", text))
    for name, n in counts.most_common(20):
        if n >= 2 and len(name) >= 8 and len(set(name.upper().split())) == 2 and not set(name.upper().split()) & set(c.NO_PERSON):
            return name
    return None


def patient(text):
    name = find_name(text)
    if not name or len(name) < 5:
        return text
    text = re.sub(re.escape(name), "[PAZIENTE]", text, flags=re.I)
    for word in name.split():
        if len(word) >= 4 and len(name.split()) > 1:
            text = re.sub(rf"\b{re.escape(word)}\b", "[PAZIENTE]", text, flags=re.I)
    return text


def sections(text):
    kept, skips = [], False
    for row in text.split("\n"):
        bare = row.strip()
        heading = bool(re.match(r"##\s", bare))
        start = heading and any(re.search(p, bare.lower()) for p in c.BLOCK_STARTS)
        if skips:
            if not bare or heading:
                skips = False
                kept.append(row)
        elif start:
            skips = True
        elif bare.lower() in c.LABELS:
            if kept and kept[-1].strip():
                kept.pop()
        else:
            kept.append(row)
    return "\n".join(kept)


def repeated(text):
    counts = Counter(x.strip() for x in text.split("\n"))
    return "\n".join(x for x in text.split("\n") if not (counts[x.strip()] >= 3 and len(x.strip()) > 2))


def label_lines(text):
    rows, gone = text.split("\n"), set()
    low = [x.strip().lower() for x in rows]
    for i, x in enumerate(low):
        if x in c.LABELS:
            gone |= {i} | ({i - 1} if i and low[i - 1] else set())
        if x in ("m", "f") and i and low[i - 1] == "sesso":
            gone |= {i, i - 1}
    return "\n".join(x for i, x in enumerate(rows) if i not in gone)


def orphans(text):
    return "\n".join(x for x in text.split("\n") if not (x.strip().lower().rstrip(":") in c.ORPHANS or any(compiled(*p).match(x.strip()) for p in c.ORPHAN_LINES)))


def doctors(text):
    return compiled(*c.DOCTOR).sub("[MEDICO]", text)


def data(text):
    for p, flags, tag in c.PATIENT_DATA:
        text = compiled(p, flags).sub(tag, text)
    return text


def space(text):
    text = drop(text, [(r"^_{3,}\s*$", "m"), (r"^\s*-{3,}\s*$", "m")])
    return "\n".join(x.rstrip() for x in re.sub(r"\n{3,}", "\n\n", text).strip().split("\n")).strip()


def plain(text):
    text = patient(doctors(departments(drop(text or "", c.REMOVED))))
    return space(drop(data(doctors(orphans(label_lines(repeated(sections(text)))))), c.RESIDUES))


LINES = [
    "", "", " ", "## DATI ANAGRAFICI DEL PAZIENTE", "##  Prestazioni   erogate", "## Anamnesi", "## Richiedenti", "##", "NOME E COGNOME", "Mario Bianchetti", "ROSSELLA VERDONI", "Sesso", "M", "Codice fiscale:", "Medico", "Ente",
    "UO Oncologia Clinica", "DIP. Medicina", "Dott. MARIO NERI riferisce", "Prof.ssa Sara Saggini", "Paziente in buone condizioni generali.", "Dolore toracico da tre giorni", "ROSSELLA VERDONI torna a controllo", "Via Roma 12, Ferrara",
    "Tel 0532123456", "nato a CENTO, 12.03.1950", "12.09.2023 08:30:02 esame", "A0229123", "Nr figlia: 3", ") residuo", "Pag.: 1 / 3", "Firmato digitalmente da", "GDPR e altro", "_____", "---", "RSSMRA80A01H501U", "x@y.it scrive",
    "Terapia: farmaco 50 mg", "Terapia: farmaco 50 mg", "PROVENIENZA: reparto", "VISITA ONCOLOGICA DI CONTROLLO", "città è così", "Cognome e nome: LUCA MARTINELLI", "REFERTO", "<!-- image -->", "Pieve di Cento", "  fine\t",
]


@pytest.mark.parametrize("seed", range(3))
def test_all_phases_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 30))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, line string")
    got = {r.id: r.text for r in c.cleaned(df, "id").collect()}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]


@pytest.mark.parametrize("phase, plainly", [(c.without_departments, departments), (c.without_label_lines, label_lines), (c.without_orphans, orphans), (c.without_patterns, lambda t: drop(t, c.REMOVED)), (c.without_patient_data, data), (c.whitespace_cleaned, space)])
def test_each_phase(spark, phase, plainly):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(LINES) for _ in range(12)) for _ in range(120)] + ["", "\n\n", "Sesso\nM", "valore\nSesso"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    assert [r[1] for r in df.select("id", phase(F.col("text"))).orderBy("id").collect()] == [plainly(t) for t in texts]


def test_names_beside_labels(spark):
    cases = {
        "NOME E COGNOME\nMario Rossi Bianchi": "Mario Rossi Bianchi", "Maria Verdi\nCOGNOME E NOME": "Maria Verdi", "Cognome e nome: Luca Neri": "Luca Neri", "NOME E COGNOME\nVERDI\nANNA": "VERDI ANNA",
        "NOME E COGNOME\nReparto Oncologia": None, "## DATI ANAGRAFICI\n\nPAOLO GIALLI\naltro": "PAOLO GIALLI", "UGO FOSCOLO viene. Oggi UGO FOSCOLO sta bene": "UGO FOSCOLO", "GLOBULI BIANCHI e GLOBULI BIANCHI": None, "": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r[1] for r in df.select("i", c.patient_name(F.col("t"))).orderBy("i").collect()] == list(cases.values())
    assert df.where("i = 6").select(c.patient_name(F.col("t"), guess=False)).first()[0] is None


def test_sections_toggle_and_labels_stack(spark):
    rows = ["a", "## Richiedenti", "gone", "## Dati anagrafici", "kept", "## Richiedenti", "gone", "", "v1", "v2", "Ente", "Medico", "Sesso", "end"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "d int, line_no int, line string")
    assert [r.line for r in c.without_sections(df, "d").orderBy("line_no").collect()] == ["a", "## Dati anagrafici", "kept", "", "end"]
    assert c.cleaned(spark.createDataFrame([], "id int, text string"), "id").count() == 0


#: Texts that every pattern of REMOVED and RESIDUES finds something in, some with letters that equal ASCII ones only when case is ignored.
SIGNS = [
    "[MEDICO] .ssa ROSSI MARIA '", "visto dal dott. ROSSI MARIO", "DR. BIANCHI", "## Medico in Formazione", "Dirigente Medico", "SPECIALIZZANDO", "Pieve di Cento", "FRACTION OF x", "- 44100 FERRARA (FE)", "– 44100 CENTO FE",
    "Provenienza: casa", "DAY service oncologia", "abc ____ def", "ROSSI MARIO LUOGO E DATA DI NASCITA", "ROSSI MARIO NOME E COGNOME", "rossi [nato] luogo e data di nascita", "FERRARA (FE)", "Documento riservato", "documento informatico x",
    "ai sensi del decreto", "firmato digitalmente da x", "codice dell'amministrazione digitale", "REFERTO", "a.b@c.it", "Via Roma, 12 x", "Località Alta 3", "viale Po 44100 Ferrara", "Pag.: 1 / 2", "Azienda Ospedaliera x", "istituto clinico y",
    "arcispedale z", "## Servizio sanitario regionale x", "servizio sanitario nazionale y", "PROVENIENZA DH x", "[[PAZIENTE]]", "[TEL]", "## DATI ANAGRAFICI", "COGNOME E NOME", "[NATO] 10:20:30 x", "[CF]",
    "referto del 1.2.2020 delle ore 10:20:30", "Visita oncologica di controllo", "medicazione ustioni", "## Referto", "1/2/2020 10:20", "[INDIRIZZO] /3 - 44100 FERRARA (FE)", "[INDIRIZZO] - 44100 FERRARA FE", "RSSMRA80A01H501U", "123456789",
    "1234567890", "AB-12 (3)", "copia informatica del referto x", "<!-- image -->", "UO medicina", "Unità Operativa x", "Arcispedale S. Anna di x", "Dipartimento ad attività integrata x", "la firma del medico", "informazioni riservate x", "GDPR x",
    "regolamento UE 2016/679", "trattamento dei dati", "##", "## DATI", "## Medico curante", "f\u0131rma x", "\u0130nformaz\u0131oni riservate", "V\u0130S\u0130TA oncologica", "\u017fervizio \u017fanitario regionale x", "prof. CARLO x", "nulla", "", "ſ", "İ\nK",
]


def test_patterns_are_tried_wherever_they_can_match(spark):
    df = spark.createDataFrame([(i, x, f"{x}\n{y}") for i, (x, y) in enumerate(zip(SIGNS, SIGNS[1:] + SIGNS[:1], strict=True))], "i int, text string, two string")
    for patterns, needs in ((c.REMOVED, c.REMOVED_NEED), (c.RESIDUES, c.RESIDUES_NEED)):
        plain = [c._without(F.col("text"), [p]) for p in patterns]
        guarded = [c._without(F.col("text"), [p], [n]) for p, n in zip(patterns, needs, strict=True)]
        rows = df.select("text", F.array(*plain).alias("plain"), F.array(*guarded).alias("guarded")).collect()
        assert all(r.plain == r.guarded for r in rows)
        assert all(any(r.plain[k] != r.text for r in rows) for k in range(len(patterns)))
        both = df.select(c._without(F.col("two"), patterns).alias("plain"), c._without(F.col("two"), patterns, needs).alias("guarded"))
        assert all(r.plain == r.guarded for r in both.collect())


def test_sections_are_found_in_two_orders_of_the_lines(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "Sesso"), (1, 2, "b")], "doc int, line_no int, line string")
    out = c.without_sections(rows, "doc")
    assert [r.line for r in out.collect()] == ["b"]
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window [") >= 3
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Sort [") <= 2
