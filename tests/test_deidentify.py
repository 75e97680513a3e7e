"""Redaction by known names, passes in order and nested records, against a plain version."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import deidentify as d


def plain_name(text, name):
    words = re.findall(d.NAME_WORD, name or "")
    orders = []
    for order in (words, words[::-1], words[-1:] + words[:-1], words[1:] + words[:1]):
        if order not in orders:
            orders.append(order)
    for order in orders:
        if len(order) > 1:
            text = re.sub(r"(?<!\w)" + r"(?:[\s,]+)".join(map(re.escape, order)) + r"(?!\w)", d.PATIENT, text, flags=re.I)
    for word in words:
        if len(word) >= 4:
            text = re.sub(f"({d.TITLE}){re.escape(word)}\\b", lambda m: m[1] + d.PATIENT, text, flags=re.I)
            text = re.sub(rf"(?<!\w){re.escape(word.upper())}(?!\w)", d.PATIENT, text)
    return text


def plain(text, name=None, code=None):
    text = plain_name(text, name)
    if parts := re.findall(d.LITERAL_PART, code or ""):
        text = re.sub(r"(?<!\w)" + r"[\s./_-]*".join(parts) + r"(?!\w)", d.FIELDS["fiscal_code"], text, flags=re.I)
    group = lambda tag: re.sub(r"\$(\d)", r"\\\1", tag)
    sub = lambda t, p: re.compile(p[0]).sub(lambda m: re.sub(r"\$(\d)", lambda g: m[int(g[1])] or "", p[1]), t)
    for p in (d.EMAIL, d.FISCAL_CODE, d.BIRTH_DATE, d.IDENTIFIER, d.LABELLED_PHONE):
        text = sub(text, p)
    text = re.sub(d.PHONE, lambda m: d.PHONE_TAG if 9 <= len(re.sub(r"\D", "", m[0])) <= 13 else m[0], text)
    for p in (d.LABELLED_ADDRESS, d.POSTAL_ADDRESS, d.TITLED_NAME, d.PATIENT_NAME):
        text = sub(text, p)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", text)))
    return text.strip()


PARTS = [
    "Massimo", "ROSSI", "Rosa", "massimo rossi", "Rossi, Massimo", "sig. Rossi", "paziente Rossi", "la signora Rosa", "D'Angelo", "de luca", "MASSIMO", "dose massimo", "RSS MRA 80A01 H501U", "x.y@z.it", "tel. 0532 123456", "Tel 3331234567", "fax: 051-123456",
    "+39 333 1234567", "12/03/2024", "nato il 3/4/1950", "Nosologico: A12345", "\nVia Roma 12, Ferrara\n", "\nVia orale 50 mg\n", "\nresidente a Cento\n", "Paziente Mario Bianchi riferisce", "123456", "0123 45", "città", "  ", "\n\n\n", "glicemia 110", "CF-77/a", "cf 77 A",
]


@pytest.mark.parametrize("seed", range(3))
def test_passes_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    names = ["Massimo Rossi", "Rosa D'Angelo de luca", None, "", "Rossi", "Anna Maria Rosa Verdi"]
    rows = [(i, " ".join(rng.choice(PARTS) for _ in range(rng.randrange(12))), rng.choice(names), rng.choice([None, "CF 77-A", "--"])) for i in range(250)] + [(250, None, "Rosa Neri", None)]
    df = spark.createDataFrame(rows, "i int, t string, name string, code string")
    got = [r[1] for r in df.select("i", d.sanitized(F.col("t"), {"name": F.col("name"), "fiscal_code": F.col("code")})).orderBy("i").collect()]
    assert got == [plain(t or "", name, code) for _, t, name, code in rows]


def test_clinical_words_stay(spark):
    rows = ["dose massimo 50 mg, pitiriasi rosa", "Rosa Rossi e ROSSI, sig.ra Rosa", "Somministrare per\nVia endovenosa 250 mg", "riferisce dolore", "tel. 0532 123456"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r[1] for r in df.select("i", d.sanitized(F.col("t"), {"name": F.lit("Rossi Rosa")})).orderBy("i").collect()]
    assert got == ["dose massimo 50 mg, pitiriasi rosa", "[PAZIENTE] e [PAZIENTE], sig.ra [PAZIENTE]", "Somministrare per\nVia endovenosa 250 mg", "riferisce dolore", "tel.: [TELEFONO RIMOSSO]"]


def walk(value, leaf):
    if isinstance(value, dict):
        return {k: walk(v, leaf) for k, v in value.items()}
    if isinstance(value, list):
        return [walk(v, leaf) for v in value]
    return leaf(value) if isinstance(value, str) else value


def test_nested_records_keep_their_shape(spark):
    deep = "x@y.it"
    for i in range(20):
        deep = {"a:b": [deep, None, i]} if i % 2 else [deep, {"k": True}]
    payloads = [
        {"Rossi": "Rossi", "t": ["il sig. Rossi", " ROSA ", "cf-77.a", "tutto bene"], "n": 1.50, "z": None, "e": [], "o": {}}, deep, "x@y.it", ["a \"quoted\" \\ word: x@y.it", "line\nend", "é 日本 𝒳", "\u0001"], 12, None, [[["Rosa"]]],
    ]
    texts = [json.dumps(p, ensure_ascii=i % 2 == 0) for i, p in enumerate(payloads)] + ['{ "k" : "x@y.it" ,"l":[ "ok" ] }', "no JSON x@y.it", '{"open": "x@y.it"']
    name, code = "Rossi Rosa", "CF 77-A"

    def leaf(x):
        bare = re.sub(r"\W", "", x).lower()
        return d.REMOVED if x.strip().lower() in ("rossi", "rosa") or bare == "cf77a" else plain(x, name, code)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", d.payload_sanitized(F.col("t"), {"name": F.lit(name), "fiscal_code": F.lit(code)})).orderBy("i").collect()]
    assert [json.loads(x) for x in got[:8]] == [walk(json.loads(t), leaf) for t in texts[:8]]
    assert got[7].startswith('{ "k" : ') and got[8:] == ["no JSON [EMAIL RIMOSSA]", '{"open": "[EMAIL RIMOSSA]"']
    assert df.select(d.payload_sanitized(F.lit(None).cast("string"), {})).first()[0] == ""


def test_identities_are_joined_by_subject(spark):
    texts = spark.createDataFrame([("p", "sig. Rossi sta bene", 1), ("q", "sig.ra Rossi", 2), (None, "ROSSI", 3)], "subject string, text string, name int")
    subjects = spark.createDataFrame([("p", "Mario Rossi", "x")], "subject string, name string, other string")
    got = {r.name: r.text for r in d.redacted_by_subject(texts, subjects, "subject", "text").collect()}
    assert got == {1: "sig. [PAZIENTE] sta bene", 2: "[PAZIENTE]", 3: "ROSSI"}
