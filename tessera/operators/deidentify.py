"""Removal of direct identifiers from prose and from nested records, with and without a known identity.

A known identity is a table of subjects joined to their texts, so its patterns differ by
row; a row pays for them only if its words hold one of the name's. Nested records stay
JSON text: their string values are found between the structure, changed one by one and
put back, so arrays, nulls, numbers, keys and any depth stay as they are, without a
schema or recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.texts import let

#: The patterns of the passes, in order, with what takes the match's place.
EMAIL = (r"(?i)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w-])", "[EMAIL RIMOSSA]")
FISCAL_CODE = (r"(?i)\b[A-Z]{6}\s*\d{2}\s*[A-Z]\s*\d{2}\s*[A-Z]\s*\d{3}\s*[A-Z]\b", "[CODICE FISCALE RIMOSSO]")
BIRTH_DATE = (r"(?i)\b(data\s+di\s+nascita|nato\s+il|nata\s+il)\s*:?\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}", "$1: [DATA ANAGRAFICA RIMOSSA]")
IDENTIFIER = (r"(?i)(?<!\[)\b(codice\s+fiscale|codice\s+assistito|id\s+paziente|numero\s+cartella|n[°.]?\s*cartella|nosologico)\s*[:#]?\s*(?!RIMOSS[OA]\b)[A-Z0-9][A-Z0-9./_-]{3,}", "$1: [IDENTIFICATIVO RIMOSSO]")
LABELLED_PHONE = (r"(?i)\b(tel(?:efono)?|cell(?:ulare)?|mobile|fax)\s*(?:(\.)|:)?\s*\+?\d[\d\s()./-]{5,}\d", "$1$2: [TELEFONO RIMOSSO]")
PHONE, PHONE_TAG = r"(?<![\w])(?:\+?39[\s./-]*)?(?:0\d{1,3}|3\d{2})(?:[\s./-]*\d){6,9}(?![\w])", "[TELEFONO RIMOSSO]"
LABELLED_ADDRESS = (r"(?im)^[ \t]*(?:indirizzo|residente|residenza|domicilio|domiciliat[oa])\s*:?\s*[^\n]+$", "[INDIRIZZO RIMOSSO]")
POSTAL_ADDRESS = (
    r"(?m)^[ \t]*(?:Via|VIA|Viale|VIALE|Piazza|PIAZZA|Corso|CORSO|Strada|STRADA|Vicolo|VICOLO|Largo|LARGO|Località|LOCALITÀ)"
    r"(?!\s+(?i:orale|endovenosa|intravenosa|intramuscolare|sottocutanea|topica|inalatoria|rettale|sublinguale|transdermica)\b)"
    r"(?:\s+(?:de(?:i|l|lla|llo|lle|gli)|di|san|santa|santo|santi|sant'|al|alla|allo|alle|ai|il|lo|la|le|gli|in|su|da)){0,2}\s+[A-ZÀ-Ü][^\n;]{1,90}?"
    r"(?:,\s*\d{1,4}(?!\d)(?:[/A-Za-z])?(?!\s*(?i:mg|mcg|µg|g|ml|ui|unità)\b)|,\s*[A-ZÀ-Ü][A-Za-zÀ-ÖØ-öø-ÿ'’\-\. ]{0,30}|\s+\d{1,4}(?!\d)(?:[/A-Za-z])?(?!\s*(?i:mg|mcg|µg|g|ml|ui|unità)\b)|\b\d{5}\b)[^\n]*$",
    "[INDIRIZZO RIMOSSO]",
)
TITLED_NAME = (r"\b(?i:signor(?:a|e)?|sig(?:\.|\.ra|\.na|ra|na)?)\s+[A-ZÀ-Ü][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+(?:\s+[A-ZÀ-Ü][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+)?\b", "[PAZIENTE]")
PATIENT_NAME = (r"\b(?i:paziente)\s+[A-ZÀ-Ü][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+\s+[A-ZÀ-Ü][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+\b", "[PAZIENTE]")
NAME_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’\-][A-Za-zÀ-ÖØ-öø-ÿ]+)?"
LITERAL_PART = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"
TITLE = r"\b(?:sig(?:\.|nor[ae]?|\.?\s*(?:ra)?)|paziente)\s+"
#: An identity's other fields and their tags.
FIELDS = {"fiscal_code": "[CODICE FISCALE RIMOSSO]", "birth_date": "[DATA ANAGRAFICA RIMOSSA]", "hospital_patient_id": "[IDENTIFICATIVO RIMOSSO]"}
PATIENT, REMOVED = "[PAZIENTE]", "[IDENTIFICATIVO RIMOSSO]"


def _any(pattern: str) -> str:
    """The pattern over letters of any alphabet, where only \\n ends a line."""
    return f"(?duU){pattern}"


def _quoted(word: Column) -> Column:
    return F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))


def name_words(name: Column) -> Column:
    """The words of a name; a null name has none."""
    return F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(NAME_WORD), F.lit(0))


def without_name(text: Column, name: Column) -> Column:
    """The text with a known name as [PAZIENTE].

    The whole name counts in any case in its own, the reversed and both rotated orders,
    its words parted by white space or commas. A word of four letters or more counts alone
    only after a title or 'paziente', which stays, or in capitals, since names can be words.
    """

    def redacted(words: Column) -> Column:
        n = F.size(words)
        orders = F.array_distinct(F.array(words, F.reverse(words), F.concat(F.slice(words, n, 1), F.slice(words, 1, n - 1)), F.concat(F.slice(words, 2, n - 1), F.slice(words, 1, 1))))
        inner = lambda order: F.array_join(F.transform(order, _quoted), r"(?:[\s,]+)")
        whole = lambda t, order: F.regexp_replace(t, F.concat(F.lit(_any(r"(?i)(?<!\w)")), inner(order), F.lit(r"(?!\w)")), F.lit(PATIENT))
        titled = lambda t, w: F.regexp_replace(t, F.concat(F.lit(_any(f"(?i)({TITLE})")), _quoted(w), F.lit(r"\b")), F.lit(f"$1{PATIENT}"))
        upper = lambda t, w: F.regexp_replace(t, F.concat(F.lit(_any(r"(?<!\w)")), _quoted(F.upper(w)), F.lit(r"(?!\w)")), F.lit(PATIENT))
        full = F.when(n >= 2, F.aggregate(orders, text, whole)).otherwise(text)
        alone = F.filter(words, lambda w: F.length(w) >= 4)
        return F.aggregate(alone, full, lambda t, w: upper(titled(t, w), w))

    def seen(words: Column) -> Column:
        low = F.lower(text)
        return F.exists(words, lambda w: F.contains(low, F.lower(w)))

    return let(name_words(name), lambda words: F.when((F.size(words) > 0) & seen(words), redacted(words)).otherwise(text))


def without_value(text: Column, value: Column, tag: str) -> Column:
    """The text with a known value as its tag, in any case and with any of '. / _ -' or spaces between its parts."""
    parts = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(LITERAL_PART), F.lit(0))
    pattern = F.concat(F.lit(_any(r"(?i)(?<!\w)")), F.array_join(parts, r"[\s./_-]*"), F.lit(r"(?!\w)"))
    return F.when(F.size(parts) > 0, F.regexp_replace(text, pattern, F.lit(tag))).otherwise(text)


def without_phones(text: Column) -> Column:
    """Numbers that look like a telephone's and have 9 to 13 digits become a tag."""
    found, between = F.regexp_extract_all(text, F.lit(_any(PHONE)), F.lit(0)), F.split(text, _any(PHONE), -1)
    count = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    tagged = F.transform(found, lambda x: F.when(count(x).between(9, 13), PHONE_TAG).otherwise(x))
    return F.array_join(F.zip_with(between, tagged, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def spaced(text: Column) -> Column:
    """Blanks before line ends dropped, runs of blanks to one, three or more line ends to two, ends trimmed."""
    one = F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(one, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def sanitized(text: Column, identity: dict[str, Column] | None = None) -> Column:
    """The text after all passes; ``identity`` gives columns for name and FIELDS, each may be null. A null text is empty."""
    known = identity or {}
    out = F.coalesce(text, F.lit(""))
    if "name" in known:
        out = without_name(out, known["name"])
    for field, tag in FIELDS.items():
        if field in known:
            out = without_value(out, known[field], tag)
    replaced = lambda t, p: F.regexp_replace(t, _any(p[0]), p[1])
    out = without_phones(reduce(replaced, [EMAIL, FISCAL_CODE, BIRTH_DATE, IDENTIFIER, LABELLED_PHONE], out))
    return spaced(reduce(replaced, [LABELLED_ADDRESS, POSTAL_ADDRESS, TITLED_NAME, PATIENT_NAME], out))


#: A JSON text in pieces: strings (with the colon after a key) and what stands between them.
_PIECE = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?|[^"]+'


def nested(payload: Column, leaf) -> Column:
    """A JSON text with each string value x as ``leaf(x)``; keys, numbers, nulls, order and depth stay. What is no JSON is one string: leaf(payload)."""
    pieces = F.regexp_extract_all(payload, F.lit(_PIECE), F.lit(0))
    is_value = lambda p: p.startswith('"') & p.endswith('"')
    value = lambda p: F.get(F.from_json(F.concat(F.lit("["), p, F.lit("]")), "array<string>"), F.lit(0))
    written = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")
    changed = F.array_join(F.transform(pieces, lambda p: F.when(is_value(p), written(leaf(value(p)))).otherwise(p)), "")
    return F.when(F.try_parse_json(payload).isNotNull(), changed).otherwise(leaf(payload))


def payload_sanitized(payload: Column, identity: dict[str, Column]) -> Column:
    """A JSON text whose string values are sanitized; one that is a word of the name (three letters or more), or an identity value but for signs, goes whole."""
    words = F.filter(F.transform(name_words(identity.get("name", F.lit(None).cast("string"))), F.lower), lambda w: F.length(w) >= 3)
    bare = lambda x: F.lower(F.regexp_replace(x, r"(?U)\W", ""))
    direct = F.array(*[F.coalesce(bare(identity[f]), F.lit("")) for f in FIELDS if f in identity]) if any(f in identity for f in FIELDS) else F.array().cast("array<string>")

    def leaf(x: Column) -> Column:
        whole = F.array_contains(words, F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))) | ((bare(x) != "") & F.array_contains(direct, bare(x)))
        return F.when(whole, REMOVED).otherwise(sanitized(x, identity))

    return nested(payload, leaf)


def redacted_by_subject(texts: DataFrame, subjects: DataFrame, subject: str, text: str) -> DataFrame:
    """Rows of ``texts`` with ``text`` sanitized by their subject's identity (name and FIELDS, as far as ``subjects`` has them); subjects are unique."""
    fields = [f for f in ("name", *FIELDS) if f in subjects.columns]
    known = subjects.select(F.col(subject).alias("_subject"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = texts.join(known, F.col(subject) == F.col("_subject"), "left")
    return joined.withColumn(text, sanitized(F.col(text), {f: F.col(f"_{f}") for f in fields})).select(texts.columns)
