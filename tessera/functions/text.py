"""Text folding, cleaning and redaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latin letters with marks and their plain forms, place by place.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Words that carry no meaning in an entity's name.
STOP_WORDS = ["di", "del", "della", "dello", "dei", "delle", "da", "in", "con", "per"]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often body names it; inside a lambda a plain column would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once a row: a condition on them is not pushed below and computed from their inputs again."""
    once = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.withColumn("_once", once).select(*[c for c in df.columns if c not in columns], "_once.*")


def fold(text: Column, keep: str = "a-z0-9", joiner: str = "_") -> Column:
    """Lower case without marks; runs of characters outside ``keep`` become one joiner."""
    plain = F.translate(F.lower(text), MARKED, PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, f"[^{keep}]+", joiner), f"^{joiner}|{joiner}$", "")


def entity_key(text: Column) -> Column:
    """Canonical entity: folded, without stop words, at most 20 tokens joined by '_'."""
    tokens = F.filter(F.split(fold(text, "a-z0-9%+", " "), " "), lambda t: (t != "") & ~t.isin(STOP_WORDS))
    return F.array_join(F.slice(tokens, 1, 20), "_")


def semantic_terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct folded tokens of four characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(fold(text), "_"), lambda t: (F.length(t) >= 4) & ~t.isin(stop_words))))


def clean_whitespace(text: Column) -> Column:
    """Runs of blanks to one, blanks at line ends dropped, three or more newlines to two, ends trimmed."""
    one = F.regexp_replace(text, r"[ \t]+", " ")
    lines = F.regexp_replace(one, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]*[ ]?\([0-9]{3}\) [0-9]{3}-[0-9]{4}"
FISCAL_CODE = r"\b[A-Za-z]{6}[0-9]{2}[A-Za-z][0-9]{2}[A-Za-z][0-9]{3}[A-Za-z]\b"
IP_ADDRESS = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
LABELLED_DATE = r"(?i)\b(nat[oa] il|data di nascita:?)\s*[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}"
LABELLED_PHONE = r"(?i)\b(tel(?:efono)?|cell(?:ulare)?|fax)[.:]?\s*\+?[0-9][0-9 ./-]{6,16}[0-9]"
COURTESY_NAME = r"\b(Sig\.ra|Sig\.|Dott\.ssa|Dott\.|Dr\.|Prof\.)\s+[A-Z][a-zà-ù]+(?:\s+[A-Z][a-zà-ù]+)?"
#: Ordered passes: class, pattern.
PASSES = [("email", EMAIL), ("fiscal_code", FISCAL_CODE), ("birth_date", LABELLED_DATE), ("labelled_phone", LABELLED_PHONE), ("phone", PHONE), ("name", COURTESY_NAME), ("address", IP_ADDRESS)]


def redacted(text: Column, passes: list[tuple[str, str]] = PASSES) -> Column:
    """Identifiers replaced class by class, in order."""
    for name, pattern in passes:
        text = F.regexp_replace(text, pattern, f"[{name.upper()}]")
    return text


def redaction_counts(text: Column, passes: list[tuple[str, str]] = PASSES) -> Column:
    """struct of how many identifiers of each class the ordered passes remove."""
    counts = []
    for name, pattern in passes:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        text = F.regexp_replace(text, pattern, f"[{name.upper()}]")
    return F.struct(*counts)


def normalized_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))
