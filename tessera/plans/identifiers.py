"""Queries that remove identifiers: names that differ by document, and nested records made of the documents' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import masking
from tessera.operators import deidentify
from tessera.plans.registry import query, read

_WORD = "[A-Za-z]{4,}"
#: A letter, digit or underscore of any alphabet may not stand beside a name.
_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"


def _gone(text: str, name: str, flags: str) -> str:
    """SQL that replaces whole names; twice, as a match takes the sign that the next one would need before it."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|{_EDGE})' || {name} || '($|{_EDGE})', '\\1[PAZIENTE]\\2', '{flags}')"
    return text


@query(f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM documents), n AS (SELECT *, CASE WHEN lower(ws[2]) <> lower(ws[1]) THEN ws[2] END AS a, ws[1] AS b FROM w),
  x AS (SELECT *, CASE WHEN b IS NULL THEN text WHEN a IS NULL THEN text ELSE {_gone(_gone("text", "a || '[\\s,]+' || b", "gi"), "b || '[\\s,]+' || a", "gi")} END AS t FROM n),
  y AS (SELECT doc_id, CASE WHEN a IS NULL THEN t ELSE {_gone(_gone("t", "upper(a)", "g"), "upper(b)", "g")} END AS t FROM x)
  SELECT doc_id, md5(t) AS digest, contains(t, '[PAZIENTE]') AS found FROM y""")
def names_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first two words of four letters or more, the second first, as its subject's name."""
    texts = read(spark, sf_dir, "documents", "doc_id", "text")
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    name = F.when(F.lower(first) != F.lower(second), F.concat_ws(" ", second, first))
    subjects = texts.select("doc_id", name.alias("name"))
    out = texts.join(subjects, "doc_id").select("doc_id", deidentify.without_name(F.col("text"), F.col("name")).alias("text"))
    return out.select("doc_id", F.md5("text").alias("digest"), F.contains("text", F.lit("[PAZIENTE]")).alias("found"))


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query(f"""WITH l AS (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_EMAIL}', '[EMAIL RIMOSSA]', 'g')) AS rows FROM documents)
  SELECT doc_id, md5(CAST(to_json({{'source': source, 'n': doc_id, 'none': NULL::VARCHAR[], 'rows': [rows, []], 'more': {{'first': {{'k"ey': rows[1]}}, 'flag': doc_id % 2 = 0}}}}) AS VARCHAR)) AS digest FROM l""")
def nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses in the strings of a record of the document's lines, lists in lists and records in records."""
    df = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    rows = F.split("text", "\n")
    none = F.lit(None).cast("array<string>")
    record = F.struct("source", F.col("doc_id").alias("n"), none.alias("none"), F.array(rows, F.array().cast("array<string>")).alias("rows"), F.struct(F.struct(F.get(rows, F.lit(0)).alias('k"ey')).alias("first"), (F.col("doc_id") % 2 == 0).alias("flag")).alias("more"))
    payload = F.to_json(record, {"ignoreNullFields": "false"})
    return df.select("doc_id", F.md5(deidentify.nested(payload, lambda x: F.regexp_replace(x, _EMAIL, "[EMAIL RIMOSSA]"))).alias("digest"))


@query(f"""WITH n AS (SELECT doc_id, text, len(regexp_extract_all(text, '{masking.NUMBER}')) AS n FROM documents)
  SELECT doc_id, n, CASE WHEN doc_id % 3 = 0 THEN 'new_number' WHEN doc_id % 3 = 1 AND n > 1 THEN 'reordered' END AS problem, CASE WHEN doc_id % 3 = 2 OR (doc_id % 3 = 1 AND n < 2) THEN md5(text) END AS digest FROM n""")
def numbers_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbers masked and put back: as they are, with a number added, and with the first two tokens swapped."""
    k = F.col("doc_id") % 3
    df = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("code", masking.masked(F.col("text")))
    a, b = F.lit("[[VALORE_A]]"), F.lit("[[VALORE_B]]")
    swapped = F.replace(F.replace(F.replace("code", a, F.lit("\x01")), b, a), F.lit("\x01"), b)
    given = F.when(k == 0, F.concat("code", F.lit(" 17"))).when((k == 1) & F.contains("code", b), swapped).otherwise(F.col("code"))
    out = df.withColumn("given", given).select("doc_id", F.size(masking.literals(F.col("text"))).cast("long").alias("n"), masking.restored(F.col("given"), F.col("text")).alias("r"))
    return out.select("doc_id", "n", F.col("r.problem").alias("problem"), F.md5("r.text").alias("digest"))
