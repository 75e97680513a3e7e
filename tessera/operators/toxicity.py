"""Findings after an exposure: lexicon scan, bands, counts by organ, corrections on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.series import anchor_offsets

#: Organs and the word stems (patterns at a word's beginning) that point at them, in order; abbreviations are whole words.
LEXICON = {
    "skin": ["rash", "prurit", "dermat"], "colon": ["diarr", "colit"], "liver": ["epatit", "transamin", r"alt\b", r"ast\b"], "thyroid": ["tiroid", "tsh"],
    "lung": ["polmonit", "dispn"], "heart": ["miocard", "troponin"], "kidney": ["nefrit", "creatinin"],
}
GENERIC = ["astenia", "febbre", "nausea"]


def organ(text: Column, lexicon: dict[str, list[str]] | None = None, generic: list[str] | None = None) -> Column:
    """The first organ one of whose stems begins a word; else 'generic' for a generic symptom; else null."""
    stem = lambda words: r"(?iu)\b(" + "|".join(words) + r")"
    out = F.when(text.rlike(stem(generic or GENERIC)), "generic")
    for name, words in reversed(list((lexicon or LEXICON).items())):
        out = F.when(text.rlike(stem(words)), name).otherwise(out)
    return out


def report(df: DataFrame, subject: str, day: str, is_exposure: Column, organ_col: str) -> DataFrame:
    """Per subject and organ: findings in each band, baseline count, first day after the exposure."""
    rows = anchor_offsets(df, subject, day, is_exposure).where(F.col(organ_col).isNotNull() & ~is_exposure)
    bands = {"before": "<0", "early": "<=14", "middle": "<=112", "late": "<=365", "very_late": ">365", "undated": "undated"}
    counts = [F.count_if(F.col("band") == b).alias(name) for name, b in bands.items()]
    return rows.groupBy(subject, organ_col).agg(F.count("*").alias("findings"), *counts, F.min(F.when(F.col("offset_days") >= 0, F.col(day))).alias("first_after"))


def specific(value: Column, upper: Column, operator: Column) -> Column:
    """False only for a plain value that does not exceed the upper limit."""
    return ~F.coalesce(value.isNotNull() & upper.isNotNull() & ~F.coalesce(operator.isin(">", ">="), F.lit(False)) & (value <= upper), F.lit(False))


def final_and_suspect(df: DataFrame, probability: str) -> DataFrame:
    """Add standing: unlikely and possible findings are suspect; a missing probability counts as definitive."""
    return df.withColumn("standing", F.when(F.col(probability).isin("unlikely", "possible"), "suspect").otherwise("final"))


def corrected(findings: DataFrame, corrections: DataFrame, key: str, value: str) -> DataFrame:
    """Replay of corrections (key, action, value): removed rows go, edited rows take the value, added rows come; running twice changes nothing."""
    last = corrections.groupBy(key).agg(F.max_by(F.struct("action", F.col(value).alias("_v")), "seq").alias("_c"))
    both = findings.join(last, key, "full")
    kept = both.where(F.coalesce(F.col("_c.action") != "remove", F.lit(True)) & (F.col(value).isNotNull() | F.coalesce(F.col("_c.action") == "add", F.lit(False))))
    return kept.withColumn(value, F.when(F.col("_c.action").isin("edit", "add"), F.col("_c._v")).otherwise(F.col(value))).drop("_c")
