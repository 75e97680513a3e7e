"""Table operations of a governed registry: merges of subjects, replacement by scope, deletion, coded terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories that evidence may carry, and derived ones with the base they fold to.
CATEGORIES = [
    "diagnosis", "comorbidity", "symptom", "clinical_sign", "clinical_syndrome", "laboratory_finding", "laboratory_trend",
    "imaging_finding", "instrumental_finding", "histopathology", "biomarker", "medication", "oncology_treatment_line",
    "procedure", "surgery", "hospitalization", "discharge", "toxicity", "adverse_event", "allergy", "vaccination",
    "family_history", "risk_factor", "functional_status", "vital_sign", "recommendation", "care_plan", "response", "progression", "follow_up", "other",
]
DERIVED = {"laboratory_trend": "laboratory_finding", "clinical_syndrome": "diagnosis", "oncology_treatment_line": "medication"}


def folded_category(category: Column) -> Column:
    """The base category of a derived one; unknown, empty and null ones are ``other``."""
    told = F.lower(F.trim(category))
    base = F.coalesce(*[F.when(told == name, F.lit(to)) for name, to in DERIVED.items()], told)
    return F.when(base.isin(CATEGORIES), base).otherwise(F.lit("other"))


def coded(items: DataFrame, reviewed: DataFrame, builtin: DataFrame, concept: str, unit: str) -> DataFrame:
    """``items`` with code and code_source: a reviewed mapping first, else a built-in one.

    ``reviewed`` (concept, unit, code) holds for exactly its unit, a null one being a unit
    of its own; of several codes the least. ``builtin`` (concept, code, units) gives no
    code where the item has a unit that the term does not expect. Rows keep their number;
    a null concept has no code.
    """
    first = reviewed.groupBy(F.col(concept).alias("_c"), F.col(unit).alias("_u")).agg(F.min("code").alias("_reviewed"))
    second = builtin.groupBy(F.col(concept).alias("_b")).agg(F.min_by("code", "code").alias("_code"), F.min_by("units", "code").alias("_units"))
    met = items.join(first, (F.col(concept) == F.col("_c")) & F.col(unit).eqNullSafe(F.col("_u")), "left").join(second, F.col(concept) == F.col("_b"), "left")
    allowed = F.coalesce(F.col(unit), F.lit("")) == ""
    own = F.when(allowed | F.array_contains("_units", F.col(unit)), F.col("_code"))
    source = F.when(F.col("_reviewed").isNotNull(), "reviewed").when(own.isNotNull(), "builtin").otherwise("none")
    return met.select(*items.columns, F.coalesce("_reviewed", own).alias("code"), source.alias("code_source"))


def replaced(current: DataFrame, incoming: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """``current`` after each scope (a row of ``scopes``, say document and method) was extracted anew.

    An incoming row takes the place of the current one of its key; current rows of a scope
    that the new extraction no longer holds go, all others stay. A null in a scope column
    is in no scope. ``incoming`` has unique keys and the columns of ``current``.
    """
    kept = current.join(incoming.select(key), key, "left_anti").join(scopes.distinct(), scopes.columns, "left_anti")
    return kept.unionByName(incoming)


def merged_documents(documents: DataFrame, moves: DataFrame, guarded: DataFrame, subject: str, key: str, file_hash: str) -> DataFrame:
    """subject, old, new of every document after subjects were merged (``moves``: source, target).

    A source that stands in ``guarded`` (column source) stays as it is. A source's document
    whose hash the target has becomes the target's one (the least key); the others move
    and keep their key. Targets are no sources themselves; a null hash equals none.
    """
    open_moves = moves.join(guarded.select("source").distinct(), "source", "left_anti")
    had = documents.join(open_moves.select(F.col("target").alias(subject)).distinct(), subject, "left_semi").groupBy(F.col(subject).alias("target"), F.col(file_hash).alias("_hash")).agg(F.min(key).alias("_known"))
    at = documents.join(open_moves, F.col(subject) == F.col("source"), "left").withColumnRenamed("target", "_target")
    met = at.join(had, (F.col("_target") == F.col("target")) & (F.col(file_hash) == F.col("_hash")), "left")
    return met.select(F.coalesce("_target", subject).alias("subject"), F.col(key).alias("old"), F.coalesce("_known", key).alias("new"))


def without_documents(evidence: DataFrame, links: DataFrame, gone: DataFrame, key: str, document: str) -> DataFrame:
    """Evidence left after documents were deleted, with its remaining ``sources`` and ``primary`` (the least document).

    ``links`` (key, document) names the sources of evidence; what loses its last one goes
    too, and so does what had none.
    """
    left = links.join(gone.select(document).distinct(), document, "left_anti").groupBy(key).agg(F.count_distinct(document).alias("sources"), F.min(document).alias("primary"))
    return evidence.join(left, key)
