"""Ranked text search, question intents and citation checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def question_terms(question: str, stop_words: list[str], least: int = 3) -> list[str]:
    """Distinct terms of three characters or more in order, without stop words."""
    return list(dict.fromkeys(t for t in re.findall(r"[a-z0-9]+", question.lower()) if len(t) >= least and t not in stop_words))


def bm25(docs: DataFrame, question: str, most: int = 25, stop_words: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of the ``most`` best documents; a document's word counts for the first term that begins it.

    One pass over the text gives each document's length and term counts inside its row,
    so nothing is exploded and only (key, counts) reach the aggregation of document
    frequencies.
    """
    terms = question_terms(question, stop_words or [])
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    which = lambda w: F.coalesce(*[F.when(w.startswith(t), i) for i, t in enumerate(terms)], F.lit(-1))
    counted = docs.select(key, words.alias("_w")).select(key, F.size("_w").alias("_dl"), F.transform("_w", which).alias("_h"))
    tf = [F.size(F.array_compact(F.transform("_h", _equal_to(i)))).alias(f"_tf{i}") for i in range(len(terms))]
    counted = counted.where("_dl > 0").select(key, "_dl", *tf)
    totals = counted.agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avgdl = totals["n"] or 0, totals["avgdl"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"_tf{i}"), totals[f"df{i}"]
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.lit(float(avgdl))))
    scored = counted.where(" or ".join(f"_tf{i} > 0" for i in range(len(terms)))).select(key, score.alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(most)


def _equal_to(i: int):
    return lambda h: F.when(h == i, h)


def intent(text: Column, intents: dict[str, list[str]], default: str) -> Column:
    """The first intent one of whose tokens occurs."""
    out = F.lit(default)
    for name, tokens in reversed(list(intents.items())):
        any_of = F.lit(False)
        for token in tokens:
            any_of = any_of | F.contains(F.lower(text), F.lit(token))
        out = F.when(any_of, name).otherwise(out)
    return out


def event_rank(events: DataFrame, hit: Column, in_intent: Column, active: Column, day: str, key: str, most: int) -> DataFrame:
    """Best events: by intent, number of term hits, activity, then latest date."""
    return events.withColumns({"_i": in_intent.cast("int"), "_h": hit, "_a": active.cast("int")}).orderBy(F.desc("_i"), F.desc("_h"), F.desc("_a"), F.desc(day), key).limit(most).drop("_i", "_h", "_a")


def citations_valid(answer: Column, allowed: Column, pattern: str = r"\[([A-Z]+_[0-9]+)\]") -> Column:
    """True if the answer cites something and all it cites is allowed."""
    cited = F.regexp_extract_all(answer, F.lit(pattern), F.lit(1))
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, allowed)) == 0)
