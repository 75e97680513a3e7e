"""Evaluation of predictions against gold: micro and macro rates, greedy one-to-one matching, slot choice."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.matching import one_to_one


def micro_macro(df: DataFrame, group: str, gold: str, predicted: str) -> DataFrame:
    """One row: summed counts with their rates, and the mean of the groups' rates; four decimals, half up."""
    g, p = F.col(gold), F.col(predicted)
    each = df.groupBy(group).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(a) + F.col(b))
    each = each.withColumns({"p": rate("tp", "fp"), "r": rate("tp", "fn")})
    sums = each.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("p").alias("_p"), F.avg("r").alias("_r"))
    r4 = lambda c: F.round(c, 4)
    return sums.select("tp", "fp", "fn", r4(rate("tp", "fp")).alias("micro_precision"), r4(rate("tp", "fn")).alias("micro_recall"), r4(F.col("_p")).alias("macro_precision"), r4(F.col("_r")).alias("macro_recall"))


def matched(a: str, b: str) -> int:
    """Characters of the matching blocks: the longest one (first in a, then in b), then likewise left and right of it, each found by searching substrings."""
    total, open_ = 0, [(a, b)]
    while open_:
        a, b = open_.pop()
        at = size = 0
        for i in range(len(a)):
            if i + size >= len(a):
                break
            while i + size < len(a) and a[i : i + size + 1] in b:
                at, size = i, size + 1
        if size:
            start = b.find(a[at : at + size])
            total += size
            open_ += [(a[:at], b[:start]), (a[at + size :], b[start + size :])]
    return total


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two strings, as difflib has it; characters that occur often count like others."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    found: dict[tuple[str, str], float] = {}
    for pair in zip(a, b, strict=True):
        if pair not in found:
            found[pair] = ratio(*pair)
    return pd.Series([found[pair] for pair in zip(a, b, strict=True)], dtype=float)


@lru_cache(maxsize=256)
def _places(text: str) -> dict[str, int]:
    """The places of each character, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def shared_start(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number; ratio() never matches more characters.

    What both begin and end with is in it, so of texts that share most only the middle is compared.
    """
    start = shared_start(a, b)
    end = shared_start(a[start:][::-1], b[start:][::-1])
    if 2 * (start + end) < len(a):  # the places of the whole text are kept for its next pair
        start = end = 0
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    places, full = _places(a), (1 << len(a)) - 1
    row = full
    for c in b:
        if c in places:
            met = row & places[c]
            row = (row + met) | (row - met)
    return start + len(a) - (row & full).bit_count() + end


def ratio_if(a: str, b: str, least: float) -> float | None:
    """ratio() where it is ``least`` or more, else None."""
    if 2 * common(a, b) < (least - 1e-12) * (len(a) + len(b)):
        return None
    value = ratio(a, b)
    return value if value >= least else None


@lru_cache(maxsize=1 << 15)
def _known(a: str, b: str, least: float) -> float | None:
    return ratio_if(a, b, least)


#: Texts of at most so many characters together are remembered beyond their batch.
SHORT = 160


@F.pandas_udf(T.DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """text_ratio where it is ``least`` or more, else null: most pairs are told apart by their common subsequence alone."""
    found: dict[tuple[str, str, float], float | None] = {}
    for pair in zip(a, b, least, strict=True):
        if pair not in found:
            found[pair] = _known(*pair) if len(pair[0]) + len(pair[1]) <= SHORT else ratio_if(*pair)
    return pd.Series([found[pair] for pair in zip(a, b, least, strict=True)], dtype=float)


def odd_characters(text: str) -> Column:
    """64 bits, one a class of characters: whether the text holds an odd number of them."""
    flip = lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.length(c).cast("long"), F.ascii(c) % 64))  # noqa: E731  an empty text is split into one empty part
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), flip)


def most_shared(odd_a: Column, odd_b: Column, length: Column) -> Column:
    """Of the ``length`` characters of two texts no more are in matching blocks: each bit that differs is a character without a partner."""
    return length - F.bit_count(odd_a.bitwiseXOR(odd_b))


#: What category, entity and date of two events weigh.
CATEGORY, ENTITY, DATE = 0.35, 0.45, 0.20


def greedy_match(gold: DataFrame, predicted: DataFrame, least: float = 0.62) -> DataFrame:
    """subject, gold_id, predicted_id, score: one-to-one matches of each subject, best score first, down to ``least``.

    Both tables have subject, id (unique), category, entity, day. A pair scores CATEGORY
    for equal categories, ENTITY times the entities' similarity, DATE for equal days;
    ties go to the greater gold id, then the greater predicted id. Without a category or
    a day in common no pair reaches a ``least`` above ENTITY, so pairs are formed by
    equality joins on these; those whose entities' lengths rule the score out never
    reach the similarity. Null categories and days equal nothing; a null entity is
    empty; rows of a null subject match nothing.
    """
    if least <= ENTITY:
        raise ValueError(f"least must be above {ENTITY}")
    side = lambda df, x: df.select("subject", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "category", "day")], F.coalesce(F.col("entity").cast("string"), F.lit("")).alias(f"{x}_entity"))
    g, p = side(gold, "g"), side(predicted, "p")
    category, day = F.col("g_category") == F.col("p_category"), F.col("g_day") == F.col("p_day")
    same_category, same_day = (F.coalesce(x, F.lit(False)) for x in (category, day))
    pairs = g.join(p, (g["subject"] == p["subject"]) & category).drop(p["subject"])
    pairs = pairs.unionByName(g.join(p, (g["subject"] == p["subject"]) & day).drop(p["subject"]).where(~same_category))
    known = F.when(same_category, CATEGORY).otherwise(0.0)
    dated = F.when(same_day, DATE).otherwise(0.0)
    a, b = F.length("g_entity"), F.length("p_entity")
    most = F.when(a + b == 0, 1.0).otherwise(2 * F.least(a, b) / (a + b))
    possible = pairs.where(known + ENTITY * most + dated >= least - 1e-9)
    scored = possible.withColumn("score", known + ENTITY * text_ratio("g_entity", "p_entity") + dated).where(F.col("score") >= least)
    rows = scored.select("subject", F.col("g_id").alias("gold_id"), F.col("p_id").alias("predicted_id"), "score")
    return one_to_one(rows, "gold_id", "predicted_id", F.struct("score", "gold_id", "predicted_id")).withColumn("score", F.round("score", 4))


def choose_slots(samples: DataFrame, least_quality: float = 0.80) -> DataFrame:
    """The smallest slot count among reliable ones within .05 of the best quality and 3 % of the peak throughput.

    ``samples``: slots, quality, throughput, evidence, ok. A slot count is reliable if all
    its samples are ok with four pieces of evidence or more each.
    """
    each = samples.groupBy("slots").agg(F.avg("quality").alias("quality"), F.percentile("throughput", 0.5).alias("throughput"), F.min("evidence").alias("evidence"), F.bool_and("ok").alias("ok"))
    good = each.where("ok and evidence >= 4").where(F.col("quality") >= least_quality)
    near = good.join(good.agg(F.max("quality").alias("best")), F.col("quality") >= F.col("best") - 0.05)
    fast = near.join(near.agg(F.max("throughput").alias("peak")), F.col("throughput") >= 0.97 * F.col("peak"))
    return fast.agg(F.min("slots").alias("slots"))
