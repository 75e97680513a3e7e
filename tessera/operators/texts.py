"""Operators over document text: lines, sections, sentences, chunks, fingerprints, classification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import let


def lines(df: DataFrame, text: str = "text", number: str = "line_no", line: str = "line") -> DataFrame:
    """One row for each line, numbered from 1; a null text has none."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(text, "\n")).alias("_p", line)).withColumn(number, F.col("_p") + 1).drop("_p")


def without_repeated_lines(text: Column, least: int = 3, longer_than: int = 2) -> Column:
    """Drop lines that, trimmed and longer than two characters, occur three times or more in the text.

    Counts come from the sorted list of the text's own lines, so the operator is one
    expression and a text never leaves its row.
    """
    trimmed = lambda each: F.array_sort(F.filter(F.transform(each, lambda x: F.trim(x)), lambda x: F.length(x) > longer_than))
    # in a sorted list a line occurs ``least`` times if it equals the one ``least - 1`` places on
    often = lambda rows: F.array_distinct(F.filter(rows, lambda x, i: x == F.get(rows, i + (least - 1))))
    kept = lambda each, many: F.array_join(F.filter(each, lambda x: ~F.array_contains(many, F.trim(x))), "\n")
    return let(F.split(text, "\n"), lambda each: let(let(trimmed(each), often), lambda many: kept(each, many)))


HEADING_MOST = 100


def is_heading(line: Column, upper_share: float = 0.85) -> Column:
    """A '#' line, one that ends in a colon, or one whose letters are mostly capitals; at most 100 characters."""
    t = F.trim(line)
    letters, upper = F.regexp_count(t, F.lit(r"[A-Za-z]")), F.regexp_count(t, F.lit(r"[A-Z]"))
    shape = t.startswith("#") | t.endswith(":") | ((letters > 0) & (upper > upper_share * letters))
    return (F.length(t) > 0) & (F.length(t) <= HEADING_MOST) & shape


def with_sections(line_rows: DataFrame, document: str, number: str = "line_no", line: str = "line") -> DataFrame:
    """Add section: the latest heading at or above the line; null before the first."""
    so_far = Window.partitionBy(document).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return line_rows.withColumn("section", F.last(F.when(is_heading(F.col(line)), F.trim(line)), ignorenulls=True).over(so_far))


def fingerprint(kind: Column, section: Column, line: Column, least_chars: int = 80, least_words: int = 10) -> Column:
    """sha256 of a reusable line in its context; null for short lines."""
    t = F.trim(F.regexp_replace(line, r"[ \t]+", " "))
    whole = F.concat_ws("\x1f", F.coalesce(kind, F.lit("")), F.coalesce(section, F.lit("")), t)
    return F.when((F.length(t) >= least_chars) & (F.size(F.split(t, " ")) >= least_words), F.sha2(whole, 256))


def block_owners(blocks: DataFrame, document: str, order: list[str], print_col: str = "fingerprint") -> DataFrame:
    """Each fingerprinted block with the first document that printed it and whether this row repeats it.

    The first owner is found by a grouping that combines on the map side, so a line that
    a third of all documents share costs one row a task.
    """
    first = blocks.where(F.col(print_col).isNotNull()).groupBy(print_col).agg(F.min(F.struct(*order)).alias("_first"))
    out = blocks.join(first, print_col).withColumn("owner", F.col(f"_first.{order[0]}"))
    return out.withColumn("reused", F.struct(*order) != F.col("_first")).drop("_first")


_SPANS = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))
_BREAK = re.compile(r"\n[ \t]*\n|(?<=[.!?;])\s+")


def spans_of(text: str, longest: int = 1200) -> Iterator[tuple[int, int]]:
    """Sentence spans with exact offsets: cut at blank lines and after .!?; and space; longer ones wrap at a space."""
    at, cuts = 0, [(m.start(), m.end()) for m in _BREAK.finditer(text)] + [(len(text), len(text))]
    for stop, resume in cuts:
        lo, hi = at, stop
        at = resume
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        while hi - lo > longest:
            cut = text.rfind(" ", lo + 1, lo + longest + 1)
            cut = lo + longest if cut <= lo else cut
            yield lo, cut
            lo = cut + (cut < hi and text[cut] == " ")
        if hi > lo:
            yield lo, hi


@F.pandas_udf(_SPANS)
def sentence_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [(i, a, b, t[a:b]) for i, (a, b) in enumerate(spans_of(t), 1)] if t is not None else None)


_CHUNKS = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))


def chunks_of(text: str, most: int) -> list[tuple[int, int, str]]:
    """Paragraphs packed greedily into chunks of at most max(1000, most) characters; longer ones are cut; nothing is lost."""
    most, out, begin = max(1000, most), [], 0
    parts, at = [], 0
    for m in re.finditer(r"\n[ \t]*\n", text):
        parts.append((at, m.end()))
        at = m.end()
    parts.append((at, len(text)))
    end = 0
    for lo, hi in parts:
        if hi - begin > most and end > begin:
            out.append((begin, end))
            begin = end
        while hi - begin > most:
            out.append((begin, begin + most))
            begin += most
        end = hi
        lo = begin
    if end > begin:
        out.append((begin, end))
    return [(i, a, text[a:b]) for i, (a, b) in enumerate(out, 1)]


def chunks(text: Column, most: int = 4000) -> Column:
    @F.pandas_udf(_CHUNKS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, most) if t is not None else None)

    return cut(text)


def weighted_class(scores: dict[str, Column], default: str = "other") -> Column:
    """The class with the highest positive score; the first in order on ties."""
    best = F.greatest(*scores.values())
    out = F.lit(None)
    for name, score in reversed(list(scores.items())):
        out = F.when((score == best) & (best > 0), name).otherwise(out)
    return F.coalesce(out, F.lit(default))


def keyword_score(text: Column, words: dict[str, int]) -> Column:
    """Sum of the weights of the words that occur."""
    total = F.lit(0)
    for word, weight in words.items():
        total = total + F.when(F.contains(F.lower(text), F.lit(word)), weight).otherwise(0)
    return total


def label_values(line_rows: DataFrame, document: str, is_label: Column, number: str = "line_no") -> DataFrame:
    """Lines that are neither a label nor the value line above one."""
    marked = line_rows.withColumn("_label", is_label)
    follows = F.coalesce(F.lead("_label").over(Window.partitionBy(document).orderBy(number)), F.lit(False))
    return marked.withColumn("_next", follows).where("not _label and not _next").drop("_label", "_next")


def quote_locations(documents: DataFrame, quotes: DataFrame, lead_words: int = 4) -> DataFrame:
    """(doc_id, item_id): documents whose space-normalized text contains a quote's.

    Blocked by the hash of the quote's first words: every document offers the distinct
    hashes of its word runs, and only these travel; texts are fetched for the pairs whose
    hashes meet, and compared. doc_id names one text.
    """
    norm = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))
    q = quotes.select("item_id", norm(F.col("text")).alias("quote")).where("quote != ''")
    q = q.withColumn("lead", F.xxhash64(F.array_join(F.slice(F.split("quote", " "), 1, lead_words), " ")))
    d = documents.select("doc_id", norm(F.col("text")).alias("whole"))
    run = lambda words, i: F.xxhash64(F.array_join(F.slice(words, i, lead_words), " "))
    runs = let(F.split("whole", " "), lambda words: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (lead_words - 1), F.lit(1))), lambda i: run(words, i)))
    keys = d.select("doc_id", F.explode(F.array_distinct(runs)).alias("lead"))
    met = keys.join(q.select("item_id", "lead"), "lead").select("doc_id", "item_id").distinct()
    pairs = met.join(q.select("item_id", "quote"), "item_id")
    return pairs.join(d, "doc_id").where(F.contains(F.col("whole"), F.col("quote"))).select("doc_id", "item_id").distinct()
