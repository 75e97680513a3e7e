"""Numbers as Italian reports write them, reference ranges, unit conversion, check characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let


def italian_number(text: Column) -> Column:
    """'1.234,56', '1234,5', '1.234.567', '12.5' to a double; null if it is no number.

    With a comma, dots are thousands marks; two dots or more are too; one dot alone is a
    decimal point.
    """

    def read(bare: Column) -> Column:
        return (
            F.when(bare.contains(","), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(bare.rlike(r"^[+-]?\d{1,3}(\.\d{3}){2,}$"), F.replace(bare, F.lit("."), F.lit("")))
            .otherwise(bare)
        )

    plain = let(F.regexp_replace(F.trim(text), r"\s", ""), read)
    return let(plain, lambda x: F.when(x.rlike(r"^[+-]?\d+(\.\d+)?$"), x.try_cast("double")))


def reference_range(text: Column) -> Column:
    """struct(low, high) of 'a-b', '<b' or '>a'; null bounds where open or unreadable."""
    number = r"(\d+(?:[.,]\d+)?)"
    both = rf"^\s*{number}\s*-\s*{number}\s*$"
    below, above = rf"^\s*<=?\s*{number}\s*$", rf"^\s*>=?\s*{number}\s*$"
    got = lambda t, p, i: F.replace(F.regexp_extract(t, p, i), F.lit(","), F.lit(".")).try_cast("double")
    return let(text, lambda t: F.struct(F.coalesce(got(t, both, 1), got(t, above, 1)).alias("low"), F.coalesce(got(t, both, 2), got(t, below, 1)).alias("high")))


def converted(value: Column, factor: Column, offset: Column) -> Column:
    """Linear unit conversion."""
    return value * factor + offset


def relative_change(before: Column, after: Column) -> Column:
    """|after - before| / |before|; null when either is null; infinite from zero unless both are zero."""
    return F.when(before == 0, F.when(after == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.abs(after - before) / F.abs(before))


#: Weights of characters at odd places of a 15-character fiscal code, for 0-9 and A-Z.
ODD_WEIGHTS = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21]
ODD_LETTERS = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]


def check_letter(code: Column) -> Column:
    """The 16th character (sum of place weights modulo 26) of a 15-character fiscal code; null for other lengths."""
    odd = F.array(*[F.lit(x) for x in ODD_WEIGHTS + ODD_LETTERS])
    rank = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    weight = lambda c, i: F.when(i % 2 == 0, F.get(odd, rank(c))).otherwise(F.when(rank(c) >= 10, rank(c) - 10).otherwise(rank(c)))
    characters = F.split(F.upper(code), "")
    total = F.aggregate(F.transform(characters, weight), F.lit(0), lambda a, x: a + x)
    return F.when(code.rlike("^[0-9A-Za-z]{15}$"), F.char(total % 26 + 65))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def safe_refs(refs: Column, count: Column, most: int = 6) -> Column:
    """Sentence numbers parsed, kept within 1..count, distinct, ascending, at most ``most``."""
    numbers = F.transform(refs, lambda x: F.regexp_extract(x, r"(\d+)", 1).try_cast("int"))
    return F.slice(F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(1, count)))), 1, most)
