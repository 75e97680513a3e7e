"""Partial dates: text of a year, a month or a day, kept as text, with derived bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

#: Italian month names by number.
MONTHS = {
    "gennaio": 1, "febbraio": 2, "marzo": 3, "aprile": 4, "maggio": 5, "giugno": 6,
    "luglio": 7, "agosto": 8, "settembre": 9, "ottobre": 10, "novembre": 11, "dicembre": 12,
}


def precision(text: Column) -> Column:
    """'day', 'month', 'year' or 'unknown' from the shape of the text."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(text.rlike(r"^\d{4}-\d{2}$"), "month").when(text.rlike(r"^\d{4}$"), "year").otherwise("unknown")


def lower_bound(text: Column) -> Column:
    """First day the partial date can mean; null if unknown or impossible."""
    full = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date")


def upper_bound(text: Column) -> Column:
    """Last day the partial date can mean; null if unknown or impossible."""
    lo = lower_bound(text)
    return F.when(text.rlike(r"^\d{4}$"), F.make_date(F.year(lo), F.lit(12), F.lit(31))).when(text.rlike(r"^\d{4}-\d{2}$"), F.last_day(lo)).otherwise(lo)


def distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Days between two intervals, 0 when they overlap, null when a bound is unknown."""
    known = lo1.isNotNull() & hi1.isNotNull() & lo2.isNotNull() & hi2.isNotNull()
    return F.when(known, F.greatest(F.lit(0), F.datediff(lo2, hi1), F.datediff(lo1, hi2)))


def subtract(day: Column, amount: Column, unit: Column) -> Column:
    """A day earlier by so many days, weeks, months or years; clamped to the month's end."""
    return (
        F.when(unit == "day", F.date_sub(day, amount))
        .when(unit == "week", F.date_sub(day, amount * 7))
        .when(unit == "month", F.add_months(day, -amount))
        .when(unit == "year", F.add_months(day, -12 * amount))
    )


def sort_key(text: Column) -> Column:
    """Lower bound for ordering; unknown dates last."""
    return F.coalesce(lower_bound(text), F.lit("9999-12-31").cast("date"))


def parse_italian(text: Column, month_year: bool = True) -> Column:
    """ISO text of the first date found by five forms in order, null if none gives a day of 1900 to 2100.

    Forms: day, month, year parted by one of / - . (two-digit years below 50 are 20xx);
    the same parted by single blanks; year first; day, month's name, year; month's name,
    day, year. A form whose first match is no such day gives way to the next. With
    ``month_year`` a month and year alone (06/2018) come last, as the month's first day.
    """
    months = F.create_map(*[x for name, n in MONTHS.items() for x in (F.lit(name), F.lit(n))])
    names = "|".join(MONTHS)
    number = lambda found, pattern, i: F.regexp_extract(found, pattern, i).try_cast("int")
    name = lambda found, pattern, i: F.try_element_at(months, F.lower(F.regexp_extract(found, pattern, i)))
    full = lambda y: F.when(y >= 100, y).when(y < 50, y + 2000).otherwise(y + 1900)

    def made(d: Column) -> Column:
        stamp = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", d["y"], d["m"], d["d"]), F.lit("yyyy-MM-dd"))
        return F.when(d["y"].between(1900, 2100) & d["m"].isNotNull() & d["d"].isNotNull(), F.date_format(stamp, "yyyy-MM-dd"))

    def form(pattern: str, year, month, day) -> Column:
        """The form's first match is looked for once; its parts are read only where there is one."""
        parts = lambda t: F.struct(year(t).alias("y"), month(t).alias("m"), day(t).alias("d"))
        return F.when(text.rlike(pattern), let(parts(text), made))

    def ordered(pattern: str, year: int, month: int, day: int, short: bool = False, named: bool = False) -> Column:
        y = lambda t: let(number(t, pattern, year), full) if short else number(t, pattern, year)
        return form(pattern, y, lambda t: (name if named else number)(t, pattern, month), lambda t: number(t, pattern, day))

    marks, blanks = (rf"(?<!\d)(\d{{1,2}}){s}(\d{{1,2}}){s}(\d{{2,4}})(?!\d)" for s in ("[/.-]", " "))
    year_first, named, month_first = r"(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})", rf"(?i)(\d{{1,2}})\s+({names})\s+(\d{{4}})", rf"(?i)({names})\s+(\d{{1,2}}),?\s+(\d{{4}})"
    alone = r"(?<![\d/.-])(\d{1,2})/(\d{4})(?![\d/])"
    forms = [ordered(marks, 3, 2, 1, short=True), ordered(blanks, 3, 2, 1, short=True), ordered(year_first, 1, 2, 3), ordered(named, 3, 2, 1, named=True), ordered(month_first, 3, 1, 2, named=True)]
    if month_year:
        forms.append(form(alone, lambda t: number(t, alone, 2), lambda t: number(t, alone, 1), lambda t: F.lit(1)))
    # no form matches a text without digits
    return F.when(text.rlike(r"\d"), F.coalesce(*forms))


def offset_band(days: Column) -> Column:
    """Days since an anchor as a band; null days are undated."""
    return F.when(days.isNull(), "undated").when(days < 0, "<0").when(days <= 14, "<=14").when(days <= 112, "<=112").when(days <= 365, "<=365").otherwise(">365")
