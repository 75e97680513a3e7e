"""Dates as notes write them: exact, partial, intervals and durations before a report, as column expressions.

A date that is not written stays unknown: a report's own date only supplies the year of a
day and month, or is what a duration counts back from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import MONTHS, lower_bound, parse_italian, precision, subtract
from tessera.functions.text import let

#: Numbers in words, fillers before a date, words of doubt, and the shapes of dates and durations.
NUMBERS = {"un": 1, "uno": 1, "una": 1, "due": 2, "tre": 3, "quattro": 4, "cinque": 5, "sei": 6, "sette": 7, "otto": 8, "nove": 9, "dieci": 10, "undici": 11, "dodici": 12}
UNITS = {"giorn": "day", "settiman": "week", "mes": "month", "ann": "year"}
FILLERS = r"(?iU)\b(?:circa|dal|dalla|da|il|nel|nell'|in\s+data|approssimativamente|intorno\s+al)\b"
DOUBT = r"(?U)\b(?:circa|approssimativamente|verosimilmente|intorno|da\s+anni)\b"
NAMES = "|".join(MONTHS)
DURATION = rf"(?iU)\b(?:da(?:\s+circa)?|circa\s+da)\s+(\d+|{'|'.join(NUMBERS)})\s+(giorn(?:o|i)|settiman(?:a|e)|mes(?:e|i)|ann(?:o|i))\b"
SPAN_OF_MONTH = rf"(?i)^dal\s+(\d{{1,2}})\s+al\s+(\d{{1,2}})\s+({NAMES})(?:\s+((?:19|20)\d{{2}}))?$"
WITHOUT_YEAR = rf"(?i)^(?:il\s+|dal\s+|del\s+|al\s+)?\d{{1,2}}\s+(?:{NAMES})$"
FROM_TO = r"(?i)(?:tra|dal)\s+(.+?)\s+(?:e|al)\s+(.+)$"
EXPLICIT = rf"(?iU)\b(?:\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{4}}|\d{{2}})|(?:19|20)\d{{2}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}\s+(?:{NAMES})(?:\s+(?:19|20)\d{{2}})?|(?:{NAMES})\s+(?:19|20)\d{{2}})\b"
SPAN_IN_TEXT = rf"(?iU)\bdal\s+\d{{1,2}}\s+al\s+\d{{1,2}}\s+(?:{NAMES})(?:\s+(?:19|20)\d{{2}})?\b"
HEADING = rf"(?iU)^(?:(?:in\s+)?data\s+)?(?:\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{4}}|\d{{2}})|(?:19|20)\d{{2}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}\s+(?:{NAMES})|(?:{NAMES})\s+(?:19|20)\d{{2}})\b"
REFERS_BACK = r"(?iU)\b(?:nella\s+stessa\s+data|in\s+tale\s+data|in\s+quella\s+data|alla\s+dimissione|successivamente|il\s+giorno\s+seguente)\b"
#: A dose's date is not the date of another fact in its quote.
OTHER_DATE = r"(?iU)\bultima\s+somministrazione\b[^.;]*\b\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})\b"
PRECISIONS = ["day", "month", "year", "interval", "approximate"]


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def _lookup(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def single_date(text: Column) -> Column:
    """ISO text of one date, of a day, a month or a year, or null; fillers such as 'dal' are ignored."""
    named = rf"(?i)^({NAMES})\s+((?:19|20)\d{{2}})$"

    def read(bare: Column) -> Column:
        day = F.when(lower_bound(bare).isNotNull(), bare)
        month = F.when(_found(bare, r"^(\d{4})-(\d{1,2})$", 2).try_cast("int").between(1, 12), F.concat(F.substring(bare, 1, 5), F.lpad(_found(bare, r"^\d{4}-(\d{1,2})$", 1), 2, "0")))
        worded = F.when(bare.rlike(named), F.concat_ws("-", _found(bare, named, 2), F.lpad(_lookup(F.lower(_found(bare, named, 1)), MONTHS).cast("string"), 2, "0")))
        other = F.coalesce(month, F.when(bare.rlike(r"^(?:19|20)\d{2}$"), bare), parse_italian(bare, month_year=True), worded)
        return F.when(bare.rlike(r"\d"), F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise(other))  # each of them has a digit

    return let(F.regexp_replace(F.regexp_replace(_spaced(text), FILLERS, " "), r"^[ ,;:]+|[ ,;:]+$", ""), read)


def counted_back(text: Column, report: Column) -> Column:
    """The day a duration in the text ('da tre settimane') lies before the report's day, or null; reports of a month or year count for nothing."""
    def number(amount: Column) -> Column:
        return F.coalesce(amount.try_cast("int"), _lookup(F.lower(amount), NUMBERS))

    def day(d: Column) -> Column:
        kind = F.coalesce(*[F.when(d["unit"].startswith(stem), name) for stem, name in UNITS.items()])
        return F.date_format(subtract(lower_bound(report), let(d["amount"], number), kind), "yyyy-MM-dd")

    parts = F.struct(_found(text, DURATION, 1).alias("amount"), F.lower(_found(text, DURATION, 2)).alias("unit"))
    return F.when((precision(report) == "day") & text.rlike(DURATION), let(parts, day))


def normalized(value: Column, report: Column, end: Column | None = None, stated: Column | None = None) -> Column:
    """struct(start, end, precision, source, approximate) of what a note writes as a date.

    Tried in order: a single date; a span of days of one month; day and month with the
    report's year; 'dal ... al ...' or 'tra ... e ...'; a duration before the report's day.
    ``end`` is a separately given end, ``stated`` a precision that holds instead of the
    written one. Doubt ('circa') makes it approximate unless it is an interval. Nothing
    found gives nulls and 'unknown'.
    """
    none = F.lit(None).cast("string")
    given = F.struct(_spaced(value).alias("text"), _spaced(none if end is None else end).alias("last"), report.cast("string").alias("report"), _found(report, r"^((?:19|20)\d{2})", 1).alias("year"))

    def dates(g: Column) -> Column:
        """All that can be read: the single date, both ends of a span of days and of 'from ... to', the given end, the day counted back."""
        with_year = lambda t: F.when(t.rlike(WITHOUT_YEAR) & g["year"].isNotNull(), single_date(F.concat_ws(" ", t, g["year"])))
        own = F.coalesce(_found(g["text"], SPAN_OF_MONTH, 4), g["year"])
        day = lambda k: F.when(g["text"].rlike(SPAN_OF_MONTH) & own.isNotNull(), single_date(F.concat_ws(" ", _found(g["text"], SPAN_OF_MONTH, k), _found(g["text"], SPAN_OF_MONTH, 3), own)))
        return F.struct(
            F.coalesce(single_date(g["text"]), with_year(g["text"])).alias("single"), (g["text"].rlike(SPAN_OF_MONTH) & own.isNotNull()).alias("spanned"), day(1).alias("first"), day(2).alias("second"),
            single_date(_found(g["text"], FROM_TO, 1)).alias("a"), single_date(_found(g["text"], FROM_TO, 2)).alias("b"), F.coalesce(single_date(g["last"]), with_year(g["last"])).alias("end"),
            counted_back(g["text"], g["report"]).alias("back"), F.lower(g["text"]).rlike(DOUBT).alias("doubt"),
        )

    def chosen(d: Column) -> Column:
        between = ~d["spanned"] & d["single"].isNull() & d["a"].isNotNull() & d["b"].isNotNull()
        start = F.when(d["spanned"], d["first"]).otherwise(F.coalesce(d["single"], F.when(between, d["a"])))
        finish = F.when(d["spanned"], d["second"]).when(between, d["b"]).otherwise(d["end"])
        return F.struct(start.alias("start"), finish.alias("end"), (d["spanned"] | between).alias("span"), (d["spanned"] | d["end"].isNotNull()).alias("ended"), d["back"].alias("back"), d["doubt"].alias("doubt"))

    def result(c: Column) -> Column:
        written = F.when(c["span"], "interval").otherwise(precision(c["start"]))
        kept = written if stated is None else F.when(stated.isin(PRECISIONS), stated).otherwise(written)
        kept = F.when(c["end"].isNotNull() & c["ended"], "interval").when(c["doubt"] & (kept != "interval"), "approximate").otherwise(kept)
        out = lambda s, e, p, source, doubt: F.struct(s.alias("start"), e.alias("end"), p.alias("precision"), F.lit(source).alias("source"), doubt.alias("approximate"))
        return (
            F.when(c["start"].isNotNull(), out(c["start"], c["end"], kept, "explicit_or_retroactive", c["doubt"]))
            .when(c["back"].isNotNull(), out(c["back"], none, F.lit("approximate"), "retrospective_duration", F.lit(True)))
            .otherwise(out(none, none, F.lit("unknown"), "unknown", c["doubt"]))
        )

    return let(let(let(given, dates), chosen), result)


def explicit_date(text: Column) -> Column:
    """The first date a text writes out, as it is written, or null."""
    return _found(text, EXPLICIT)


def chosen_expression(quote: Column, category: Column) -> Column:
    """What of a quote tells a fact's date: a duration, a span of days, else a written date, unless that is another event's (the last dose's, for what is no medication)."""
    scoped = ~F.coalesce(category == "medication", F.lit(False)) & F.coalesce(quote, F.lit("")).rlike(OTHER_DATE)
    return F.coalesce(_found(quote, DURATION), _found(quote, SPAN_IN_TEXT), F.when(~scoped, explicit_date(quote)))


def duration_anchor(expression: Column, quote: Column, governing: Column, report: Column) -> Column:
    """The day that a duration counts back from: one written in its quote, else its section's, else the report's; for what is no duration the report's."""
    none = F.lit(None).cast("string")

    def day(text: Column) -> Column:
        return let(normalized(text, none), lambda found: F.when(found["precision"] == "day", found["start"]))

    return F.when(F.coalesce(expression, F.lit("")).rlike(DURATION), F.coalesce(day(explicit_date(quote)), day(governing), report)).otherwise(report)


def is_date_heading(sentence: Column) -> Column:
    """True for a short line that opens with a date: at most eight words and 120 characters."""
    text = F.regexp_replace(_spaced(sentence), "^[ :–—-]+|[ :–—-]+$", "")
    return (F.length(text) <= 120) & (F.size(F.split(text, " ")) <= 8) & text.rlike(HEADING)


def with_governing_date(sentences: DataFrame, document: str, number: str, sentence: str, farthest: int = 6) -> DataFrame:
    """Add governing_date (as written) and governing_number: the nearest of the ``farthest`` sentences before that is a date heading, or for a sentence that refers back ('in tale data') that writes any date; null if none does."""
    before = Window.partitionBy(document).orderBy(number).rowsBetween(-farthest, -1)
    dated = F.struct(explicit_date(F.col(sentence)).alias("date"), F.col(number).alias("at"))
    near = lambda test: F.last(F.when(test & explicit_date(F.col(sentence)).isNotNull(), dated), ignorenulls=True).over(before)
    found = F.when(F.coalesce(F.col(sentence), F.lit("")).rlike(REFERS_BACK), near(F.lit(True))).otherwise(near(is_date_heading(F.col(sentence))))
    return sentences.withColumn("_found", found).withColumns({"governing_date": F.col("_found.date"), "governing_number": F.col("_found.at")}).drop("_found")
