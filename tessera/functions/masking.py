"""Numbers and dates of a text as tokens without digits, and back: a reversible code for texts that something else rewrites.

The token of the n-th number is [[VALORE_A]], [[VALORE_B]], ... [[VALORE_AA]] ..., of a page
marker [[PAGINA_..]], in one count. A rewritten text is accepted only if its tokens are the
source's in the source's order and it brings no number of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

#: Page markers, numbers and dates, tokens, and what is left of a damaged token.
PAGE = r"\[PAGINA\s+\d+\]"
NUMBER = r"\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?|\d{1,2}:\d{2}|[+-]?\d+(?:[.,]\d+)*(?:\s?%|\s?°C)?"
TOKEN = r"\[\[(?:VALORE|PAGINA)_[A-Z]+\]\]"
DAMAGED = r"(?i)\[\[?\s*(?:VALORE|PAGINA)[\s_-]+[A-Z]+"
NOTHING = "[NESSUN CONTENUTO CLINICO]"
_LITERAL = f"(?iU)(?:{PAGE}|{NUMBER})"


def _letters(n: Column) -> Column:
    """A, B, ... Z, AA, AB, ... for 0, 1, ...; up to four letters."""
    digit = lambda x: F.char((x + 65).cast("long"))
    steps = [26, 26 + 26**2, 26 + 26**2 + 26**3]
    one = digit(n)
    two = F.concat(digit(F.floor((n - 26) / 26)), digit((n - 26) % 26))
    m = n - steps[1]
    three = F.concat(digit(F.floor(m / 676)), digit(F.floor(m / 26) % 26), digit(m % 26))
    k = n - steps[2]
    four = F.concat(digit(F.floor(k / 17576)), digit(F.floor(k / 676) % 26), digit(F.floor(k / 26) % 26), digit(k % 26))
    return F.when(n < steps[0], one).when(n < steps[1], two).when(n < steps[2], three).otherwise(four)


def literals(text: Column) -> Column:
    """The page markers and numbers of a text as they are written, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LITERAL), F.lit(0))


def _tokens(found: Column) -> Column:
    return F.transform(found, lambda x, i: F.concat(F.lit("[["), F.when(x.rlike("(?i)^" + PAGE + "$"), "PAGINA").otherwise("VALORE"), F.lit("_"), _letters(i), F.lit("]]")))


def _woven(between: Column, tokens: Column) -> Column:
    return F.array_join(F.zip_with(between, tokens, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def masked(text: Column) -> Column:
    """The text with a token for each literal; a null text is empty."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(literals(t), lambda found: _woven(F.split(t, _LITERAL, -1), _tokens(found))))


def restored(output: Column, source: Column) -> Column:
    """struct(text, problem): the output with its source's literals in place of its tokens, or null and what is wrong.

    Problems, in order: 'empty', 'unknown_token', 'duplicated_token', 'reordered',
    'new_number', 'damaged_token'. A token that stands twice is dropped where it stands
    again if what is left is in the source's order. An output that says that there is
    nothing is left as it is. Tokens may be left out.
    """
    given = F.struct(F.coalesce(output, F.lit("")).alias("text"), literals(source).alias("found"))

    def read(g: Column) -> Column:
        return F.struct(g["text"].alias("text"), g["found"].alias("found"), _tokens(g["found"]).alias("known"), F.regexp_extract_all(g["text"], F.lit(TOKEN), F.lit(0)).alias("used"), F.split(g["text"], TOKEN, -1).alias("between"))

    def placed(r: Column) -> Column:
        at = F.transform(r["used"], lambda t: F.array_position(r["known"], t))
        first = F.transform(r["used"], lambda t, i: F.array_position(r["used"], t) == i + 1)
        return F.struct(r["text"].alias("text"), r["found"].alias("found"), r["between"].alias("between"), at.alias("at"), first.alias("first"))

    def checked(p: Column) -> Column:
        once = F.filter(p["at"], lambda a, i: F.get(p["first"], i))
        in_order = F.forall(F.sequence(F.lit(0), F.size(once)), lambda i: F.coalesce(F.get(once, i) < F.get(once, i + 1), F.lit(True)))
        shown = F.transform(p["at"], lambda a, i: F.when(F.get(p["first"], i), F.get(p["found"], (a - 1).cast("int"))).otherwise(""))
        whole = _woven(p["between"], shown)
        problem = (
            F.when(F.trim(p["text"]) == "", "empty").when(p["text"] == NOTHING, F.lit(None))
            .when(F.exists(p["at"], lambda a: a == 0), "unknown_token").when(~in_order & F.exists(p["first"], lambda x: ~x), "duplicated_token").when(~in_order, "reordered")
            .when(F.size(literals(F.array_join(p["between"], " "))) > 0, "new_number").when(whole.rlike(DAMAGED), "damaged_token")
        )
        return F.struct(F.when(problem.isNull(), F.when(p["text"] == NOTHING, p["text"]).otherwise(whole)).alias("text"), problem.alias("problem"))

    return let(let(let(given, read), placed), checked)
