"""Materialized views over evidence: treatment lines, contextual attachment, event bundles, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import entity_key
from tessera.operators.evaluation import text_ratio
from tessera.operators.graph import components


def treatment_lines(df: DataFrame, subject: str, line: str, regimen: str, order: list[str], status: str) -> DataFrame:
    """Per subject and line (rows without a line go by their regimen): start, end if it ended, drugs in order of first use.

    The order's first column is the day.
    """
    key = F.coalesce(F.nullif(entity_key(F.col(line)), F.lit("")), F.concat(F.lit("unspecified_"), entity_key(F.col(regimen))))
    at, day = F.struct(*order), order[0]
    rows = df.where(F.col(line).isNotNull() | F.col(regimen).isNotNull()).withColumn("line_key", key)
    # the first use of each drug is what its place in the list goes by; a drug is one row whatever its uses
    drugs = rows.where(F.col(regimen).isNotNull()).groupBy(subject, "line_key", regimen).agg(F.min(at).alias("_at"))
    listed = drugs.groupBy(subject, "line_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", regimen))), lambda x: x[regimen]).alias("drugs"))
    out = rows.groupBy(subject, "line_key").agg(F.min(day).alias("start_date"), F.max_by(status, at).alias("status"), F.max(day).alias("_last"), F.count("*").alias("evidence"))
    ended = F.col("status").isin("completed", "suspended", "cancelled")
    return out.join(listed, [subject, "line_key"], "left").withColumn("end_date", F.when(ended, F.col("_last"))).drop("_last")


def attach_context(context: DataFrame, events: DataFrame, subject: str) -> DataFrame:
    """Each contextual row with its best event of the subject: (item_id, event_id, score).

    7 points for one entity, 2 for the category, 3 for the organ system, 3 for the
    document, 2 within 7 days or 1 within 30. Without the same entity, system and document
    must agree and the score reach 7. Ties go to the later date, then the greater id.
    Candidates come from two equality joins: same entity, or same system and document.
    """
    c = context.select(subject, "item_id", *[F.col(x).alias(f"c_{x}") for x in ("entity", "category", "system", "document", "day")])
    e = events.select(subject, "event_id", *[F.col(x).alias(f"e_{x}") for x in ("entity", "category", "system", "document", "day")])
    same = lambda *names: reduce(lambda a, b: a & b, [F.col(f"c_{n}") == F.col(f"e_{n}") for n in names])
    on = lambda *names: c.join(e, subject).where(same(*names)) if not names else c.join(e.withColumnsRenamed({f"e_{n}": f"c_{n}" for n in names}), [subject, *[f"c_{n}" for n in names]]).withColumns({f"e_{n}": F.col(f"c_{n}") for n in names})
    cols = [subject, "item_id", "event_id", *[f"{s}_{x}" for s in "ce" for x in ("entity", "category", "system", "document", "day")]]
    pairs = on("entity").select(cols).unionByName(on("system", "document").select(cols)).distinct()
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    gap = F.abs(F.datediff("c_day", "e_day"))
    score = points(same("entity"), 7) + points(same("category"), 2) + points(same("system"), 3) + points(same("document"), 3) + F.when(gap <= 7, 2).when(gap <= 30, 1).otherwise(0)
    scored = pairs.withColumn("score", score).where(F.coalesce(same("entity"), F.lit(False)) | (F.col("score") >= 7))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc_nulls_last("e_day"), F.desc("event_id"))
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("item_id", "event_id", "score")


def rare_word_pairs(df: DataFrame, subject: str, key: str, text: str, most: int = 60) -> DataFrame:
    """(a, b): rows of a subject that share a word which 2 to ``most`` of its rows hold.

    A word's rows are numbered and each meets the earlier ones, at most ``most`` of them.
    """
    words = df.select(subject, key, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))).alias("_w"))
    held = words.groupBy(subject, "_w").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, most)).select(subject, "_w")
    kept = words.join(held, [subject, "_w"])
    a, b = kept.withColumnRenamed(key, "a"), kept.withColumnRenamed(key, "b")
    return a.join(b, [subject, "_w"]).where("a < b").select("a", "b").distinct()


def merge_bundles(df: DataFrame, subject: str, key: str, text: str, day: str, category: str, polarity: str, confidence: str, least_same_day: float = 0.85, least: float = 0.90) -> DataFrame:
    """(key, survivor): bundles that tell the same, merged only where all of a group's pairs agree.

    Candidates share the date and category, or a rare word. A pair agrees if polarities do
    and the texts' ratio reaches the threshold. A component is merged if its agreeing pairs
    are n (n - 1) / 2; the survivor has the longest text, then confidence, then least key.
    """
    dated = df.select(subject, day, category, F.col(key).alias("_k"))
    same_day = dated.withColumnRenamed("_k", "a").join(dated.withColumnRenamed("_k", "b"), [subject, day, category]).where("a < b").select("a", "b")
    pairs = same_day.unionByName(rare_word_pairs(df, subject, key, text)).distinct()
    side = lambda x: df.select(F.col(key).alias(x), F.col(text).alias(f"t_{x}"), F.col(day).alias(f"d_{x}"), F.col(polarity).alias(f"p_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("p_a = p_b").where(2 * F.least(F.length("t_a"), F.length("t_b")) >= least_same_day * (F.length("t_a") + F.length("t_b")))
    scored = both.withColumn("_r", text_ratio("t_a", "t_b")).where(F.col("_r") >= F.when(F.col("d_a") == F.col("d_b"), least_same_day).otherwise(least))
    agreed = scored.select("a", "b").checkpoint()
    of = components(agreed, df.select(F.col(key).alias("node")))
    edges = agreed.join(of.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("_edges"))
    sizes = of.groupBy("component").agg(F.count("*").alias("_n"))
    whole = sizes.join(edges, "component").where(F.col("_edges") == F.col("_n") * (F.col("_n") - 1) / 2).select("component")
    members = of.withColumnRenamed("node", key).join(whole, "component").join(df.select(key, text, confidence), key)
    lead = members.groupBy("component").agg(F.min_by(key, F.struct(-F.length(text), -F.col(confidence), F.col(key))).alias("survivor"))
    return df.select(key).join(members.select(key, "component"), key, "left").join(lead, "component", "left").select(key, F.coalesce("survivor", key).alias("survivor"))


#: Labels of a report's header and the field each gives.
HEADER_LABELS = {"department": r"(?iu)^(?:reparto|unità operativa|u\.o\.)\s*[:\-]\s*(.+)$", "provenance": r"(?iu)^(?:provenienza|ambulatorio)\s*[:\-]\s*(.+)$", "service": r"(?iu)^(?:prestazion[ei]|esam[ei])\s*[:\-]\s*(.+)$"}
SPECIALTIES = {"oncology": "oncolog", "cardiology": "cardiolog", "radiology": "radiolog", "laboratory": "laborator"}
TYPE_HINTS = {"radiology": "imaging_report", "laboratory": "lab_report"}


def header_metadata(lines: DataFrame, document: str, number: str = "line_no", line: str = "line", most: int = 40) -> DataFrame:
    """Per document: department, provenance, services, specialty, type_hint, confidence from its first lines.

    Confidence adds .35 for a place, .45 for services, .15 for a specialty, .05 for a hint.
    """
    head = lines.where(F.col(number) <= most)
    got = {name: F.nullif(F.trim(F.regexp_extract(F.trim(line), p, 1)), F.lit("")) for name, p in HEADER_LABELS.items()}
    rows = head.select(document, number, *[v.alias(k) for k, v in got.items()]).where(" or ".join(f"{k} is not null" for k in got))
    out = rows.groupBy(document).agg(
        F.max_by("department", F.when(F.col("department").isNotNull(), F.col(number))).alias("department"),
        F.max_by("provenance", F.when(F.col("provenance").isNotNull(), F.col(number))).alias("provenance"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("service").isNotNull(), F.struct(number, "service")))), lambda x: x["service"])).alias("services"),
    )
    said = F.lower(F.concat_ws(" ", "department", "provenance", F.array_join("services", " ")))
    specialty = F.coalesce(*[F.when(F.contains(said, F.lit(stem)), name) for name, stem in SPECIALTIES.items()])
    hint = F.coalesce(*[F.when(F.col("specialty") == k, v) for k, v in TYPE_HINTS.items()])
    out = out.withColumn("specialty", specialty).withColumn("type_hint", hint)
    add = lambda test, n: F.when(test, n).otherwise(0.0)
    place = F.col("department").isNotNull() | F.col("provenance").isNotNull()
    total = add(place, 0.35) + add(F.size("services") > 0, 0.45) + add(F.col("specialty").isNotNull(), 0.15) + add(F.col("type_hint").isNotNull(), 0.05)
    return out.withColumn("confidence", F.round(total, 2))


def listing(df: DataFrame, subject: str, order: list[str], parts: list[Column]) -> DataFrame:
    """One compact text of a subject's rows, a line each, in order."""
    rows = df.select(subject, F.struct(*order, F.concat_ws(" | ", *parts).alias("_line")).alias("_row"))
    grouped = rows.groupBy(subject).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    return grouped.select(subject, F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n").alias("listing"))


def lockable(cases: DataFrame, annotations: DataFrame, reviewers: int = 2) -> DataFrame:
    """Gold cases that may be locked: submitted by all reviewers, with no disagreement left without adjudication."""
    each = annotations.groupBy("case_id").agg(F.count_distinct(F.when(F.col("submitted"), F.col("reviewer"))).alias("_who"), F.count_if(~F.col("agreed") & F.col("adjudicated").isNull()).alias("_open"))
    return cases.join(each, "case_id", "left").withColumn("lockable", F.coalesce((F.col("_who") >= reviewers) & (F.col("_open") == 0), F.lit(False))).drop("_who", "_open")
