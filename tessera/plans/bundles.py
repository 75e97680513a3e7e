"""Queries that reduce evidence to bundles and registry rows, and normalize dates and numbers; events stand for evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import bundles
from tessera.plans.registry import query, read

_SIGNS = ["critical", "high", "clinically_relevant", "potentially_relevant", "uncertain"]
_SURE = ["confirmed", "patient_reported", "suspected", "inferred", "excluded", "unknown"]
_MODES = ["present", "absent", "unknown"]


def _pick(values: list, by: str):
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({by} as int)"))


def _pick_sql(values: list, by: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{by} + 1]"


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence: a bundle is a user and a type."""
    df = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"))
    return df.select(
        "*",
        _pick(_SIGNS, "event_id * 7 % 5").alias("significance"),
        _pick(_SURE, "event_id * 11 % 6").alias("certainty"),
        _pick(_MODES, "event_id % 3").alias("assertion"),
        (F.col("event_id") % 17 != 0).alias("verified"),
        F.expr("event_id % 23").alias("document_id"),
        F.when(F.expr("event_id % 4 = 1"), F.concat(F.lit("setting "), F.expr("cast(event_id % 5 as string)"))).otherwise("").alias("setting"),
    )


_EVIDENCE = f"""e AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day, {_pick_sql(_SIGNS, 'event_id * 7 % 5')} AS significance, {_pick_sql(_SURE, 'event_id * 11 % 6')} AS certainty,
  {_pick_sql(_MODES, 'event_id % 3')} AS assertion, event_id % 17 <> 0 AS verified, event_id % 23 AS document_id, CASE WHEN event_id % 4 = 1 THEN 'setting ' || CAST(event_id % 5 AS VARCHAR) ELSE '' END AS setting FROM events)"""
_RANK = lambda column, values: "CASE " + " ".join(f"WHEN bool_or({column} = '{v}') THEN '{v}'" for v in values) + " END"


@query(f"""WITH {_EVIDENCE}, b AS (SELECT user_id, event_type, {_RANK('significance', _SIGNS)} AS significance, {_RANK('certainty', _SURE)} AS certainty,
    CASE WHEN bool_or(assertion = 'present') THEN 'present' WHEN bool_and(assertion = 'absent') THEN 'absent' ELSE 'unknown' END AS assertion,
    0.55 + CASE WHEN bool_and(verified) THEN 0.15 ELSE 0 END + CASE WHEN count(DISTINCT document_id) > 1 THEN 0.1 ELSE 0 END - CASE WHEN bool_or(assertion = 'present') AND bool_or(assertion = 'absent') THEN 0.25 ELSE 0 END
      - CASE WHEN bool_or(certainty IN ('inferred', 'suspected')) THEN 0.1 ELSE 0 END AS c FROM e GROUP BY ALL)
  SELECT user_id, event_type, significance, certainty, assertion, CAST(round(greatest(0, least(c, 0.95)), 3) AS DOUBLE) AS confidence FROM b""")
def bundle_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.reduced(evidence_rows(spark, sf_dir), ["user_id", "event_type"])


@query(f"""WITH {_EVIDENCE}, m AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), k AS (SELECT user_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM m),
  s AS (SELECT user_id, setting, row_number() OVER (PARTITION BY user_id ORDER BY day, event_id) AS r FROM e WHERE setting <> '')
  SELECT k.user_id, kind, setting FROM k LEFT JOIN s ON k.user_id = s.user_id AND s.r = 1 WHERE k.r = 1""")
def bundle_mode_and_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evidence_rows(spark, sf_dir)
    return bundles.mode(df, ["user_id"], "event_type", "kind").join(bundles.first_filled(df, ["user_id"], "setting", ["day", "event_id"]), "user_id", "left")


@query(f"""WITH {_EVIDENCE}, f AS (SELECT *, min(day) OVER (PARTITION BY user_id, event_type) AS first_day FROM e)
  SELECT user_id, event_type, day, string_agg(DISTINCT assertion, '; ' ORDER BY assertion) AS summary, count(*) AS items FROM f WHERE day <> first_day GROUP BY ALL""")
def bundle_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.updates(evidence_rows(spark, sf_dir), ["user_id", "event_type"], "day", "assertion")


_PARTIAL = "CASE event_id % 4 WHEN 0 THEN strftime(day, '%Y') WHEN 1 THEN strftime(day, '%Y-%m') WHEN 2 THEN strftime(day, '%Y-%m-%d') END"


@query(f"""WITH {_EVIDENCE}, p AS (SELECT *, {_PARTIAL} AS observed FROM e), b AS (SELECT *, CASE length(observed) WHEN 4 THEN CAST(observed || '-01-01' AS DATE) WHEN 7 THEN CAST(observed || '-01' AS DATE) WHEN 10 THEN CAST(observed AS DATE) END AS lo FROM p)
  SELECT event_id, observed FROM b WHERE lo BETWEEN DATE '2024-01-01' AND DATE '2024-06-30' AND event_type IN ('click', 'signup')""")
def timeline_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evidence_rows(spark, sf_dir)
    observed = F.when(F.expr("event_id % 4 = 0"), F.date_format("day", "yyyy")).when(F.expr("event_id % 4 = 1"), F.date_format("day", "yyyy-MM")).when(F.expr("event_id % 4 = 2"), F.date_format("day", "yyyy-MM-dd"))
    return bundles.in_range(df.withColumn("observed", observed), "observed", "2024-01-01", "2024-06-30", "event_type", ["click", "signup"]).select("event_id", "observed")


@query(f"""WITH {_EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day, assertion ORDER BY verified DESC, event_id) AS r FROM e WHERE assertion <> 'absent')
  SELECT user_id, day, event_type AS category, event_id AS entry_id, row_number() OVER (PARTITION BY user_id ORDER BY day, event_type, event_id) AS position FROM r WHERE r = 1""")
def timeline_from_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.timeline(evidence_rows(spark, sf_dir).where("assertion != 'absent'"))


@query("""SELECT event_id, user_id AS subject, CAST(ts AS DATE) AS day, 'laboratory' AS category, event_type || ': ' || CASE WHEN event_id % 6 = 0 THEN 'POSITIVO' ELSE trim(CASE WHEN event_id % 5 = 0 THEN '<' ELSE '' END || CAST(CAST(floor(value) AS INT) AS VARCHAR) || ' mg/dl') END
  || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' [10 - 60]' END || CASE WHEN value > 60 THEN ' (H)' ELSE ' (L)' END AS description FROM events WHERE value > 60 OR value < 10""")
def abnormal_values_on_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "event_id", F.col("user_id").alias("subject"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("parameter"), "value")
    flag = F.when(F.col("value") > 60, "H").when(F.col("value") < 10, "L")
    rows = df.select(
        "event_id", "subject", "day", "parameter", flag.isNotNull().alias("abnormal"), flag.alias("flag"), F.when(F.expr("event_id % 6 = 0"), "POSITIVO").alias("value_text"),
        F.when(F.expr("event_id % 5 = 0"), "<").alias("operator"), F.floor("value").cast("string").alias("value"), F.lit("mg/dl").alias("unit"), F.when(F.expr("event_id % 3 != 0"), "10 - 60").alias("reference"),
    )
    return bundles.laboratory_entries(rows).select("event_id", "subject", "day", "category", "description")


@query("""WITH g AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0), v AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber >= 4)
  SELECT o_custkey AS subject, count(*) AS missing FROM orders JOIN g ON o_orderkey = id WHERE o_orderkey NOT IN (SELECT id FROM v) GROUP BY ALL""")
def gold_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_orderkey", F.col("o_custkey").alias("subject"))
    reviewed = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return bundles.unreviewed(orders.where("o_orderkey % 3 != 0"), reviewed, "o_orderkey").groupBy("subject").agg(F.count("*").alias("missing"))


@query("""WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, CAST(to_json(list_transform(ids, lambda x: CASE WHEN x % 10 = 3 THEN x + 1000000 ELSE x END)) AS VARCHAR) AS document_ids FROM a""")
def document_ids_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey").agg(F.to_json(F.transform(each, lambda x: x["l_partkey"])).alias("document_ids"))
    moved = read(spark, sf_dir, "part", F.col("p_partkey").alias("old")).where("old % 10 = 3").select("old", (F.col("old") + 1_000_000).alias("new"))
    return bundles.remapped(rows, "l_orderkey", "document_ids", moved)


_FORMS = ["12/04/2026", "visita del 3-2-49", "1929-08-26", "il 5.11.87", "Esame 22 10 2014", "2026/4/1", "7 Aprile 2021", "marzo 9, 2020", "31/02/2020", "99/99/2020 poi 2021-05-06", "senza data", "01/01/1800", "1/1/2150 e 4 maggio 2011"]
_PARSED = ["2026-04-12", "2049-02-03", "1929-08-26", "1987-11-05", "2014-10-22", "2026-04-01", "2021-04-07", "2020-03-09", None, "2021-05-06", None, None, "2011-05-04"]


@query(f"""WITH s AS (SELECT o_orderkey, o_orderdate AS d, {len(_FORMS)} AS n FROM orders)
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN [{', '.join('NULL' if x is None else f"'{x}'" for x in _PARSED)}][(o_orderkey // 5) % n + 1] ELSE strftime(d, '%Y-%m-%d') END AS parsed FROM s""")
def italian_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    names = F.array(*[F.lit(x) for x in dates.MONTHS])
    month = F.get(names, F.month(d) - 1)
    said = [F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "'Roma,' d-M-yyyy"), F.concat_ws(" ", F.lit("il"), F.dayofmonth(d).cast("string"), month, F.year(d).cast("string")), F.concat(month, F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string"))]
    fixed = F.get(F.array(*[F.lit(x) for x in _FORMS]), F.expr(f"cast((o_orderkey div 5) % {len(_FORMS)} as int)"))
    text = F.coalesce(*[F.when(F.expr(f"o_orderkey % 5 = {i}"), x) for i, x in enumerate(said)], fixed)
    return read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates.parse_italian(text, month_year=False).alias("parsed"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_partkey % 1000 AS p, l_suppkey % 2 = 0 AS micro FROM lineitem), t AS (SELECT *, CAST(q AS VARCHAR) || '.' || lpad(CAST(p AS VARCHAR), 3, '0') AS text FROM s)
  SELECT l_orderkey, l_linenumber, CASE WHEN micro THEN CAST(q * 1000 + p AS DOUBLE) ELSE CAST(text AS DOUBLE) END AS value FROM t""")
def thousands_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("."), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"))
    unit = F.when(F.col("l_suppkey") % 2 == 0, "/μL").otherwise("mg/dL")
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", bundles.count_value(text, unit).alias("value"))


@query("""WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents),
  h AS (SELECT doc_id, [len(regexp_split_to_array(t, ' license | copyright ')) - 1, len(regexp_split_to_array(t, ' token | password | key ')) - 1, len(regexp_split_to_array(t, ' the | and ')) - 1] AS n FROM t)
  SELECT doc_id, CASE WHEN list_max(n) = 0 THEN 'unknown' ELSE ['legal', 'secrets', 'english'][list_position(n, list_max(n))] END AS family FROM h""")
def most_hit_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = {"legal": ["license", "copyright"], "secrets": ["token", "password", "key"], "english": ["the", "and"]}
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", bundles.most_hit(F.col("text"), families, "unknown").alias("family"))


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('round-1:' || CAST(event_id AS VARCHAR)), event_id) AS n FROM events) SELECT event_id, event_type FROM r WHERE n <= 40""")
def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.hash_sample(read(spark, sf_dir, "events", "event_id", "event_type"), ["event_type"], "event_id", 40, "round-1")


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type FROM events), a AS (SELECT DISTINCT user_id, day, event_type FROM e WHERE event_id % 2 = 0 OR event_id % 7 = 0), b AS (SELECT DISTINCT user_id, day, event_type FROM e WHERE event_id % 3 <> 0),
  n AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.day IS NOT NULL AS x, b.day IS NOT NULL AS y FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type = b.event_type)
  SELECT user_id, count(*) FILTER (WHERE x AND y) AS agreed, count(*) FILTER (WHERE x AND NOT y) AS only_first, count(*) FILTER (WHERE y AND NOT x) AS only_second,
    round(2.0 * count(*) FILTER (WHERE x AND y) / (2 * count(*) FILTER (WHERE x AND y) + count(*) FILTER (WHERE x <> y)), 6) AS f1 FROM n GROUP BY user_id""")
def reviewer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "event_id", "user_id", F.col("ts").cast("date").alias("day"), "event_type")
    return bundles.agreement(df.where("event_id % 2 = 0 or event_id % 7 = 0"), df.where("event_id % 3 != 0"), ["user_id"], ["day", "event_type"])
