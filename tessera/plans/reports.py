"""Queries of reports: events, orders and documents stand for findings, registry events and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reports
from tessera.plans.registry import query, read


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as findings of their user; every third names its organs, the others one organ."""
    rows = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value").where("event_type = 'error'")
    return rows.select(
        "event_id",
        "user_id",
        F.when(F.expr("event_id % 3 = 0"), F.array(F.lit("liver"), F.lit("skin"))).alias("organs"),
        F.lit("lung").alias("organ"),
        F.when(F.expr("event_id % 2 = 0"), F.array(F.concat(F.lit(" #EVD_"), F.col("event_id").cast("string")), F.lit("EVD_1"))).alias("cited"),
    )


_FINDINGS = """f AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'liver, skin' ELSE 'lung' END AS organ, CASE WHEN event_id % 2 = 0 THEN 'EVD_' || event_id || ', EVD_1' ELSE '' END AS cited FROM events WHERE event_type = 'error'),
  r AS (SELECT user_id, count(*) AS candidates FROM events GROUP BY user_id)"""


@query(f"WITH {_FINDINGS} SELECT event_id, f.user_id, organ, cited, candidates FROM f JOIN r USING (user_id)")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = read(spark, sf_dir, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("candidates"))
    return reports.workbook_rows(totals, _findings(spark, sf_dir), "user_id").select("event_id", "user_id", "organ", "cited", "candidates")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)")
def workbook_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "customer", F.col("c_custkey").alias("user_id"))
    return reports.workbook_skipped(asked, _findings(spark, sf_dir), "user_id")


@query("""WITH e AS (SELECT event_id, 'EVD_' || event_id AS own, event_type, user_id FROM events),
    o AS (SELECT event_type, list_sort(list(DISTINCT 'EVD_' || (user_id % 5))) AS ids FROM events GROUP BY event_type)
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN own || CASE WHEN own = 'EVD_0' THEN '' ELSE ',EVD_0' END WHEN 1 THEN 'EVD_7' || CASE WHEN own = 'EVD_7' THEN '' ELSE ',' || own END ELSE array_to_string(ids, ',') END AS cited FROM e JOIN o USING (event_type)""")
def cited_ids_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    own = F.concat(F.lit("#EVD_"), F.col("event_id").cast("string"))
    entries = df.select(
        "event_id",
        F.array("event_type").alias("organs"),
        F.when(F.expr("event_id % 3 = 0"), F.array(own, F.lit("EVD_0"), F.concat(own, F.lit(" ")))).alias("cited"),
        F.when(F.expr("event_id % 3 = 1"), F.concat(F.lit("see #EVD_7, then "), own, F.lit(" and #EVD_7"))).alias("notes"),
    )
    findings = df.select(F.col("event_type").alias("organ"), F.array(F.concat(F.lit("EVD_"), F.expr("cast(user_id % 5 as string)"))).alias("cited"))
    return reports.with_cited_ids(entries, findings, "event_id", "#?EVD_[0-9]+").select("event_id", F.array_join("cited", ",").alias("cited"))


@query("""WITH o AS (SELECT o_orderkey AS event_id, o_custkey AS subject, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS kind, o_orderstatus AS status FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY (kind = '1-URGENT') DESC, (kind LIKE '%HIGH%')::INT DESC, (status = 'O') DESC, day DESC, event_id DESC) AS n FROM o WHERE kind = '1-URGENT' OR kind LIKE '%HIGH%'),
    a AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_returnflag = 'N'))
  SELECT event_id, subject, day, row_number() OVER (PARTITION BY subject ORDER BY day, event_id) AS place FROM k WHERE n <= 4 AND event_id NOT IN (SELECT l_orderkey FROM a)""")
def retrieved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "orders", F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))
    evidence = read(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("event_id"), "l_returnflag")
    intent, hit = F.col("kind") == "1-URGENT", F.contains("kind", F.lit("HIGH"))
    out = reports.retrieved(events, evidence, "subject", "event_id", "day", intent | hit, intent, hit.cast("int"), F.col("status") == "O", F.col("l_returnflag") == "N", 4)
    return out.select("event_id", "subject", "day", "place")


_SYSTEMS = {"storage": ["file", "disk", "backup"], "access": ["password", "token", "login"], "page": ["link", "site", "file"]}


@query("""WITH h AS (SELECT doc_id, contains(lower(text), 'file')::INT AS f, contains(lower(text), 'disk')::INT + contains(lower(text), 'backup')::INT AS s, contains(lower(text), 'password')::INT + contains(lower(text), 'token')::INT + contains(lower(text), 'login')::INT AS a,
    contains(lower(text), 'link')::INT + contains(lower(text), 'site')::INT AS p FROM documents)
  SELECT doc_id, CASE WHEN greatest(f + s, a, f + p) = 0 THEN NULL WHEN f + s >= a AND s >= p THEN 'storage' WHEN a >= f + p THEN 'access' ELSE 'page' END AS system FROM h""")
def system_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", reports.system_of(F.lower("text"), _SYSTEMS).alias("system"))


@query(r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS number, -1 AS sign FROM documents),
    o AS (SELECT doc_id, unnest(regexp_extract_all(text || ' no. ' || doc_id % 7 || ' of 7', '[0-9]+(?:[.,][0-9]+)*')) AS number, 1 AS sign FROM documents)
  SELECT doc_id, number, CAST(sum(sign) AS BIGINT) AS more FROM (FROM s UNION ALL FROM o) GROUP BY doc_id, number HAVING sum(sign) > 0""")
def introduced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read(spark, sf_dir, "documents", "doc_id", "text")
    outputs = sources.withColumn("text", F.concat("text", F.lit(" no. "), F.expr("cast(doc_id % 7 as string)"), F.lit(" of 7")))
    return reports.introduced_numbers(sources, outputs, "doc_id", "text")


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d FROM events), t AS (SELECT event_id, strftime(d, '%Y-%m-%d') AS document, year(d) AS y, month(d) AS m, day(d) AS n FROM e)
  SELECT event_id, CASE event_id % 7 WHEN 0 THEN document WHEN 1 THEN left(document, 7) WHEN 2 THEN document WHEN 3 THEN coalesce(strftime(try_cast(y || '-2-' || n AS DATE), '%Y-%m-%d'), document) WHEN 4 THEN document WHEN 5 THEN '' ELSE document END AS observed FROM t""")
def observed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "event_id", F.col("ts").cast("date").alias("d"))
    y, m, n = (f("d").cast("string") for f in (F.year, F.month, F.dayofmonth))
    forms = [F.concat_ws("-", y, m, n), F.concat_ws("-", y, m), F.concat_ws("/", n, m, y), F.concat_ws(".", n, F.lit("02"), y), F.concat_ws("-", y, F.lit("13")), F.lit("soon"), F.lit(None)]
    said = F.get(F.array(*forms), F.expr("cast(event_id % 7 as int)"))
    document = F.when(F.expr("event_id % 7 != 5"), F.date_format("d", "yyyy-MM-dd"))
    return df.select("event_id", reports.observed_date(said, document).alias("observed"))
