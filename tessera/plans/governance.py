"""Queries of governance: merged subjects, replacement by scope, deletion, coded terms; events and documents stand for evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import governance
from tessera.plans.registry import query, read

_SAID = ["diagnosis", " Laboratory_Trend", "clinical_syndrome", "ONCOLOGY_TREATMENT_LINE", "follow_up", "mood", "", "other", "surgery"]


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 10 < 9 THEN ({_SAID})[event_id % 10 + 1] END AS said FROM events), t AS (SELECT *, lower(trim(said)) AS told FROM e)
  SELECT event_id, said, CASE WHEN told = 'laboratory_trend' THEN 'laboratory_finding' WHEN told = 'clinical_syndrome' THEN 'diagnosis' WHEN told = 'oncology_treatment_line' THEN 'medication'
  WHEN told IN ('diagnosis', 'follow_up', 'surgery') THEN told ELSE 'other' END AS category FROM t""")
def category_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.get(F.array(*[F.lit(c) for c in _SAID]), F.expr("cast(event_id % 10 as int)"))
    rows = read(spark, sf_dir, "events", "event_id", said.alias("said"))
    return rows.withColumn("category", governance.folded_category(F.col("said")))


_REVIEWED = "('click', 'mg', 'R-1'), ('click', 'mg', 'R-0'), ('error', NULL, 'R-2')"


@query(f"""WITH e AS (SELECT event_id, event_type AS concept, (['mg', 'g', '', NULL])[event_id % 4 + 1] AS unit FROM events),
  r AS (SELECT concept, unit, min(code) AS code FROM (VALUES {_REVIEWED}) v(concept, unit, code) GROUP BY 1, 2),
  b AS (SELECT * FROM (VALUES ('click', 'B-1', ['mg', 'g']), ('view', 'B-2', ['g'])) v(concept, code, units))
  SELECT event_id, e.concept, e.unit, coalesce(r.code, CASE WHEN coalesce(e.unit, '') = '' OR list_contains(b.units, e.unit) THEN b.code END) AS code,
  CASE WHEN r.code IS NOT NULL THEN 'reviewed' WHEN b.code IS NOT NULL AND (coalesce(e.unit, '') = '' OR list_contains(b.units, e.unit)) THEN 'builtin' ELSE 'none' END AS code_source
  FROM e LEFT JOIN r ON e.concept = r.concept AND e.unit IS NOT DISTINCT FROM r.unit LEFT JOIN b ON e.concept = b.concept""")
def coded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(F.lit("mg"), F.lit("g"), F.lit(""), F.lit(None)), F.expr("cast(event_id % 4 as int)"))
    items = read(spark, sf_dir, "events", "event_id", F.col("event_type").alias("concept"), unit.alias("unit"))
    reviewed = spark.createDataFrame([("click", "mg", "R-1"), ("click", "mg", "R-0"), ("error", None, "R-2")], "concept string, unit string, code string")
    builtin = spark.createDataFrame([("click", "B-1", ["mg", "g"]), ("view", "B-2", ["g"])], "concept string, code string, units array<string>")
    return governance.coded(items, reviewed, builtin, "concept", "unit")


_SCOPE = "document_id % 3 = 0 AND method = 0"


@query(f"""WITH e AS (SELECT event_id, event_id % 101 AS document_id, event_id % 2 AS method, value FROM events)
  SELECT * FROM e WHERE NOT ({_SCOPE}) UNION ALL SELECT event_id, document_id, method, value + 1 FROM e WHERE {_SCOPE} AND event_id % 5 <> 0""")
def replaced_by_document_and_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = read(spark, sf_dir, "events", "event_id", F.expr("event_id % 101").alias("document_id"), F.expr("event_id % 2").alias("method"), "value")
    anew = current.where(_SCOPE)
    incoming = anew.where("event_id % 5 != 0").withColumn("value", F.col("value") + 1)
    return governance.replaced(current, incoming, anew.select("document_id", "method"), "event_id")


@query("""WITH d AS (SELECT doc_id, doc_id % 20 AS s, md5(text) AS h FROM documents), m AS (SELECT *, CASE WHEN s % 2 = 1 AND s NOT IN (7, 15) THEN s - 1 END AS t FROM d),
  k AS (SELECT s, h, min(doc_id) AS known FROM d WHERE s % 2 = 0 GROUP BY 1, 2)
  SELECT coalesce(m.t, m.s) AS subject, m.doc_id AS old, coalesce(k.known, m.doc_id) AS new FROM m LEFT JOIN k ON m.t = k.s AND m.h = k.h""")
def merged_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents", "doc_id", F.expr("doc_id % 20").alias("owner"), F.md5("text").alias("file_hash"))
    moves = spark.range(1, 20, 2).select(F.col("id").alias("source"), (F.col("id") - 1).alias("target"))
    return governance.merged_documents(documents, moves, spark.createDataFrame([(7,), (15,)], "source long"), "owner", "doc_id", "file_hash")


@query("""WITH l AS (SELECT event_id, event_id % 50 AS d FROM events WHERE event_id % 13 <> 0 UNION ALL SELECT event_id, (event_id * 7 + 3) % 50 FROM events WHERE event_id % 13 <> 0)
  SELECT event_id, any_value(value) AS value, count(DISTINCT d) AS sources, min(d) AS "primary" FROM events JOIN l USING (event_id) WHERE d % 5 <> 0 GROUP BY event_id""")
def documents_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = read(spark, sf_dir, "events", "event_id", "value")
    both = F.explode(F.array(F.expr("event_id % 50"), F.expr("(event_id * 7 + 3) % 50"))).alias("document_id")
    links = evidence.where("event_id % 13 != 0").select("event_id", both)
    return governance.without_documents(evidence, links, spark.range(0, 50, 5).toDF("document_id"), "event_id", "document_id")
