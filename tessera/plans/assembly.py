"""Queries that assemble facts: joined fragments, carried ids, separated components, matches under caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import carryover, coverage, fragments, matching
from tessera.plans import relations
from tessera.plans.registry import query, read

# --- fragments: every sentence of a document is a fact about its first word's initial, with the numbers and capitals it holds

_SENTENCE = "[.!?;\\n]+[ \\t]*"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", _SENTENCE)).alias("p", "s")).where("trim(s) != ''")
    s = F.col("s")
    part = lambda pattern: F.regexp_extract(s, pattern, 1)
    attributes = F.create_map(F.lit("size.value"), part("([0-9]+)"), F.lit("size.unit"), part("[0-9]+ ([a-z]+)"), F.lit("name"), part("([A-Z][a-z]+)$"), F.lit("mark"), part("([a-z]+)[^A-Za-z]*$"))
    repeats = F.col("p") % 7 == 0
    refs = F.when(F.col("p") % 11 == 10, F.array().cast("array<int>")).when(repeats, F.array(F.col("p") + 2, F.col("p") + 1)).otherwise(F.array(F.col("p") + 1))
    return rows.select("doc_id", F.col("p").alias("seq"), F.when(F.length("s") > 60, " Long").otherwise("short").alias("category"), F.when(F.col("p") % 5 < 4, "Item").otherwise("ITEM ").alias("entity"), refs.alias("refs"), F.map_filter(attributes, lambda k, v: (k != "mark") | (F.length("s") % 3 == 0)).alias("attributes"))


_FACTS = f"""s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{_SENTENCE}')) AS s, generate_subscripts(regexp_split_to_array(text, '{_SENTENCE}'), 1) - 1 AS p FROM documents),
  f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, CASE WHEN length(s) > 60 THEN 'long' ELSE 'short' END AS category,
    CASE WHEN p % 11 = 10 THEN []::BIGINT[] WHEN p % 7 = 0 THEN [p + 1, p + 2] ELSE [p + 1] END AS refs,
    [nullif(regexp_extract(s, '([0-9]+)', 1), ''), nullif(regexp_extract(s, '[0-9]+ ([a-z]+)', 1), ''), nullif(regexp_extract(s, '([A-Z][a-z]+)$', 1), ''), CASE WHEN length(s) % 3 = 0 THEN nullif(regexp_extract(s, '([a-z]+)[^A-Za-z]*$', 1), '') END] AS a FROM s WHERE trim(s) <> '')"""


@query(f"""WITH RECURSIVE {_FACTS},
  w AS (SELECT doc_id, i, p, category, refs, a, 1 AS n, true AS fresh FROM f WHERE i = 1
    UNION ALL SELECT w.doc_id, f.i, CASE WHEN x.fits THEN w.p ELSE f.p END, f.category, CASE WHEN x.fits THEN list_sort(list_distinct(list_concat(w.refs, f.refs))) ELSE f.refs END,
      CASE WHEN x.fits THEN list_transform(w.a, lambda v, k: coalesce(v, f.a[k])) ELSE f.a END, CASE WHEN x.fits THEN w.n + 1 ELSE 1 END, NOT x.fits
    FROM w JOIN f ON f.doc_id = w.doc_id AND f.i = w.i + 1, LATERAL (SELECT w.category = f.category AND len(w.refs) > 0 AND len(f.refs) > 0 AND f.refs[1] <= w.refs[-1] + 1
      AND len(list_distinct(list_concat(w.refs, f.refs))) <= 6 AND len(list_filter(w.a, lambda v, k: v <> f.a[k])) = 0 AS fits) x),
  e AS (SELECT *, lead(fresh, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM w)
  SELECT doc_id, CAST(p AS INT) AS seq, category, array_to_string(refs, ',') AS refs, a[1] AS value, a[2] AS unit, a[3] AS name, a[4] AS mark, CAST(n AS INT) AS fragments FROM e WHERE last""")
def fragments_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fragments.coalesced(_facts(spark, sf_dir), "doc_id", "seq", "category", "entity", "refs", "attributes")
    a = lambda key: F.try_element_at("attributes", F.lit(key))
    return out.select("doc_id", "seq", F.lower(F.trim("category")).alias("category"), F.array_join("refs", ",").alias("refs"), a("size.value").alias("value"), a("size.unit").alias("unit"), a("name").alias("name"), a("mark").alias("mark"), "fragments")


# --- ids carried over: a user's events in weeks are the clusters, in spans of ten days the events known before

_KIND = "CASE WHEN event_type IN ('click', 'view') THEN 'symptom' ELSE 'diagnosis' END"


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts").withColumn("day", F.col("ts").cast("date"))
    number = F.datediff("day", F.lit("2020-01-01").cast("date"))
    rows = e.select("event_id", F.col("user_id").cast("string").alias("subject"), F.expr(_KIND).alias("category"), F.col("event_type").alias("entity"), "day", F.floor(number / 7).alias("week"), F.floor(number / 10).alias("span"))
    rows = rows.withColumn("cluster", F.concat_ws("/", "subject", "entity", "week")).withColumn("old", F.concat_ws("/", F.lit("OLD"), "subject", "category", "span"))
    clusters = rows.groupBy("cluster", "subject", "category", "entity").agg(F.min("week").cast("int").alias("episode"))
    members = rows.select("cluster", F.col("event_id").alias("evidence_id"), "day", F.col("event_id").alias("document_id"))
    events = rows.groupBy(F.col("old").alias("event_id"), "subject", "category").agg(F.min("entity").alias("entity"), F.when(F.min("span") % 2 == 0, F.concat(F.lit("EPI/"), "old")).alias("episode_id"))
    cited = rows.where("event_id % 3 <> 0").select(F.col("old").alias("event_id"), F.col("event_id").alias("evidence_id"))
    return clusters, members, events, cited


def _uuid_sql(prefix: str, *parts: str) -> str:
    name = " || chr(31) || ".join(parts)
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"(SELECT '{prefix}_' || h[1:12] || '5' || h[14:16] || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:32] FROM (SELECT {h} AS h))"


_TOKEN = "CASE WHEN category = 'symptom' THEN CAST(anchor AS VARCHAR) ELSE CAST(episode AS VARCHAR) END"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS subject, {_KIND} AS category, event_type AS entity, CAST(ts AS DATE) AS day, CAST(floor((CAST(ts AS DATE) - DATE '2020-01-01') / 7) AS BIGINT) AS week, CAST(floor((CAST(ts AS DATE) - DATE '2020-01-01') / 10) AS BIGINT) AS span FROM events),
  m AS (SELECT *, subject || '/' || entity || '/' || week AS cluster, 'OLD/' || subject || '/' || category || '/' || span AS old FROM e),
  b AS (SELECT cluster, subject, category, entity, min(week) AS episode, arg_min(event_id, (day, event_id)) AS anchor FROM m GROUP BY cluster, subject, category, entity),
  c AS (SELECT *, row_number() OVER (PARTITION BY subject, category ORDER BY entity, episode) AS turn FROM b),
  k AS (SELECT old, min(entity) AS entity, CASE WHEN min(span) % 2 = 0 THEN 'EPI/' || old END AS episode_id FROM m GROUP BY old),
  p AS (SELECT m.cluster, old, count(*) AS overlap, any_value(CAST(m.entity = k.entity AS INT)) AS same FROM m JOIN k USING (old) WHERE event_id % 3 <> 0 GROUP BY m.cluster, old),
  r AS (SELECT DISTINCT subject, category, 0::BIGINT AS turn, []::VARCHAR[] AS used, NULL::VARCHAR AS cluster, NULL::VARCHAR AS old FROM c
    UNION ALL SELECT subject, category, turn, CASE WHEN old IS NULL THEN used ELSE list_append(used, old) END, cluster, old
    FROM (SELECT c.subject, c.category, c.turn, r.used, c.cluster, (SELECT arg_max(p.old, (p.overlap, p.same, p.old)) FROM p WHERE p.cluster = c.cluster AND NOT list_contains(r.used, p.old)) AS old FROM r JOIN c ON c.subject = r.subject AND c.category = r.category AND c.turn = r.turn + 1)),
  o AS (SELECT c.*, r.old, k.episode_id AS known FROM c JOIN r USING (cluster) LEFT JOIN k ON k.old = r.old),
  i AS (SELECT *, coalesce(old, {_uuid_sql("EVT", "subject", "category", "entity", _TOKEN)}) AS event_id, CASE WHEN old IS NOT NULL THEN coalesce(known, {_uuid_sql("EPI", "old")}) ELSE {_uuid_sql("EPI", "subject", "category", "entity", _TOKEN)} END AS episode_id FROM o)
  SELECT cluster, event_id, episode_id, lag(episode_id) OVER (PARTITION BY subject, category, entity ORDER BY episode) AS previous_episode_id, old IS NOT NULL AS is_carried FROM i""")
def stable_ids_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carryover.carried(*_clustered(spark, sf_dir))


# --- components that keep pairs apart: cohesive relations as edges, contradictions as pairs that may not meet

_APART = """nodes AS (SELECT DISTINCT user_id, x AS node FROM (SELECT user_id, unnest([a, b]) AS x FROM f)), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY node) AS k FROM nodes),
  steps AS (SELECT f.user_id, x.k AS ka, y.k AS kb, row_number() OVER (PARTITION BY f.user_id ORDER BY weight DESC, a, b) AS step FROM f JOIN i x ON x.node = a JOIN i y ON y.node = b WHERE effect = 'cohesive'),
  z AS (SELECT f.user_id, list([x.k, y.k]) AS pairs FROM f JOIN i x ON x.node = a JOIN i y ON y.node = b WHERE effect = 'cannot_link' GROUP BY f.user_id),
  s AS (SELECT i.user_id, list(k ORDER BY k) AS labels, coalesce(any_value(pairs), []) AS pairs FROM i LEFT JOIN z USING (user_id) GROUP BY i.user_id),
  r2 AS (SELECT user_id, 0::BIGINT AS step, labels, pairs FROM s
    UNION ALL SELECT r.user_id, g.step, CASE WHEN u.la <> u.lb AND len(list_filter(r.pairs, lambda q: least(r.labels[q[1]], r.labels[q[2]]) = least(u.la, u.lb) AND greatest(r.labels[q[1]], r.labels[q[2]]) = greatest(u.la, u.lb))) = 0
      THEN list_transform(r.labels, lambda v: CASE WHEN v = greatest(u.la, u.lb) THEN least(u.la, u.lb) ELSE v END) ELSE r.labels END, r.pairs
    FROM r2 r JOIN steps g ON g.user_id = r.user_id AND g.step = r.step + 1, LATERAL (SELECT r.labels[g.ka] AS la, r.labels[g.kb] AS lb) u),
  t AS (SELECT user_id, arg_max(labels, step) AS labels FROM r2 GROUP BY user_id)
  SELECT i.node, j.node AS component FROM i JOIN t USING (user_id) JOIN i j ON j.user_id = i.user_id AND j.k = t.labels[i.k]"""


@query(relations._RULE.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _APART)
def separated_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    related = relations._related(spark, sf_dir)
    nodes = related.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return matching.separated_components(related.where("effect = 'cohesive'").select("a", "b", "weight"), nodes, related.where("effect = 'cannot_link'").select("a", "b"))


# --- coverage: sentences with signals put between a document's own, and facts that cover some of them

#: Sentences and the types they signal, by hand.
SIGNALLED = [
    ("TC torace: evidenza di nodulo polmonare", ["radiology_finding"]), ("Lamenta tosse e dispnea", ["symptom"]), ("Dolore risolto", []), ("Biopsia: melanoma", ["diagnosis", "procedure"]), ("Eseguita colonscopia", []),
    ("PA 120/80, FC 70", ["vital_sign"]), ("Si propone intervento chirurgico", ["procedure", "clinical_decision"]), ("Ricovero per polmonite, poi dimesso", ["hospitalization", "discharge"]), ("BRAF mutato", ["biomarker"]), ("Sta bene", []), ("Assume aspirina", ["medication"]),
]
_GIVEN = ["instrumental_finding", "symptom", "clinical_sign", "histopathology", "clinical_decision", "biomarker", "discharge"]


def _signalled_sql() -> str:
    rows = ", ".join(f"({i}, '{kind}', {'true' if 'Si propone' in text else 'false'}, {'true' if 'Biopsia' in text else 'false'})" for i, (text, kinds) in enumerate(SIGNALLED) for kind in kinds)
    return f"k(s, kind, planned, pathology) AS (VALUES {rows})"


@query(f"""WITH d AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+ ')) AS x, generate_subscripts(string_split_regex(text, '[.!?]+ '), 1) AS n FROM documents), {_signalled_sql()},
  g AS (SELECT doc_id, n, kind, planned, pathology FROM d JOIN k ON k.s = (doc_id + n) % {len(SIGNALLED)}),
  f AS (SELECT DISTINCT doc_id, n, {'[' + ', '.join(f"'{x}'" for x in _GIVEN) + ']'}[(doc_id + 2 * n) % {len(_GIVEN)} + 1] AS kind FROM d WHERE n % 2 = 0),
  m AS (SELECT g.doc_id, g.n, g.kind FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = g.doc_id AND f.n = g.n AND (f.kind = g.kind OR (g.kind = 'radiology_finding' AND f.kind = 'instrumental_finding') OR (g.kind = 'vital_sign' AND f.kind = 'clinical_sign')
    OR (g.planned AND g.kind IN ('procedure', 'clinical_decision') AND f.kind IN ('procedure', 'clinical_decision')) OR (g.pathology AND g.kind IN ('diagnosis', 'procedure') AND f.kind = 'histopathology'))))
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT n)), ',') AS sentences, array_to_string(list_sort(list(DISTINCT kind)), ',') AS fact_types FROM m GROUP BY doc_id""")
def coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "[.!?]+ ")).alias("n", "x")).withColumn("n", F.col("n") + 1)
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    rows = rows.select("doc_id", "n", pick([t for t, _ in SIGNALLED], F.col("doc_id") + F.col("n")).alias("x"))
    facts = rows.where("n % 2 = 0").select("doc_id", pick(_GIVEN, F.col("doc_id") + 2 * F.col("n")).alias("fact_type"), F.array("n").alias("refs"))
    missing = coverage.missing_signals(rows, facts, "doc_id", "n", "x", F.contains("x", F.lit("aspirina")))
    return coverage.recovery_plan(missing, "doc_id", "n").select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("fact_types", ",").alias("fact_types"))
