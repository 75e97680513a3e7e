"""Graph, deduplication, retrieval, evaluation and audit queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit, dedup, evaluation, graph, retrieval
from tessera.operators.rounds import Rounds
from tessera.plans.observations import HIGH, LOW, observations
from tessera.plans.registry import query, read

K, LOCAL, LONG = 6, 2, 7
_E = "SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day FROM events"
_CAND = f"""e AS ({_E}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day, event_id) AS j FROM e),
  p AS (SELECT a.event_id AS x, b.event_id AS y, 'local' AS scale, abs(a.day - b.day) AS days, CAST(NULL AS VARCHAR) AS term FROM n a JOIN n b ON a.user_id = b.user_id AND a.i - b.i BETWEEN 1 AND {K} WHERE abs(a.day - b.day) <= {LOCAL}
    UNION ALL SELECT a.event_id, b.event_id, 'longitudinal', abs(a.day - b.day), a.event_type FROM n a JOIN n b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.j - b.j BETWEEN 1 AND {K} WHERE abs(a.day - b.day) <= {LONG}),
  c AS (SELECT least(x, y) AS a, greatest(x, y) AS b, bool_or(scale = 'local') AS local, bool_or(scale = 'longitudinal') AS longitudinal, CAST(min(days) AS INT) AS days, count(DISTINCT term) AS shared_terms FROM p GROUP BY ALL)"""


def _candidates(spark: SparkSession, sf_dir: str, carried: list[str] | None = None) -> DataFrame:
    df = observations(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "day")
    return graph.related(df, "user_id", "event_type", "day", ["day", "event_id"], "event_id", K, LOCAL, LONG, carried=carried)


@query(f"WITH {_CAND} SELECT * FROM c")
def graph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).drop("user_id")


KINDS = {"purchase": "procedure", "error": "symptom", "click": "medication", "view": "laboratory_finding", "signup": "diagnosis"}
_KIND = "CASE {} WHEN 'purchase' THEN 'procedure' WHEN 'error' THEN 'symptom' WHEN 'click' THEN 'medication' WHEN 'view' THEN 'laboratory_finding' ELSE 'diagnosis' END"


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.episodes import lookup

    rows = _candidates(spark, sf_dir, ["event_type", "value", "day"])
    rows = rows.withColumns({f"category_{end}": lookup(F.col(f"event_type_{end}"), KINDS) for end in "ab"})
    c = F.col
    same = c("event_type_a") == c("event_type_b")
    absent = lambda x: c(f"value_{x}") < LOW
    later = absent("b") & (c("day_b") > c("day_a"))
    rule = graph.rule_relation(same, absent("a") != absent("b"), later, (c("value_a") > HIGH) & (c("value_b") > HIGH) & (c("a") % 2 != c("b") % 2), c("category_a"), c("category_b"), c("local"), c("shared_terms"))
    return rows.withColumn("rule", rule).select("user_id", "a", "b", "rule.*", graph.priority(same, c("shared_terms"), c("local"), c("days")).alias("priority"))


_RULE = f"""WITH {_CAND}, r AS (SELECT c.*, x.user_id, x.event_type AS ta, y.event_type AS tb, x.value < {LOW} AS na, y.value < {LOW} AS nb, y.value < {LOW} AND y.day > x.day AS later,
    x.value > {HIGH} AND y.value > {HIGH} AND a % 2 <> b % 2 AS side, {_KIND.format('x.event_type')} AS ka, {_KIND.format('y.event_type')} AS kb
    FROM c JOIN e x ON x.event_id = a JOIN e y ON y.event_id = b),
  g AS (SELECT *, CASE WHEN ta = tb AND na <> nb AND later THEN 1 WHEN ta = tb AND na <> nb THEN 2 WHEN ta = tb AND side THEN 3 WHEN ta = tb THEN 4
    WHEN (ka = 'symptom' AND kb = 'laboratory_finding') OR (kb = 'symptom' AND ka = 'laboratory_finding') THEN 5 WHEN 'medication' IN (ka, kb) THEN 6 WHEN 'procedure' IN (ka, kb) THEN 7 WHEN shared_terms > 0 AND local THEN 8 ELSE 9 END AS k FROM r),
  f AS (SELECT user_id, a, b, ['documents_resolution','contradicts','contradicts','same_process','manifestation_of','treats','evaluates','temporally_associated_with','temporally_associated_with'][k] AS relation,
    ['context_only','cannot_link','cannot_link','cohesive','cohesive','context_only','context_only','uncertain','uncertain'][k] AS effect,
    CAST(CASE k WHEN 1 THEN 0.94 WHEN 2 THEN 0.98 WHEN 3 THEN 0.92 WHEN 4 THEN CASE WHEN local THEN 0.93 ELSE 0.86 END WHEN 5 THEN CASE WHEN local THEN 0.79 ELSE 0.68 END
      WHEN 8 THEN 0.64 WHEN 9 THEN 0.5 ELSE CASE WHEN local THEN 0.72 ELSE 0.62 END END AS DOUBLE) AS weight,
    CASE WHEN ta = tb THEN 2.0 ELSE 0.0 END + least(2.0, shared_terms * 0.35) + CASE WHEN local THEN 0.7 ELSE 0.0 END + 1.0 / (1 + days) AS priority FROM g)"""


@query(_RULE + " SELECT user_id, a, b, relation, effect, weight, round(CAST(priority AS DOUBLE), 6) AS priority FROM f")
def graph_rule_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).withColumn("priority", F.round("priority", 6))


def _strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).where("effect in ('cohesive', 'must_link') and weight >= 0.9")


@query(_RULE.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT a, b FROM f WHERE effect = 'cohesive' AND weight >= 0.9 UNION SELECT b, a FROM f WHERE effect = 'cohesive' AND weight >= 0.9),
  w AS (SELECT event_id AS node, event_id AS root FROM e UNION SELECT s.b, w.root FROM w JOIN s ON s.a = w.node WHERE w.root < s.b)
  SELECT node, min(root) AS component FROM w GROUP BY node""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "events").select(F.col("event_id").alias("node"))
    return graph.components(_strong(spark, sf_dir).select("a", "b"), nodes)


@query()
def graph_bridge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = Rounds(spark, "bridges").cut(_related(spark, sf_dir).where("effect = 'cohesive' and weight >= 0.72").select("a", "b", "weight"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    of = graph.components(edges, nodes).withColumnRenamed("node", "a")
    return graph.split_bridges(edges.join(of, "a").select("component", "a", "b", "weight"), least=0.7)


@query(_RULE.replace("WITH ", "WITH RECURSIVE ", 1) + """, ranked AS (SELECT user_id, a, b, round(CAST(priority AS DOUBLE), 6) AS priority FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, a, b) AS step FROM ranked),
  walk AS (SELECT DISTINCT user_id, 0::BIGINT AS step, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS priority, false AS kept FROM ranked
    UNION ALL SELECT user_id, step, CASE WHEN free THEN list_concat(used, [a, b]) ELSE used END, a, b, priority, free FROM (SELECT o.*, w.used, len(list_filter(w.used, lambda x: x = o.a)) < 3 AND len(list_filter(w.used, lambda x: x = o.b)) < 3 AS free FROM walk w JOIN o ON o.user_id = w.user_id AND o.step = w.step + 1))
  SELECT user_id, a, b, priority FROM walk WHERE kept""")
def graph_degree_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_capped(_related(spark, sf_dir).select("user_id", "a", "b", F.round("priority", 6).alias("priority")), "user_id", "priority", 3)


@query(_RULE + """ SELECT a, b, CASE WHEN (a + b) % 5 <> 0 THEN effect WHEN (a + b) % 2 = 0 THEN 'must_link' ELSE 'cannot_link' END AS effect,
  CASE WHEN (a + b) % 5 <> 0 THEN weight ELSE 1.0 END AS weight FROM f""")
def human_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = _related(spark, sf_dir).select("a", "b", "effect", "weight")
    said = F.when((F.col("a") + F.col("b")) % 2 == 0, "accepted").otherwise("rejected")
    human = auto.where((F.col("a") + F.col("b")) % 5 == 0).select(F.col("b").alias("a"), F.col("a").alias("b"), said.alias("decision"))
    return graph.overridden(auto, human)


@query(f"""WITH e AS ({_E}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day, event_id) AS i FROM e)
  SELECT b.event_id AS source, a.event_id AS target FROM n a JOIN n b ON a.user_id = b.user_id AND a.i - b.i BETWEEN 1 AND 4 WHERE a.event_type <> b.event_type""")
def hypothesis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.relational import bounded_pairs

    pairs = bounded_pairs(observations(spark, sf_dir), ["user_id"], ["day", "event_id"], "event_id", 4, ["event_type"])
    return pairs.where("event_type_a != event_type_b").select(F.col("event_id_b").alias("source"), F.col("event_id_a").alias("target"))


@query("""SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS canonical, arg_max(event_id, (value, event_id)) AS richest, count(*) AS occurrences FROM events GROUP BY ALL""")
def atomic_identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir)
    groups = dedup.identity_groups(df, [F.col("user_id"), F.col("event_type"), F.col("day")], "event_id", ["ts", "event_id"], F.col("value"))
    return groups.join(df.select(F.col("event_id").alias("canonical"), "user_id", "event_type", "day"), "canonical").select("user_id", "event_type", "day", "canonical", "richest", "occurrences")


@query("""SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS base, max(value) AS worst_grade, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS organs, count(DISTINCT event_id) AS merged FROM events GROUP BY ALL""")
def finding_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.merge_findings(observations(spark, sf_dir), ["user_id", "day"], "event_id", ["ts", "event_id"], "value", "event_type")
    return out.select("user_id", "day", "base", "worst_grade", F.array_join("organs", ",").alias("organs"), F.size("merged").cast("long").alias("merged"))


@query()
def timeline_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir)
    text = F.concat_ws(" ", "event_type", F.lit("reading of"), F.round("value", 0).cast("long").cast("string"), F.lit("recorded"))
    rows = df.select(F.col("user_id").alias("subject"), "day", F.col("event_type").alias("category"), F.col("event_id").alias("entry_id"), text.alias("description"), (F.lit(0.5) + F.col("event_id") % 5 / 10).alias("confidence"))
    return dedup.timeline_dedupe(rows)


@query("""SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events ORDER BY event_type IN ('purchase', 'error') DESC, CASE WHEN value > 100 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END DESC, value >= 5 DESC, CAST(ts AS DATE) DESC, event_id LIMIT 40""")
def event_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    hits = F.when(v > 100, 2).when(v > 50, 1).otherwise(0)
    out = retrieval.event_rank(observations(spark, sf_dir), hits, F.col("event_type").isin("purchase", "error"), v >= 5, "day", "event_id", 40)
    return out.select("event_id", "user_id", "day")


@query("""WITH c AS (SELECT user_id, list('EV_' || CAST(event_id AS VARCHAR)) FILTER (event_type = 'purchase') AS cited, list('EV_' || CAST(event_id AS VARCHAR)) FILTER (value > 5) AS allowed FROM events GROUP BY user_id)
  SELECT user_id, coalesce(len(cited), 0) > 0 AND len(list_filter(coalesce(cited, []), lambda x: NOT list_contains(coalesce(allowed, []), x))) = 0 AS valid FROM c""")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    name = F.concat(F.lit("EV_"), F.col("event_id").cast("string"))
    each = df.groupBy("user_id").agg(F.array_join(F.collect_list(F.when(F.col("event_type") == "purchase", F.concat(F.lit("["), name, F.lit("]")))), " ").alias("answer"), F.collect_list(F.when(F.col("value") > 5, name)).alias("allowed"))
    return each.select("user_id", retrieval.citations_valid(F.col("answer"), F.col("allowed")).alias("valid"))


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir)
    rows = df.select(F.col("user_id").alias("subject"), F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.round("value", 0).cast("string").alias("entity"), "day")
    return evaluation.greedy_match(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query("""WITH s AS (SELECT user_id % 8 + 1 AS slots, avg(0.8 + value % 1 / 5) AS quality, median(user_id % 8 * 10 + value / 1000) AS throughput FROM events GROUP BY 1),
  n AS (SELECT * FROM s WHERE quality >= 0.8 AND quality >= (SELECT max(quality) FROM s WHERE quality >= 0.8) - 0.05) SELECT min(slots) AS slots FROM n WHERE throughput >= 0.97 * (SELECT max(throughput) FROM n)""")
def slot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "user_id", "value")
    slots = F.col("user_id") % 8 + 1
    samples = df.select(slots.alias("slots"), (F.lit(0.8) + F.col("value") % 1 / 5).alias("quality"), ((slots - 1) * 10 + F.col("value") / 1000).alias("throughput"), F.lit(4).alias("evidence"), F.lit(True).alias("ok"))
    return evaluation.choose_slots(samples)


_CHAIN = f"""WITH RECURSIVE h AS (SELECT user_id, event_id, sha256(coalesce(props, '')) AS payload_hash, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
  c AS (SELECT user_id, event_id, payload_hash, seq, '{'0' * 64}' AS previous_hash, sha256('{'0' * 64}' || '|' || payload_hash) AS entry_hash FROM h WHERE seq = 1
    UNION ALL SELECT h.user_id, h.event_id, h.payload_hash, h.seq, c.entry_hash, sha256(c.entry_hash || '|' || h.payload_hash) FROM c JOIN h ON h.user_id = c.user_id AND h.seq = c.seq + 1)"""


@query(_CHAIN + " SELECT user_id, event_id, payload_hash, seq, previous_hash, entry_hash FROM c")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chained(read(spark, sf_dir, "events", "user_id", "event_id", "props"), "user_id", "event_id", "props")


@query(_CHAIN + """, t AS (SELECT user_id, seq, CASE WHEN event_id % 97 = 0 THEN sha256('changed') ELSE payload_hash END AS payload_hash, previous_hash, entry_hash FROM c WHERE event_id % 89 <> 1),
  b AS (SELECT *, entry_hash = sha256(previous_hash || '|' || payload_hash) AND seq = row_number() OVER w AND previous_hash = lag(entry_hash, 1, repeat('0', 64)) OVER w AS ok FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq))
  SELECT user_id, count(*) AS entries, min(seq) FILTER (NOT ok) AS first_break FROM b GROUP BY user_id""")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain with some payloads changed and some entries gone, held against its hashes."""
    chain = audit_chain(spark, sf_dir).where("event_id % 89 <> 1")
    payload = F.when(F.col("event_id") % 97 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("payload_hash"))
    return audit.verified(chain.withColumn("payload_hash", payload), "user_id")
