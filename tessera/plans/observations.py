"""Series and episode queries over ``events`` as observations (user = subject, type = parameter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import episodes, series
from tessera.plans.registry import query, read

ORDER = ["ts", "event_id"]
SERIES = ["user_id", "event_type"]
LOW, HIGH = 5.0, 100.0
#: Days after which a type begins a new episode; types without one never split by time.
WINDOWS = {"click": 3, "error": 5, "purchase": 7, "view": 2}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return df.withColumns({"day": F.col("ts").cast("date"), "abnormal": (F.col("value") < LOW) | (F.col("value") > HIGH)})


_O = f"SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS day, (value < {LOW} OR value > {HIGH}) AS abnormal FROM events"
_PREV = f"""o AS ({_O}), p AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS previous_value,
  last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER w AS previous_day FROM o
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_DELTA = "coalesce(abs(day - previous_day) <= 7 AND CASE WHEN previous_value = 0 THEN abs(value) > 0 ELSE abs(value - previous_value) / abs(previous_value) >= 0.5 END, false)"


@query(f"WITH {_PREV} SELECT event_id, previous_value, previous_day FROM p")
def asof_previous_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.with_previous(observations(spark, sf_dir), SERIES, ORDER, "value", "day")
    return out.select("event_id", "previous_value", "previous_day")


def _with_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.with_previous(observations(spark, sf_dir), SERIES, ORDER, "value", "day")
    c = F.col
    return df.withColumn("delta", series.significant_delta(c("value"), c("previous_value"), c("day"), c("previous_day"), 7, 0.5))


@query(f"WITH {_PREV} SELECT event_id, {_DELTA} AS delta FROM p")
def lab_delta_abnormality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_delta(spark, sf_dir).select("event_id", "delta")


@query(f"""WITH {_PREV} SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' AND value > 300 THEN 'explicit_abnormal_flag' END,
  CASE WHEN abnormal THEN 'outside_reference_range' END, CASE WHEN {_DELTA} THEN 'significant_delta_within_range' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""")
def abnormality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flag = (c("event_type") == "error") & (c("value") > 300)
    reasons = series.abnormality_reasons(c("value"), F.lit(LOW), F.lit(HIGH), flag, F.lit(False), c("delta"))
    return _with_delta(spark, sf_dir).select("event_id", F.array_join(reasons, ",").alias("reasons"))


_DIRECTION = "CASE WHEN {n} < 2 THEN 'not_assessable' WHEN ({b} - {a}) / greatest(abs({a}), 1e-9) > 0.05 THEN 'increasing' WHEN ({b} - {a}) / greatest(abs({a}), 1e-9) < -0.05 THEN 'decreasing' ELSE 'stable' END"


@query(f"""WITH s AS (SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS baseline, arg_max(value, (ts, event_id)) AS latest, min(value) AS lowest, max(value) AS highest, count(*) AS points
  FROM events WHERE value IS NOT NULL GROUP BY ALL)
  SELECT *, latest - baseline AS absolute_change, CASE WHEN baseline <> 0 THEN 100 * (latest - baseline) / abs(baseline) END AS percent_change,
  {_DIRECTION.format(n='points', a='baseline', b='latest')} AS direction FROM s""")
def series_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_summary(read(spark, sf_dir, "events", *SERIES, *ORDER, "value"), SERIES, ORDER, "value")


@query(f"""WITH o AS ({_O}), s AS (SELECT user_id, event_type, count(*) AS value_count, count_if(abnormal) AS abnormal_count,
  min(CASE WHEN abnormal THEN day END) AS start_date, arg_max(day, (ts, event_id)) AS end_date, NOT arg_max(abnormal, (ts, event_id)) AS resolved,
  arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM o GROUP BY ALL)
  SELECT user_id, event_type, value_count, abnormal_count, start_date, end_date, resolved, {_DIRECTION.format(n='value_count', a='a', b='b')} AS direction
  FROM s WHERE abnormal_count >= 2 OR (abnormal_count = 1 AND resolved)""")
def lab_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trends(observations(spark, sf_dir), SERIES, ORDER, "value", "day", "abnormal")


@query(f"""WITH o AS ({_O}), i AS (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS l FROM o WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
  t AS (SELECT *, CASE WHEN abs(value - l) / greatest(abs(value), abs(l), 1e-9) >= 0.15 THEN CASE WHEN value > l THEN 'increasing' ELSE 'decreasing' END END AS turn FROM i),
  u AS (SELECT *, last_value(turn IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was,
    count(*) OVER (PARTITION BY user_id, event_type) AS n, max(CASE WHEN abnormal THEN i END) OVER (PARTITION BY user_id, event_type) AS bad FROM t),
  v AS (SELECT *, sum(CASE WHEN turn <> was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY i) AS phase FROM u),
  e AS (SELECT user_id, event_type, phase, min(i - 1) AS start_point, max(i) AS end_point, coalesce(max(turn), 'stable') AS direction, any_value(n) AS n, any_value(bad) AS bad FROM v WHERE l IS NOT NULL GROUP BY ALL),
  s AS (SELECT user_id, event_type, start_point, CASE WHEN bad < n THEN least(end_point, bad) ELSE end_point END AS end_point, direction FROM e WHERE NOT coalesce(bad < n, false) OR start_point <= bad
    UNION ALL SELECT DISTINCT user_id, event_type, bad, n, 'normalized' FROM e WHERE bad < n)
  SELECT s.user_id, s.event_type, CAST(row_number() OVER (PARTITION BY s.user_id, s.event_type ORDER BY start_point, end_point, direction = 'normalized') AS INT) AS phase_index, direction,
    CAST(start_point AS INT) AS start_point, CAST(end_point AS INT) AS end_point, a.value AS start_value, b.value AS end_value
  FROM s JOIN i a ON a.user_id = s.user_id AND a.event_type = s.event_type AND a.i = start_point JOIN i b ON b.user_id = s.user_id AND b.event_type = s.event_type AND b.i = end_point""")
def lab_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.phases(observations(spark, sf_dir), SERIES, ORDER, "value", "abnormal")


_BAND = "CASE WHEN offset_days IS NULL THEN 'undated' WHEN offset_days < 0 THEN '<0' WHEN offset_days <= 14 THEN '<=14' WHEN offset_days <= 112 THEN '<=112' WHEN offset_days <= 365 THEN '<=365' ELSE '>365' END"
_ANCHOR = f"WITH o AS ({_O}), a AS (SELECT *, min(CASE WHEN event_type = 'purchase' AND value > 40 THEN day END) OVER (PARTITION BY user_id) AS anchor_day FROM o), f AS (SELECT *, CAST(day - anchor_day AS INT) AS offset_days FROM a)"


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.anchor_offsets(observations(spark, sf_dir), "user_id", "day", (F.col("event_type") == "purchase") & (F.col("value") > 40))


@query(f"{_ANCHOR} SELECT event_id, anchor_day, offset_days, {_BAND} AS band FROM f")
def anchor_offset_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).select("event_id", "anchor_day", "offset_days", "band")


@query(f"{_ANCHOR} SELECT event_type, {_BAND} AS band, count(*) AS findings, count_if(event_type IN ('view', 'click')) = count(*) AS generic FROM f GROUP BY ALL")
def band_histogram_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    generic = F.count_if(F.col("event_type").isin("view", "click")) == F.count("*")
    return _offsets(spark, sf_dir).groupBy("event_type", "band").agg(F.count("*").alias("findings"), generic.alias("generic"))


_CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WINDOWS.items())


def _episode_sql(windows: str, resolved: str) -> str:
    return f"""WITH o AS (SELECT *, ({resolved}) AS res, CASE event_type {windows} END AS win FROM ({_O})),
  l AS (SELECT *, lag(res) OVER w AS pres, lag(day) OVER w AS pday FROM o WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
  e AS (SELECT *, sum(CASE WHEN coalesce(pres AND NOT res, false) OR coalesce(day - pday > win, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + 1 AS episode FROM l)"""


def _episodes(spark: SparkSession, sf_dir: str, windows: dict, resolved) -> DataFrame:
    df = observations(spark, sf_dir)
    return episodes.sessionize(df, SERIES, ORDER, "day", episodes.lookup(F.col("event_type"), windows), resolved)


def _v4_resolved() -> Column:
    return F.col("value") < LOW


_SUMMARY = "SELECT user_id, event_type, CAST(episode AS BIGINT) AS episode, min(day) AS onset, max(day) AS last_day, count(*) AS evidence, arg_max(res, (ts, event_id)) AS is_resolved FROM e GROUP BY ALL"


@query(_episode_sql(_CASES, f"value < {LOW}") + _SUMMARY)
def episodes_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.episode_table(_episodes(spark, sf_dir, WINDOWS, _v4_resolved()), SERIES, ORDER, "day", _v4_resolved())


@query(_episode_sql("WHEN 'click' THEN 3 WHEN 'error' THEN 4", "value < 2") + _SUMMARY)
def episodes_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = F.col("value") < 2
    return episodes.episode_table(_episodes(spark, sf_dir, {"click": 3, "error": 4}, resolved), SERIES, ORDER, "day", resolved)


@query(_episode_sql(_CASES, f"value < {LOW}") + "SELECT user_id, event_type, CAST(episode AS BIGINT) AS episode, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY episode) AS INT) AS recurrence FROM (SELECT DISTINCT user_id, event_type, episode FROM e)")
def recurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _episodes(spark, sf_dir, WINDOWS, _v4_resolved()).select(*SERIES, "episode").distinct()
    return series.recurrence_index(df, SERIES, ["episode"])


@query(f"""WITH RECURSIVE o AS ({_O}), d AS (SELECT DISTINCT user_id, event_type, day, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day) AS i FROM (SELECT DISTINCT user_id, event_type, day FROM o)),
  r AS (SELECT user_id, event_type, day, i, day AS anchor, 1 AS g FROM d WHERE i = 1
    UNION ALL SELECT d.user_id, d.event_type, d.day, d.i, CASE WHEN d.day - r.anchor > 5 THEN d.day ELSE r.anchor END, CASE WHEN d.day - r.anchor > 5 THEN r.g + 1 ELSE r.g END
    FROM r JOIN d ON d.user_id = r.user_id AND d.event_type = r.event_type AND d.i = r.i + 1)
  SELECT o.event_id, CAST(r.g AS INT) AS "group" FROM o JOIN r USING (user_id, event_type, day)""")
def anchored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.anchored_sessions(observations(spark, sf_dir), SERIES, "day", 5).select("event_id", "group")


@query(f"WITH o AS ({_O}), l AS (SELECT DISTINCT event_id FROM o WHERE abnormal) SELECT event_type AS disposition, count(*) AS total, count(l.event_id) AS linked, count_if(l.event_id IS NULL) AS residual FROM o LEFT JOIN l USING (event_id) GROUP BY event_type")
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir).withColumnRenamed("event_type", "disposition")
    return episodes.coverage_ledger(df, df.where("abnormal"), "event_id", "disposition")


@query("""WITH g AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, bool_or(value >= 50) AS y, bool_or(value < 5) AS n, count(DISTINCT value) AS numbers, count(DISTINCT event_type) AS units FROM events GROUP BY ALL)
  SELECT user_id, event_type, day, numbers, units, y AND n AS polarity_conflict, numbers > 1 AND units <= 1 AS numeric_conflict FROM g WHERE (y AND n) OR (numbers > 1 AND units <= 1)""")
def conflict_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("value") >= 50, "present").when(F.col("value") < 5, "absent").otherwise("unknown")
    df = observations(spark, sf_dir).withColumns({"assertion": said, "unit": F.col("event_type")})
    return episodes.conflicts(df, ["user_id", "event_type", "day"], "assertion", "value", "unit")


@query(_episode_sql(_CASES, f"value < {LOW}") + """, k AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'procedure' WHEN 'error' THEN 'symptom' WHEN 'click' THEN 'medication' WHEN 'view' THEN 'laboratory_finding' ELSE 'other' END AS category FROM e)
  SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, day ORDER BY CASE category WHEN 'procedure' THEN 2 WHEN 'symptom' THEN 4 WHEN 'medication' THEN 8 WHEN 'laboratory_finding' THEN 9 ELSE 10 END, ts, event_id) = 1 THEN 'core'
    WHEN res THEN 'negative_context' WHEN category = 'symptom' THEN 'manifestation' WHEN category IN ('medication', 'procedure') THEN 'treatment' WHEN category = 'laboratory_finding' THEN 'monitoring' ELSE 'core' END AS role FROM k""")
def cluster_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"purchase": "procedure", "error": "symptom", "click": "medication", "view": "laboratory_finding"}
    df = observations(spark, sf_dir).withColumn("category", F.coalesce(episodes.lookup(F.col("event_type"), kinds), F.lit("other")))
    return episodes.roles(df, ["user_id", "day"], "category", ORDER, _v4_resolved()).select("event_id", "role")
