"""Laboratory, evidence-rule, identity and toxicity queries; text is composed from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import evidence, identity, labs, toxicity
from tessera.plans.observations import LOW, observations
from tessera.plans.registry import query, read

_UNIT = ["mg/dl", "G/dL", "ug/L", "zz"]
_MARK = ["", " *", " H", ""]


def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines such as 'Analita 3: 17 mg/dl (10 - 40) *' of each order."""
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))
    numeric = F.concat(F.lit("Analita "), (F.col("l_suppkey") % 9).cast("string"), F.lit(": "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), pick(_UNIT, "l_suppkey"), F.lit(" (10 - 40)"), pick(_MARK, "l_partkey"))
    worded = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "HCV anticorpi").otherwise("Anti HBs"), F.lit(": positivo"))
    line = F.when(F.col("l_partkey") % 10 == 0, worded).when(F.col("l_partkey") % 10 == 1, "Referto senza valori").otherwise(numeric)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))


_LINES = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 10 = 0 AS worded, CAST(l_quantity AS INT) AS q, [' ', '*', 'H', ' '][l_partkey % 4 + 1] AS m FROM lineitem WHERE l_partkey % 10 <> 1),
  r AS (SELECT l_orderkey, l_linenumber, CASE WHEN NOT worded THEN 'Analita ' || CAST(l_suppkey % 9 AS VARCHAR) WHEN l_suppkey % 2 = 0 THEN 'HCV anticorpi' ELSE 'Anti HBs' END AS parameter,
    CASE WHEN NOT worded THEN CAST(q AS DOUBLE) END AS value, CASE WHEN worded THEN 'POSITIVO' END AS value_text, CASE WHEN NOT worded THEN ['mg/dL', 'g/dL', 'μg/L', 'zz'][l_suppkey % 4 + 1] END AS unit,
    CASE WHEN worded THEN CASE WHEN l_suppkey % 2 = 0 THEN '*' END WHEN m = 'H' THEN 'H' WHEN q > 40 THEN 'H' WHEN q < 10 THEN 'L' WHEN m = '*' THEN '*' END AS flag FROM l)"""


@query(f"WITH {_LINES} SELECT *, flag IS NOT NULL AS abnormal FROM r")
def lab_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labs.result_lines(_report_lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "parameter", "value", "value_text", "unit", "flag", "abnormal")


@query(f"""WITH {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, parameter, value, value_text, unit ORDER BY l_linenumber) AS n FROM r) SELECT l_orderkey, l_linenumber, parameter FROM n WHERE n = 1""")
def lab_best_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labs.best_copies(labs.result_lines(_report_lines(spark, sf_dir)), "l_orderkey", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "parameter")


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber FROM r WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.l_orderkey = r.l_orderkey AND s.parameter = r.parameter AND s.l_linenumber % 2 = 0 AND (s.value IS NULL OR r.value IS NULL OR s.value = r.value) AND (s.unit IS NULL OR r.unit IS NULL OR s.unit = r.unit)) AND l_linenumber % 2 = 1")
def lab_restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labs.result_lines(_report_lines(spark, sf_dir)).withColumn("day", F.lit(None).cast("date"))
    left = labs.without_restated(out.where("l_linenumber % 2 = 1"), out.where("l_linenumber % 2 = 0"), ["l_orderkey", "parameter"])
    return left.select("l_orderkey", "l_linenumber")


#: A quote is an opening, a thing and an ending, picked by the digits of an event's number.
OPENINGS = [
    "Si sospende", "Non si sospende", "Inizia terapia con", "Dose ridotta di", "Completato ciclo di", "Non evidenza di", "Il paziente riferisce", "Quadro compatibile con", "Si programma", "Eseguita",
    "Ripresa di", "Ultima somministrazione di", "In trattamento con", "Esclusa", "Appuntamento fissato per", "Inizialmente", "È in trattamento con", "Riduzione della dose di", "Riduzione di", "Dosaggio ridotto di",
]
THINGS = ["farmaco X 50 mg per os", "dolore toracico", "Prossima visita", "TC di controllo", "cisplatino 25 mg/m2 ev", "emoglobina 10,5 g/dl", "Iniezione di 18F-FDG", "Modalità di esecuzione: standard", "Utero antiversoflesso", "protocollo di acquisizione", "secondo art. 12", "città, così è", "iniezione di insulina"]
ENDINGS = ["", " con esito nella norma", " da domani", ": negativa per metastasi", ", probabile"]
KINDS = ["medication", "imaging_finding", "symptom", "diagnosis", "procedure", "biomarker", "care_plan"]
#: What these say, answered by hand.
SAID_OF_MEDICATION = {"Si sospende": "suspended", "Inizia terapia con": "started", "Dose ridotta di": "dose_changed", "Completato ciclo di": "completed", "Ripresa di": "resumed", "Ultima somministrazione di": "administered", "È in trattamento con": "active", "Riduzione della dose di": "dose_changed", "Dosaggio ridotto di": "dose_changed"}
FURNITURE = {"Prossima visita": "scheduling", "Iniezione di 18F-FDG": "diagnostic_tracer_administration", "Modalità di esecuzione: standard": "report_metadata", "protocollo di acquisizione": "diagnostic_method", "secondo art. 12": "regulatory_boilerplate"}


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, entity, quote, category, assertion, status."""
    df = read(spark, sf_dir, "events", "event_id")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("event_id") / by) % len(values)).cast("int"))
    quote = F.concat(pick(OPENINGS, 1), F.lit(" "), pick(THINGS, 3), pick(ENDINGS, 7))
    return df.select("event_id", pick(THINGS, 3).alias("entity"), quote.alias("quote"), pick(KINDS, 1).alias("category"), pick(["present", "absent", "conditional"], 11).alias("assertion"), pick([None, "normal", "active"], 7).alias("status"))


def _pick_sql(values: list, by: int) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][CAST(floor(event_id / {by}) AS BIGINT) % {len(values)} + 1]"


_QUOTES = f"""q AS (SELECT event_id, {_pick_sql(THINGS, 3)} AS entity, {_pick_sql(OPENINGS, 1)} AS opening, {_pick_sql(ENDINGS, 7)} AS ending,
  {_pick_sql(KINDS, 1)} AS category, {_pick_sql(["present", "absent", "conditional"], 11)} AS assertion, {_pick_sql([None, "normal", "active"], 7)} AS status FROM events)"""


def _answer_sql(column: str, answers: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in answers.items()) + " END"


@query(f"""WITH {_QUOTES} SELECT event_id, CASE WHEN opening = 'Si sospende' AND assertion = 'conditional' THEN NULL ELSE {_answer_sql("opening", SAID_OF_MEDICATION)} END AS lifecycle,
  opening IN ('Non si sospende', 'Non evidenza di') AS negated,
  CASE WHEN (opening IN ('Non evidenza di', 'Esclusa') OR ending = ': negativa per metastasi') AND category NOT IN ('medication', 'procedure', 'care_plan') THEN 'excluded' WHEN opening = 'Il paziente riferisce' AND category = 'symptom' THEN 'patient_reported'
    WHEN opening = 'Quadro compatibile con' OR ending = ', probabile' THEN 'suspected' WHEN assertion = 'present' AND category NOT IN ('symptom', 'care_plan') THEN 'confirmed' ELSE 'unknown' END AS certainty,
  (opening = 'Si programma' OR entity = 'Prossima visita') AND opening <> 'Eseguita' AND ending <> ' con esito nella norma' AS planned,
  {_answer_sql("entity", {"farmaco X 50 mg per os": "50 mg", "cisplatino 25 mg/m2 ev": "25 mg/m2", "emoglobina 10,5 g/dl": "10,5 g/dl"})} AS dose, {_answer_sql("entity", {"farmaco X 50 mg per os": "os", "cisplatino 25 mg/m2 ev": "ev"})} AS route FROM q""")
def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quotes(spark, sf_dir)
    q, none = F.col("quote"), F.lit(None).cast("string")
    sure = evidence.certainty(F.col("category"), F.col("assertion"), F.lit("unknown"), q, none, F.lit(True))
    given = evidence.medication_attributes(q, none, none)
    return rows.select("event_id", evidence.lifecycle(q, F.col("assertion")).alias("lifecycle"), evidence.directly_negated(q).alias("negated"), sure.alias("certainty"), evidence.planned(q).alias("planned"), given["dose"].alias("dose"), given["route"].alias("route"))


@query(f"""WITH {_QUOTES}, r AS (SELECT *, CASE WHEN entity = 'Utero antiversoflesso' AND ending <> ': negativa per metastasi' THEN 'routine_normal_finding' WHEN entity IN ('Modalità di esecuzione: standard') THEN 'report_metadata'
    WHEN opening = 'Appuntamento fissato per' THEN 'scheduling' ELSE {_answer_sql("entity", FURNITURE)} END AS reason FROM q),
  d AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'administrative' WHEN assertion IN ('absent', 'conditional') OR coalesce(status = 'normal', false)
    OR (category IN ('imaging_finding', 'symptom', 'diagnosis', 'biomarker') AND (opening IN ('Non evidenza di', 'Esclusa') OR ending IN (' con esito nella norma', ': negativa per metastasi'))) THEN 'contextual' ELSE 'primary' END AS role FROM r)
  SELECT event_id, role, reason, CASE role WHEN 'primary' THEN 'accepted_clinical' WHEN 'contextual' THEN 'accepted_low_relevance' ELSE CASE reason WHEN 'scheduling' THEN 'excluded_administrative'
    WHEN 'diagnostic_method' THEN 'excluded_methodological' WHEN 'diagnostic_tracer_administration' THEN 'excluded_methodological' WHEN 'routine_normal_finding' THEN 'excluded_non_informative' ELSE 'excluded_boilerplate' END END AS relevance FROM d""")
def evidence_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    role = evidence.disposition(c("entity"), c("quote"), c("category"), c("assertion"), F.lit("unknown"), c("status"))
    rows = _quotes(spark, sf_dir).select("event_id", role.alias("role"), evidence.administrative_reason(c("entity"), c("quote")).alias("reason"))
    return rows.withColumn("relevance", evidence.relevance(c("role"), c("reason")))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'F' || c_custkey % 200 END AS code, CASE WHEN c_custkey % 5 = 0 THEN 'H' || c_custkey % 150 END AS hosp, c_mktsegment AS name, c_custkey % 37 AS birth FROM customer),
  r AS (SELECT c_custkey AS subject, * FROM c WHERE c_custkey < 120), e AS (SELECT * FROM c WHERE c_custkey >= 120),
  f AS (SELECT code, min(subject) AS s, count(DISTINCT subject) > 1 AS m FROM r WHERE code IS NOT NULL GROUP BY code), h AS (SELECT hosp, min(subject) AS s, count(DISTINCT subject) > 1 AS m FROM r WHERE hosp IS NOT NULL GROUP BY hosp),
  p AS (SELECT name, birth, min(subject) AS s FROM r GROUP BY ALL),
  j AS (SELECT c_custkey, f.s AS fs, h.s AS hs, p.s AS ps, coalesce(f.m, false) OR coalesce(h.m, false) OR coalesce(f.s <> p.s, false) OR coalesce(h.s <> p.s, false) OR coalesce(f.s <> h.s, false) AS conflict
    FROM e LEFT JOIN f USING (code) LEFT JOIN h USING (hosp) LEFT JOIN p USING (name, birth))
  SELECT c_custkey, CASE WHEN NOT conflict THEN coalesce(fs, hs, ps) END AS subject_id, CASE WHEN conflict THEN NULL WHEN fs IS NOT NULL THEN 'code' WHEN hs IS NOT NULL THEN 'hospital_id' WHEN ps IS NOT NULL THEN 'name_and_birth' END AS reason, conflict FROM j""")
def identity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    field = lambda name, column: identity.keyed(name, column, "test key").alias(name)
    df = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(
        "c_custkey",
        field("code", F.when(k % 3 == 0, F.concat(F.lit("F"), (k % 200).cast("string")))),
        field("hospital_id", F.when(k % 5 == 0, F.concat(F.lit("H"), (k % 150).cast("string")))),
        field("name", F.col("c_mktsegment")),
        field("birth", (k % 37).cast("string")),
    )
    out = identity.match(df.where("c_custkey >= 120"), df.where("c_custkey < 120").withColumn("subject_id", k), "c_custkey")
    return out.select("c_custkey", "subject_id", "reason", "conflict")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 300 END AS code, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 110 END AS hosp FROM customer),
  e AS (SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON a.code = b.code AND a.k <> b.k UNION SELECT a.k, b.k FROM c a JOIN c b ON a.hosp = b.hosp AND a.k <> b.k),
  w AS (SELECT k, k AS root FROM c UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.k WHERE w.root < e.b) SELECT k AS c_custkey, min(root) AS "group" FROM w GROUP BY k""")
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    df = read(spark, sf_dir, "customer", "c_custkey").withColumns({"code": F.when(k % 4 == 0, k % 300), "hospital": F.when(k % 7 == 0, k % 110)})
    return identity.groups(df, "c_custkey", ["code", "hospital"])


@query("""WITH o AS (SELECT *, CAST(ts AS DATE) AS day FROM events), a AS (SELECT *, min(CASE WHEN event_type = 'signup' AND value > 60 THEN day END) OVER (PARTITION BY user_id) AS a0 FROM o), f AS (SELECT *, day - a0 AS d FROM a WHERE NOT (event_type = 'signup' AND value > 60))
  SELECT user_id, event_type AS organ, count(*) AS findings, count(*) FILTER (WHERE d < 0) AS before, count(*) FILTER (WHERE d BETWEEN 0 AND 14) AS early, count(*) FILTER (WHERE d BETWEEN 15 AND 112) AS middle, count(*) FILTER (WHERE d BETWEEN 113 AND 365) AS late, count(*) FILTER (WHERE d > 365) AS very_late,
    count(*) FILTER (WHERE d IS NULL) AS undated, min(CASE WHEN d >= 0 THEN day END) AS first_after FROM f GROUP BY ALL""")
def toxicity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = observations(spark, sf_dir).withColumn("organ", F.col("event_type"))
    return toxicity.report(df, "user_id", "day", (F.col("event_type") == "signup") & (F.col("value") > 60), "organ")


@query("""WITH f AS (SELECT event_id, event_type AS organ FROM events WHERE event_id % 3 = 0), c AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'remove' WHEN event_id % 3 = 0 THEN 'edit' ELSE 'add' END AS action FROM events WHERE event_id % 4 = 0)
  SELECT coalesce(f.event_id, c.event_id) AS event_id, CASE WHEN action IN ('edit', 'add') THEN 'fixed' ELSE organ END AS organ FROM f FULL JOIN c ON f.event_id = c.event_id WHERE coalesce(action, '') <> 'remove'""")
def correction_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "event_id", F.col("event_type").alias("organ"))
    k = F.col("event_id")
    action = F.when(k % 5 == 0, "remove").when(k % 3 == 0, "edit").otherwise("add")
    corrections = df.where("event_id % 4 = 0").select("event_id", action.alias("action"), F.lit("fixed").alias("organ"), F.lit(1).alias("seq"))
    return toxicity.corrected(df.where("event_id % 3 = 0"), corrections, "event_id", "organ")


@query("""WITH t AS (SELECT o_custkey AS subject, CASE WHEN o_orderkey % 3 > 0 THEN 'linea_' || o_orderkey % 3 ELSE 'unspecified_' || replace(lower(o_orderpriority[3:]), ' ', '_') END AS line_key, lower(o_orderpriority) AS drug, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'suspended' END AS status FROM orders),
  d AS (SELECT subject, line_key, drug, min((day, k)) AS f FROM t GROUP BY ALL)
  SELECT subject, line_key, min(day) AS start_date, arg_max(status, (day, k)) AS status, count(*) AS evidence, CASE WHEN arg_max(status, (day, k)) IN ('completed', 'suspended') THEN max(day) END AS end_date,
    (SELECT string_agg(drug, ',' ORDER BY f) FROM d WHERE d.subject = t.subject AND d.line_key = t.line_key) AS drugs FROM t GROUP BY subject, line_key""")
def treatment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.projections import treatment_lines as lines_of

    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("suspended")
    df = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus").select(
        F.col("o_custkey").alias("subject"), F.when(k % 3 > 0, F.concat(F.lit("Linea "), (k % 3).cast("string"))).alias("line"), F.lower(F.substring("o_orderpriority", 3, 30)).alias("name"), F.lower("o_orderpriority").alias("drug"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", status.alias("status")
    )
    df = df.withColumn("line", F.coalesce("line", F.concat(F.lit("unspecified "), "name")))
    out = lines_of(df, "subject", "line", "drug", ["day", "o_orderkey"], "status")
    return out.withColumn("drugs", F.array_join("drugs", ","))


@query("""WITH o AS (SELECT *, CAST(ts AS DATE) AS day, event_type AS entity, CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'account' END AS system, user_id % 7 AS document, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS category FROM events),
  c AS (SELECT * FROM o WHERE value < 5), e AS (SELECT * FROM o WHERE value >= 5),
  p AS (SELECT c.event_id AS item_id, e.event_id, e.day, c.entity = e.entity AS same, CASE WHEN c.entity = e.entity THEN 7 ELSE 0 END + CASE WHEN c.category = e.category THEN 2 ELSE 0 END + CASE WHEN c.system = e.system THEN 3 ELSE 0 END + CASE WHEN c.document = e.document THEN 3 ELSE 0 END
    + CASE WHEN abs(c.day - e.day) <= 7 THEN 2 WHEN abs(c.day - e.day) <= 30 THEN 1 ELSE 0 END AS score FROM c JOIN e USING (user_id) WHERE c.entity = e.entity OR (c.system = e.system AND c.document = e.document)),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, day DESC, event_id DESC) AS n FROM p WHERE same OR score >= 7) SELECT item_id, event_id, CAST(score AS INT) AS score FROM r WHERE n = 1""")
def contextual_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.projections import attach_context

    df = observations(spark, sf_dir).select(
        "user_id", "event_id", "day", "value", F.col("event_type").alias("entity"), F.when(F.col("event_type").isin("click", "view"), "web").otherwise("account").alias("system"), (F.col("user_id") % 7).alias("document"), F.when(F.col("value") > 50, "high").otherwise("low").alias("category")
    )
    return attach_context(df.where("value < 5").withColumnRenamed("event_id", "item_id"), df.where("value >= 5"), "user_id")


@query("""SELECT user_id, string_agg(CAST(CAST(ts AS DATE) AS VARCHAR) || ' | ' || event_type, chr(10) ORDER BY CAST(ts AS DATE), event_id) AS listing FROM events GROUP BY user_id""")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.projections import listing

    return listing(observations(spark, sf_dir), "user_id", ["day", "event_id"], [F.col("day").cast("string"), F.col("event_type")])


@query()
def event_bundle_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.graph import _checkpoint_dir
    from tessera.operators.projections import merge_bundles

    df = observations(spark, sf_dir)
    _checkpoint_dir(df)
    text = F.concat_ws(" ", F.lit("summary of"), "event_type", F.lit("value"), F.round("value", 0).cast("long").cast("string"), F.lit("for subject"), F.col("user_id").cast("string"))
    rows = df.select("user_id", "event_id", text.alias("text"), "day", "event_type", F.when(F.col("value") < LOW, "absent").otherwise("present").alias("polarity"), (F.lit(0.5) + F.col("event_id") % 4 / 10).alias("confidence"))
    return merge_bundles(rows, "user_id", "event_id", "text", "day", "event_type", "polarity", "confidence")


#: Names of analytes with their unit and material, and the canonical names by hand.
ANALYTES = [
    ("Hb", "g/dl", "", "emoglobina"), ("Hb glicata", "%", "", "emoglobina_glicata"), ("GOT (AST)", "U/l", "", "aspartato_aminotransferasi_(aspartato_aminotransferasi)"), ("S-GPT", "UI/L", "", "s-alanina_aminotransferasi"), ("Creat.", "mg/dl", "", "creat"),
    ("PT (INR)", "", "", "tempo_protrombina_inr"), ("PT ratio", "ratio", "", "tempo_protrombina_ratio"), ("Neutrofili", "%", "", "neutrofili_percentuale"), ("NEUTROFILI:", "x10^3/µL", "", "neutrofili_assoluti"), ("Neutrofili", "", "", "neutrofili"),
    ("Emoglobina", "mg/dL", "urine", "emoglobina_urine"), ("Emoglobina", "g/dL", "urine", "emoglobina"), ("Proteine", "mg/dl", "Liquor", "proteine_liquor"), ("Glicemia", "mg/dl", "urine", "glucosio_urine"), ("Glicemia", "", "urine", "glucosio"), ("aPTT", "sec", "", "tempo_tromboplastina_parziale_attivata"), ("T4 libera", "ng/dl", "", "tiroxina_libera"),
]


@query(f"SELECT event_id, {_pick_sql([a[3] for a in ANALYTES], 1)} AS parameter FROM events")
def parameter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: F.get(F.array(*[F.lit(a[k]) for a in ANALYTES]), (F.col("event_id") % len(ANALYTES)).cast("int"))
    return read(spark, sf_dir, "events", "event_id").select("event_id", labs.normal_parameter(pick(0), pick(1), pick(2)).alias("parameter"))


_NAMES = "(CASE c_custkey % 3 WHEN 0 THEN 'n' || c_custkey % 7 || ' m' || c_custkey % 11 WHEN 1 THEN 'M' || c_custkey % 11 || '  n' || c_custkey % 7 || ' x' || c_custkey % 5 ELSE 'n' || c_custkey % 7 || ' y' || c_custkey % 13 END)"


@query(f"""WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey % 45 AS birth, list_sort(list_distinct(string_split_regex(lower({_NAMES}), ' +'))) AS words FROM customer),
  e AS (SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON a.birth = b.birth AND a.k <> b.k AND (list_has_all(a.words, b.words) OR list_has_all(b.words, a.words))),
  w AS (SELECT k, k AS root FROM c UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.k WHERE w.root < e.b) SELECT k AS c_custkey, min(root) AS "group" FROM w GROUP BY k""")
def subset_name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer", "c_custkey").select("c_custkey", (F.col("c_custkey") % 45).alias("birth"), F.expr(_NAMES.replace("||", "||")).alias("name"))
    return identity.groups(df, "c_custkey", [], identity.subset_names(df, "c_custkey", "birth", "name"))


#: Layouts of tables made of an order's lines: what each column holds, in order.
LAYOUTS = [["Esame", "Risultato", "Unità", "Riferimento"], ["Intervallo", "Value", "Parameter", "Note", "U.M."], ["Voce", "A", "B", "C"]]


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey) AS row_no, l_quantity AS q, l_linenumber AS n FROM lineitem WHERE l_orderkey % 3 < 2),
  v AS (SELECT *, CASE WHEN n % 4 = 3 THEN NULL ELSE q / 2 END AS value FROM l WHERE n % 5 <> 4)
  SELECT l_orderkey, CAST(row_no AS INT) AS row_no, CASE WHEN n % 2 = 0 THEN 'emoglobina' ELSE 'potassio' END AS name, value, CASE WHEN value IS NULL THEN 'NEGATIVO' END AS value_text, CASE WHEN n % 2 = 0 THEN 'g/dL' ELSE 'mmol/L' END AS unit,
    CASE WHEN value IS NULL THEN false ELSE value > 16 OR value < 4 END AS abnormal, CASE WHEN value > 16 THEN 'H' WHEN value < 4 THEN 'L' END AS flag FROM v""")
def lab_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a table in one of three layouts; the third names no analyte and no value."""
    from tessera.operators.lab_tables import table_results

    n = F.col("l_linenumber")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    number = F.replace(F.format_string("%.1f", F.col("l_quantity") / 2), F.lit("."), F.lit(","))
    name = F.when(n % 5 == 4, "Pagina").when(n % 2 == 0, "Hb").otherwise("Potassio")
    held = {"name": name, "value": F.when(n % 4 == 3, "negativo").otherwise(number), "unit": F.when(n % 2 == 0, "g/dl").otherwise("mmol/l"), "range": F.lit("4-16")}
    order = [["name", "value", "unit", "range"], ["range", "value", "name", None, "unit"], ["name", "value", "unit", "range"]]
    cells = lambda names, values: F.array(*[F.struct(F.lit(i).alias("c"), (F.lit(names[i]) if names else values[i]).alias("x")) for i in range(len(names or values))])
    by_layout = lambda made: reduce(lambda a, k: F.when(F.col("l_orderkey") % 3 == k, made(k)).otherwise(a), (0, 1), made(2))
    body = by_layout(lambda k: cells(None, [held[x] if x else F.lit("x") for x in order[k]]))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_partkey", "l_suppkey"))
    rows = lines.select("l_orderkey", place.alias("row_no"), body.alias("cells"))
    heads = lines.select("l_orderkey").distinct().select("l_orderkey", F.lit(0).alias("row_no"), by_layout(lambda k: cells(LAYOUTS[k], None)).alias("cells"))
    flat = rows.unionByName(heads).select("l_orderkey", "row_no", F.explode("cells").alias("e")).select("l_orderkey", "row_no", "e.c", "e.x")
    return table_results(flat, ["l_orderkey"], "row_no", "c", "x").select("l_orderkey", "row_no", "name", "value", "value_text", "unit", "abnormal", "flag")


#: Lines put among an order's: what the line says, and by hand the name, value, words, unit and flag it gives (None: no result).
SAID = [
    ("Emoglobina: 10,5 * g/dL (12-16)", ("emoglobina", 10.5, None, "g/dL", "L")), ("Sodio 140 mmol/L", ("sodio", 140.0, None, "mmol/L", None)), ("HIV: NEGATIVO", ("hiv", None, "NEGATIVO", "", None)), ("Testo senza risultato", None),
    ("HBsAg Positivo", ("hbsag", None, "POSITIVO", "", "*")), ("PCR < 0,5 mg/dL", ("proteina_c_reattiva", 0.5, None, "mg/dL", None)), ("Laboratorio: 3 %", None), ("| Cloro | 100 | | mmol/L | 90-110 |", None),
]


def _said_sql(k: int) -> str:
    shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE s " + " ".join(f"WHEN {i} THEN {shown(answer[k])}" for i, (_, answer) in enumerate(SAID) if answer) + " END"


@query(f"""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey) AS line_no FROM lineitem), k AS (SELECT *, CAST((l_orderkey + 3 * line_no) % {len(SAID)} AS INT) AS s FROM l)
  SELECT l_orderkey, CAST(line_no AS INT) AS line_no, {_said_sql(0)} AS name, CAST({_said_sql(1)} AS DOUBLE) AS value, {_said_sql(2)} AS value_text, {_said_sql(3)} AS unit, {_said_sql(4)} AS flag FROM k WHERE s NOT IN (3, 6, 7)""")
def lab_text_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as lines of a report; a lone pipe row is no table."""
    from tessera.operators.lab_tables import text_results

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_partkey", "l_suppkey"))
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").select("l_orderkey", place.alias("line_no"))
    line = F.get(F.array(*[F.lit(text) for text, _ in SAID]), ((F.col("l_orderkey") + 3 * F.col("line_no")) % len(SAID)).cast("int"))
    return text_results(rows.withColumn("line", line), "l_orderkey").select("l_orderkey", "line_no", "name", "value", "value_text", "unit", "flag")
