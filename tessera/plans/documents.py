"""Text queries over ``documents`` and ``benchmark``; all run over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import cleaner, relational, retrieval, texts
from tessera.plans.registry import query, read


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id", "text", *more)


_EMAIL, _PHONE, _IP = tx.EMAIL, tx.PHONE, tx.IP_ADDRESS
_SIMPLE = [("email", _EMAIL), ("phone", _PHONE), ("address", _IP)]


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_PHONE}', '[PHONE]', 'g'), '{_IP}', '[ADDRESS]', 'g')) AS digest,
  CAST(len(regexp_extract_all(text, '{_EMAIL}')) AS INT) AS email, CAST(len(regexp_extract_all(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), '{_PHONE}')) AS INT) AS phone FROM documents""")
def redact_email_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir)
    counts = tx.redaction_counts(F.col("text"), _SIMPLE)
    return df.select("doc_id", F.md5(tx.redacted(F.col("text"), _SIMPLE)).alias("digest"), counts["email"].alias("email"), counts["phone"].alias("phone"))


def _passes_sql() -> str:
    """Each pass on the text that the passes before it left, and how often it matched there."""
    text, counts = "text", []
    for name, pattern in tx.PASSES:
        counts.append(f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS INT) AS {name}")
        text = f"regexp_replace({text}, '{pattern}', '[{name.upper()}]', 'g')"
    return f"SELECT doc_id, {text} AS text, {', '.join(counts)} FROM documents"


@query(_passes_sql())
def redact_all_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir)
    return df.select("doc_id", tx.redacted(F.col("text")).alias("text"), tx.redaction_counts(F.col("text")).alias("c")).select("doc_id", "text", "c.*")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, trim(line)) AS n FROM l)
  SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (n >= 3 AND length(trim(line)) > 2)), '')) AS digest FROM c GROUP BY doc_id""")
def repeated_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(texts.without_repeated_lines(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')) AS digest FROM documents""")
def whitespace_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(tx.clean_whitespace(F.col("text"))).alias("digest"))


#: Weighted words of each class of this corpus.
CLASSES = {"license": {"license": 4, "released under": 3}, "credentials": {"token =": 4, "password": 3}, "contact": {"@": 2, "555-": 3}, "shouting": {"!!": 2}, "table": {" | ": 3}}


def _class_sql() -> str:
    scores = {name: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {n} ELSE 0 END" for w, n in words.items()) for name, words in CLASSES.items()}
    best = f"greatest({', '.join(scores.values())})"
    return f"SELECT doc_id, CASE {' '.join(f'WHEN {s} = {best} AND {best} > 0 THEN {chr(39)}{n}{chr(39)}' for n, s in scores.items())} ELSE 'other' END AS kind FROM documents"


@query(_class_sql())
def classify_by_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = {name: texts.keyword_score(F.col("text"), words) for name, words in CLASSES.items()}
    return _documents(spark, sf_dir).select("doc_id", texts.weighted_class(scores).alias("kind"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
_HEADING = """length(trim(line)) > 0 AND length(trim(line)) <= 100 AND (starts_with(trim(line), '#') OR ends_with(trim(line), ':') OR
  (length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) > 0.85 * length(regexp_replace(line, '[^A-Za-z]', '', 'g'))))"""
_SECTIONS = f"""{_LINES}, s AS (SELECT *, last_value(CASE WHEN {_HEADING} THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l)"""


def _section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.with_sections(texts.lines(_documents(spark, sf_dir)), "doc_id")


@query(f"WITH {_SECTIONS} SELECT doc_id, CAST(line_no AS INT) AS line_no, section FROM s WHERE section IS NOT NULL")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _section_lines(spark, sf_dir).where("section is not null").select("doc_id", "line_no", "section")


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS t FROM l), f AS (SELECT *, sha256(chr(31) || chr(31) || t) AS fingerprint FROM t WHERE length(t) >= 80 AND len(string_split(t, ' ')) >= 10),
  o AS (SELECT *, first_value(doc_id) OVER w AS owner, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY fingerprint ORDER BY doc_id, line_no))
  SELECT doc_id, CAST(line_no AS INT) AS line_no, owner, n > 1 AS reused FROM o""")
def block_fingerprint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line_rows = texts.lines(_documents(spark, sf_dir))
    prints = line_rows.select("doc_id", "line_no", texts.fingerprint(F.lit(""), F.lit(""), F.col("line")).alias("fingerprint"))
    return texts.block_owners(prints, "doc_id", ["doc_id", "line_no"]).select("doc_id", "line_no", "owner", "reused")


@query(f"""WITH {_LINES}, m AS (SELECT *, contains(line, 'License') AS lab FROM l), n AS (SELECT *, coalesce(lead(lab) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS nxt FROM m)
  SELECT doc_id, count(*) AS kept FROM n WHERE NOT lab AND NOT nxt GROUP BY doc_id""")
def label_value_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = texts.label_values(texts.lines(_documents(spark, sf_dir)), "doc_id", F.contains(F.col("line"), F.lit("License")))
    return out.groupBy("doc_id").agg(F.count("*").alias("kept"))


@query()
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir).select("doc_id", F.explode(texts.sentence_spans("text")).alias("s"))
    return df.select("doc_id", "s.index", "s.start", "s.end", "s.text")


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _documents(spark, sf_dir).select("doc_id", F.explode(texts.chunks(F.col("text"), 4000)).alias("c"))
    return df.select("doc_id", "c.index", "c.start", "c.text")


@query("SELECT doc_id, sha256(text) AS file_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc, doc_id > min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents")
def file_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("file_hash"))
    first = hashed.groupBy("file_hash").agg(F.min("doc_id").alias("first_doc"))
    return hashed.join(first, "file_hash").select("doc_id", "file_hash", "first_doc", (F.col("doc_id") > F.col("first_doc")).alias("duplicate"))


_NORM = "trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g'))"


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, {_NORM.format('text')} AS t FROM documents) d JOIN (SELECT item_id, {_NORM.format('text')} AS q FROM benchmark) b ON contains(t, q)")
def quote_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.quote_locations(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark", "item_id", "text"))


@query("""WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents)
  SELECT doc_id, lang, n_chars FROM r WHERE n <= 12 ORDER BY n > 1, n_chars DESC, doc_id LIMIT 12""")
def stratified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    return relational.stratified_top(df, "lang", [F.desc("n_chars"), "doc_id"], 12)


QUESTION = "the and tionth license reth"
_TERMS = ["license", "reth", "tionth"]
_TOKENS = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)"
_HITS = " OR ".join(f"starts_with(term, '{t}')" for t in _TERMS)
_WHICH = "CASE " + " ".join(f"WHEN starts_with(term, '{t}') THEN '{t}'" for t in _TERMS) + " END"


@query(f"""WITH {_TOKENS}, dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  f AS (SELECT doc_id, {_WHICH} AS q, count(*) AS tf FROM t WHERE {_HITS} GROUP BY ALL), d AS (SELECT q, count(*) AS df FROM f GROUP BY q)
  SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM f JOIN d USING (q) JOIN dl USING (doc_id) CROSS JOIN s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_documents(spark, sf_dir), QUESTION, most=25, stop_words=["the", "and"]).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(F.col("text").ilike("%license%")).select("doc_id")


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') THEN 'security' ELSE 'general' END AS intent, length(text) > 4000 AS is_broad FROM documents""")
def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = {"legal": ["license"], "security": ["token", "password"]}
    return _documents(spark, sf_dir).select("doc_id", retrieval.intent(F.col("text"), intents, "general").alias("intent"), (F.length("text") > 4000).alias("is_broad"))


_FOLDED = "regexp_replace(lower(strip_accents(text)), '[^{}]+', ' ', 'g')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


@query(f"""WITH t AS (SELECT doc_id, list_filter(string_split({_FOLDED.format("a-z0-9%+")}, ' '), lambda x: x <> '' AND NOT list_contains({_STOPS}, x)) AS tokens,
  list_filter(string_split({_FOLDED.format("a-z0-9")}, ' '), lambda x: length(x) >= 4 AND NOT list_contains({_STOPS}, x)) AS terms FROM documents)
  SELECT doc_id, array_to_string(tokens[:20], '_') AS entity, CAST(len(list_distinct(terms)) AS INT) AS terms FROM t""")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.entity_key(F.col("text")).alias("entity"), F.size(tx.semantic_terms(F.col("text"))).alias("terms"))


@query("""WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m WHERE h = sha256(documents.text))""")
def manifest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    manifest = items.where("doc_id % 3 = 0").withColumns({"status": F.lit("completed"), "version": F.lit("v2")})
    return relational.pending(items, manifest, ["doc_id", "content_hash"], ["v1", "v2"]).select("doc_id")


@query("SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN 'second ' || text WHEN doc_id % 2 = 0 THEN 'first ' || text ELSE text END) AS digest, CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 2 = 0 THEN 1 END AS overlay_version FROM documents")
def text_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _documents(spark, sf_dir)
    row = lambda test, text, version, active: base.where(test).select("doc_id", text.alias("text"), F.lit(version).alias("version"), F.lit(active).alias("active"))
    overlays = row("doc_id % 2 = 0", F.concat(F.lit("first "), "text"), 1, True).unionByName(row("doc_id % 4 = 0", F.concat(F.lit("second "), "text"), 2, True)).unionByName(row("doc_id % 8 = 0", F.lit(""), 3, False))
    return relational.active_overlay(base, overlays, "doc_id").select("doc_id", F.md5("text").alias("digest"), "overlay_version")


@query("""WITH p AS (SELECT lang, quality, CAST(NOT (contains(text, '!!') OR contains(text, '$$$') OR contains(text, ' | ')) AS INT) AS predicted FROM labels JOIN documents USING (doc_id)),
  g AS (SELECT lang, count_if(quality = 1 AND predicted = 1) AS tp, count_if(quality = 0 AND predicted = 1) AS fp, count_if(quality = 1 AND predicted = 0) AS fn FROM p GROUP BY lang),
  m AS (SELECT lang, tp, fp, fn, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM g)
  SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / greatest(1, sum(tp + fp)), 4) AS micro_precision, round(sum(tp) / greatest(1, sum(tp + fn)), 4) AS micro_recall, round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall FROM m""")
def micro_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.evaluation import micro_macro

    t = F.col("text")
    good = ~(F.contains(t, F.lit("!!")) | F.contains(t, F.lit("$$$")) | F.contains(t, F.lit(" | ")))
    df = read(spark, sf_dir, "labels", "doc_id", "quality").join(_documents(spark, sf_dir, "lang"), "doc_id")
    return micro_macro(df.select("lang", (F.col("quality") == 1).alias("gold"), good.alias("predicted")), "lang", "gold", "predicted")


@query()
def near_copy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as facts: those of one language, first word and number of words, each against all others; ratio 1.0 marks the copies of a linked sentence."""
    from tessera.operators.dedup import near_copy_links

    parted = F.transform(F.split("text", "[.!?]+[ \\n]+"), lambda s: F.struct(s.alias("sentence"), F.split(F.trim(s), "[ \\n]+").alias("words")))  # once for all that reads the words
    rows = _documents(spark, sf_dir, "lang").select("doc_id", "lang", F.posexplode(parted).alias("seq", "_s")).select("doc_id", "lang", "seq", "_s.sentence", F.lower(F.get("_s.words", F.lit(0))).alias("first"), F.size("_s.words").alias("words"))
    rows = rows.withColumn("fact", F.concat_ws(":", "doc_id", "seq")).where("words >= 5")
    return near_copy_links(rows, ["lang", "first", "words"], "doc_id", ["seq"], "fact", "sentence")


@query("SELECT lang, source, count(*) AS documents, min(doc_id) AS first_doc, any_value(len) AS longest FROM (SELECT *, max(length(text)) OVER (PARTITION BY lang, source) AS len FROM documents) GROUP BY lang, source")
def documents_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.max(F.length("text")).cast("long").alias("longest"))


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, line_no, trim(line) AS t FROM l WHERE length(trim(line)) > 2) SELECT t AS line, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_doc FROM t GROUP BY t HAVING count(DISTINCT doc_id) >= 3""")
def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts.lines(_documents(spark, sf_dir)).select("doc_id", F.trim("line").alias("line")).where(F.length("line") > 2).distinct()
    return rows.groupBy("line").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).where("documents >= 3")


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) SELECT source, doc_id, n_chars FROM o WHERE n <= 3")
def candidate_cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents", "source", "doc_id", "n_chars")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("_n <= 3").drop("_n")


# --- reports: lines of the documents with headings, labels and blanks of a report in between

_HEADINGS = {3: "## DATI ANAGRAFICI DEL PAZIENTE", 9: "## Referto clinico", 14: "", 20: "Nome e Cognome", 21: " Sesso ", 25: "## Richiedenti", 27: "DATI ANAGRAFICI", 30: "Medico", 33: "##  Prestazioni  erogate"}


def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "[.\\n]")).alias("line_no", "line"))
    at, said = (F.col("doc_id") + F.col("line_no") * 7) % 37, F.col("line")
    for k, line in _HEADINGS.items():
        said = F.when(at == k, line).otherwise(said)
    return rows.withColumn("line", said)


_MARKED = "CASE " + " ".join(f"WHEN (doc_id + p * 7) % 37 = {k} THEN '{v}'" for k, v in _HEADINGS.items()) + " ELSE s END"


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split_regex(text, '[.\\n]')) AS s, generate_subscripts(string_split_regex(text, '[.\\n]'), 1) - 1 AS p FROM documents),
  l AS (SELECT doc_id, p, {_MARKED} AS line FROM s), t AS (SELECT *, lower(trim(line, ' ' || chr(9) || chr(13) || chr(10))) AS t FROM l),
  k AS (SELECT doc_id, p, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^##\\s') AND regexp_matches(t, 'dati\\s+anagrafici|prestazioni\\s+erogate|richiedenti') THEN 'start' WHEN regexp_matches(t, '^##\\s') THEN 'heading'
    WHEN t IN ('nome e cognome', 'sesso', 'medico', 'ente', 'ospedale', 'indirizzo', 'telefono') THEN 'label' ELSE 'line' END AS kind FROM t),
  w AS (SELECT DISTINCT doc_id, -1 AS p, false AS skips, [{{'p': -1::BIGINT, 'blank': true}}] AS stack FROM k
    UNION ALL SELECT w.doc_id, k.p, CASE WHEN w.skips THEN k.kind NOT IN ('blank', 'heading', 'start') ELSE k.kind = 'start' END,
      CASE WHEN w.skips THEN CASE WHEN k.kind IN ('blank', 'heading', 'start') THEN list_append(w.stack, {{'p': k.p::BIGINT, 'blank': k.kind = 'blank'}}) ELSE w.stack END
        WHEN k.kind = 'start' THEN w.stack WHEN k.kind = 'label' THEN CASE WHEN w.stack[-1].blank THEN w.stack ELSE w.stack[:-2] END ELSE list_append(w.stack, {{'p': k.p::BIGINT, 'blank': k.kind = 'blank'}}) END
    FROM w JOIN k ON k.doc_id = w.doc_id AND k.p = w.p + 1)
  SELECT doc_id, CAST(e.p AS INT) AS line_no FROM (SELECT doc_id, unnest(arg_max(stack, p)) AS e FROM w GROUP BY doc_id) WHERE e.p >= 0""")
def boilerplate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.without_sections(_report_lines(spark, sf_dir), "doc_id").select("doc_id", "line_no")


@query()
def reports_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _report_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return cleaner.cleaned(lines.select("doc_id", F.array_join("lines.line", "\n").alias("text")), "doc_id")
