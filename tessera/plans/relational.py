"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import dates, numbers
from tessera.operators import relational
from tessera.plans.registry import query, read


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus NOT IN ('P')")
def filter_optional_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return relational.filtered(df, excluded={"o_orderstatus": ["P"]}, o_orderpriority="1-URGENT", o_custkey=None).drop("o_orderpriority")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders", "o_orderstatus").where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%#1%' OR p_type ILIKE 'promo%'")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return df.where(F.col("p_name").ilike("%RED%") | F.col("p_brand").ilike("%#1%") | F.col("p_type").ilike("promo%")).select("p_partkey", "p_name")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").distinct()


@query("""SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_name, coalesce(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '9999') AS order_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def join_three_way_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey)
    key = F.coalesce(F.col("o_orderdate").cast("date").cast("string"), F.lit("9999"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_name", key.alias("order_key"))


@query("SELECT a.n_name AS source, b.n_name AS target, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey")
def self_join_two_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("source"), F.col("n_regionkey").alias("r_regionkey"))
    b = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("target"), F.col("n_regionkey").alias("r_regionkey"))
    return a.join(b, "r_regionkey").where("ka < kb").join(read(spark, sf_dir, "region"), "r_regionkey").select("source", "target", "r_name")


@query("SELECT c_custkey, count(*) AS orders, count(DISTINCT o_orderstatus) AS statuses, count_if(o_orderstatus = 'F') AS finished, max(CAST(o_orderdate AS DATE)) AS latest FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def count_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderdate")
    joined = read(spark, sf_dir, "customer", "c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_custkey").agg(
        F.count("*").alias("orders"), F.count_distinct("o_orderstatus").alias("statuses"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.max(F.col("o_orderdate").cast("date")).alias("latest")
    )


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_no_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer", "c_custkey", "c_name").join(read(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_discount > 0.09)")
def guard_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_discount").where("l_returnflag = 'R' and l_discount > 0.09")
    return read(spark, sf_dir, "supplier", "s_suppkey").join(lines.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")


@query("""SELECT p_partkey, l_orderkey, l_linenumber, rank FROM (SELECT p_partkey, l_orderkey, l_linenumber,
    CASE WHEN l_quantity = p_size THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS rank,
    row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN l_quantity = p_size THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END, l_orderkey, l_linenumber) AS n
  FROM part JOIN lineitem ON p_partkey = l_partkey) WHERE n = 1""")
def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    joined = read(spark, sf_dir, "part", "p_partkey", "p_size").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    rank = F.when(F.col("l_quantity") == F.col("p_size"), 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return relational.first_by(joined.withColumn("rank", rank), ["p_partkey"], ["rank", "l_orderkey", "l_linenumber"]).select("p_partkey", "l_orderkey", "l_linenumber", "rank")


def _customer_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = read(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_mktsegment").withColumn("reviewed", F.col("c_custkey") % 5 == 0)
    segment = F.when(F.col("c_custkey") % 4 != 0, F.lower("c_mktsegment"))
    return df.where("c_custkey % 3 != 0"), df.where("c_custkey % 2 = 0").withColumns({"c_acctbal": -F.col("c_acctbal"), "c_mktsegment": segment})


_HALVES = """WITH c AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_custkey % 5 = 0 AS reviewed FROM customer), a AS (SELECT * FROM c WHERE c_custkey % 3 <> 0),
  b AS (SELECT c_custkey, -c_acctbal AS c_acctbal, CASE WHEN c_custkey % 4 <> 0 THEN lower(c_mktsegment) END AS c_mktsegment, reviewed FROM c WHERE c_custkey % 2 = 0) """


@query(_HALVES + """SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN a.c_acctbal WHEN a.c_custkey IS NULL THEN b.c_acctbal ELSE greatest(a.c_acctbal, b.c_acctbal) END AS c_acctbal,
  coalesce(b.c_mktsegment, a.c_mktsegment) AS c_mktsegment, coalesce(b.reviewed, a.reviewed) AS reviewed FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def upsert_keep_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _customer_halves(spark, sf_dir)
    return relational.upsert(old, new, ["c_custkey"], keep_if_null=["c_mktsegment"], greatest=["c_acctbal"])


@query(_HALVES + """SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL OR coalesce(a.reviewed, false) THEN a.c_acctbal ELSE b.c_acctbal END AS c_acctbal,
  CASE WHEN b.c_custkey IS NULL OR coalesce(a.reviewed, false) THEN a.c_mktsegment ELSE b.c_mktsegment END AS c_mktsegment,
  CASE WHEN b.c_custkey IS NULL OR coalesce(a.reviewed, false) THEN a.reviewed ELSE b.reviewed END AS reviewed FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _customer_halves(spark, sf_dir)
    return relational.upsert(old, new, ["c_custkey"], guard="reviewed")


@query(_HALVES + "SELECT * FROM a UNION ALL SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.insert_or_ignore(*_customer_halves(spark, sf_dir), ["c_custkey"])


@query(_HALVES + "SELECT * FROM a WHERE reviewed UNION ALL SELECT * FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a WHERE reviewed)")
def replace_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.replace_generated(*_customer_halves(spark, sf_dir), ["c_custkey"], F.col("reviewed"))


@query("""SELECT 'customer' AS record_type, c_custkey, c_name, c_acctbal, NULL AS s_suppkey, NULL AS s_name FROM customer
  UNION ALL SELECT 'supplier', NULL, NULL, NULL, s_suppkey, s_name FROM supplier""")
def tagged_union_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.tagged_union({"customer": read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal"), "supplier": read(spark, sf_dir, "supplier", "s_suppkey", "s_name")})


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return a.union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""WITH n AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 7)) AS cited, list_distinct(list(l_partkey % 5)) AS required FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, len(list_filter(required, lambda x: NOT list_contains(cited, x))) = 0 AS complete FROM n""")
def set_inclusion_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    sets = df.groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 7).alias("cited"), F.collect_set(F.col("l_partkey") % 5).alias("required"))
    return sets.select("l_orderkey", (F.size(F.array_except("required", "cited")) == 0).alias("complete"))


_PARTIAL = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders"
_BOUNDS = f"""p AS ({_PARTIAL}), b AS (SELECT *, CASE length(text) WHEN 4 THEN make_date(CAST(text AS INT), 1, 1) WHEN 7 THEN CAST(text || '-01' AS DATE) ELSE CAST(text AS DATE) END AS lo,
  CASE length(text) WHEN 4 THEN make_date(CAST(text AS INT), 12, 31) WHEN 7 THEN last_day(CAST(text || '-01' AS DATE)) ELSE CAST(text AS DATE) END AS hi FROM p)"""


def _partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", day.alias("day"), text.alias("text"))


@query(f"WITH {_BOUNDS} SELECT o_orderkey, lo, hi, CASE length(text) WHEN 4 THEN 'year' WHEN 7 THEN 'month' ELSE 'day' END AS precision FROM b")
def partial_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _partial_dates(spark, sf_dir).select("o_orderkey", dates.lower_bound(t).alias("lo"), dates.upper_bound(t).alias("hi"), dates.precision(t).alias("precision"))


@query(f"""WITH {_BOUNDS}, n AS (SELECT b.*, lag(lo) OVER w AS lo2, lag(hi) OVER w AS hi2 FROM b WINDOW w AS (ORDER BY o_orderkey))
  SELECT a.o_orderkey, CASE WHEN c.lo IS NULL THEN NULL ELSE greatest(0, c.lo - a.hi, a.lo - c.hi) END AS days FROM b a LEFT JOIN b c ON c.o_orderkey = a.o_orderkey + 1""")
def interval_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    df = _partial_dates(spark, sf_dir).select("o_orderkey", dates.lower_bound(t).alias("lo"), dates.upper_bound(t).alias("hi"))
    other = df.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    c = F.col
    return df.join(other, "o_orderkey", "left").select("o_orderkey", dates.distance(c("lo"), c("hi"), c("lo2"), c("hi2")).alias("days"))


@query(f"""WITH p AS ({_PARTIAL}) SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN day - CAST(o_orderkey % 9 AS INT) WHEN 1 THEN day - CAST(7 * (o_orderkey % 9) AS INT)
  WHEN 2 THEN day - to_months(CAST(o_orderkey % 9 AS INT)) ELSE day - to_years(CAST(o_orderkey % 9 AS INT)) END AS DATE) AS start FROM p""")
def subtract_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, ["day", "week", "month", "year"])), (F.col("o_orderkey") % 4).cast("int"))
    amount = (F.col("o_orderkey") % 9).cast("int")
    return _partial_dates(spark, sf_dir).select("o_orderkey", dates.subtract(F.col("day"), amount, unit).alias("start"))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS number FROM lineitem""")
def italian_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    text = F.translate(F.format_number(F.round("l_extendedprice", 2), 2), ",.", ".,")
    return df.select("l_orderkey", "l_linenumber", numbers.italian_number(text).alias("number"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS low, CASE p_partkey % 3 WHEN 2 THEN NULL WHEN 1 THEN p_size + 0.5 ELSE CAST(p_size + 10 AS DOUBLE) END AS high FROM part""")
def reference_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(size.cast("string"), F.lit(" - "), (size + 10).cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("< "), size.cast("string"), F.lit(",5"))).otherwise(F.concat(F.lit("> "), size.cast("string")))
    return read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", numbers.reference_range(text).alias("r")).select("p_partkey", "r.low", "r.high")


_ODD = "[" + ",".join(map(str, numbers.ODD_WEIGHTS + numbers.ODD_LETTERS)) + "]"


@query(f"""WITH c AS (SELECT c_custkey, 'ABCDEF' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || 'H' || lpad(CAST(c_custkey % 31 AS VARCHAR), 2, '0') || 'Z' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS code FROM customer),
  x AS (SELECT c_custkey, code, unnest(generate_series(1, 15)) AS i FROM c), v AS (SELECT c_custkey, code, i, CASE WHEN substr(code, i, 1) BETWEEN '0' AND '9' THEN ascii(substr(code, i, 1)) - 48 ELSE ascii(substr(code, i, 1)) - 55 END AS r FROM x)
  SELECT c_custkey, code, chr(CAST(sum(CASE WHEN i % 2 = 1 THEN {_ODD}[r + 1] WHEN r >= 10 THEN r - 10 ELSE r END) % 26 + 65 AS INT)) AS letter FROM v GROUP BY c_custkey, code""")
def checksum_mod26(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    code = F.concat(F.lit("ABCDEF"), pad(k % 100, 2), F.lit("H"), pad(k % 31, 2), F.lit("Z"), pad(k % 1000, 3))
    return read(spark, sf_dir, "customer", "c_custkey").select("c_custkey", code.alias("code")).withColumn("letter", numbers.check_letter(F.col("code")))


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_props_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events", "event_id", "user_id", "props")
    return df.select("event_id", "user_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).where("k is not null")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("_n <= 3").drop("_n")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def newest_with_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("SELECT 'C' || lpad(CAST(max(c_custkey) + 1 AS VARCHAR), 8, '0') AS next_id FROM customer")
def next_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer", "c_custkey").agg(F.concat(F.lit("C"), F.lpad((F.max("c_custkey") + 1).cast("string"), 8, "0")).alias("next_id"))


@query("""WITH e AS (SELECT DISTINCT a.l_orderkey AS source, b.l_orderkey AS target FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey)
  SELECT source, target, CASE WHEN s.o_custkey = t.o_custkey THEN 'same_process' WHEN s.o_orderstatus = t.o_orderstatus THEN 'associated_with' ELSE 'evaluates' END AS relation
  FROM e JOIN orders s ON s.o_orderkey = source JOIN orders t ON t.o_orderkey = target""")
def event_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    a, b = lines.withColumnRenamed("l_orderkey", "source"), lines.withColumnRenamed("l_orderkey", "target")
    pairs = a.join(b, ["l_partkey", "l_suppkey"]).where("source < target").select("source", "target").distinct()
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    side = lambda name: orders.select(F.col("o_orderkey").alias(name), F.col("o_custkey").alias(f"{name}_customer"), F.col("o_orderstatus").alias(f"{name}_status"))
    c = F.col
    relation = F.when(c("source_customer") == c("target_customer"), "same_process").when(c("source_status") == c("target_status"), "associated_with").otherwise("evaluates")
    return pairs.join(side("source"), "source").join(side("target"), "target").select("source", "target", relation.alias("relation"))


@query("""WITH t AS (SELECT o_custkey AS subject, o_orderstatus AS name, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderpriority FROM orders)
  SELECT subject, name, arg_min(day, (day, o_orderkey)) AS start_date, arg_max(o_orderpriority, (day, o_orderkey)) AS latest_dose,
    CASE WHEN arg_max(o_orderpriority, (day, o_orderkey)) LIKE '5%' THEN 'suspended' WHEN arg_max(o_orderpriority, (day, o_orderkey)) LIKE '4%' THEN 'completed' ELSE 'active' END AS lifecycle,
    CASE WHEN arg_max(o_orderpriority, (day, o_orderkey)) SIMILAR TO '[45].*' THEN max(day) END AS end_date, count(*) AS evidence FROM t GROUP BY subject, name""")
def medication_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey", "o_orderpriority")
    df = df.select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("name"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_orderpriority")
    at = F.struct("day", "o_orderkey")
    out = df.groupBy("subject", "name").agg(F.min("day").alias("start_date"), F.max_by("o_orderpriority", at).alias("latest_dose"), F.max("day").alias("_last"), F.count("*").alias("evidence"))
    d = F.col("latest_dose")
    life = F.when(d.startswith("5"), "suspended").when(d.startswith("4"), "completed").otherwise("active")
    return out.withColumn("lifecycle", life).withColumn("end_date", F.when(F.col("lifecycle") != "active", F.col("_last"))).drop("_last")
