"""Queries over the driver's tables: lookups, joins, grouped reports, sequences; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.dsl import boolean_column, filter_column
from sparkloom.functions.rounds import cut
from sparkloom.functions.scalars import heat, language
from sparkloom.operators import aggregates as A
from sparkloom.operators import relational as R
from sparkloom.operators import sequences as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"
DOC_FIELDS = {"lang": "lang", "language": "lang", "source": "source", "n_chars": "n_chars", "size": "n_chars", "doc_id": "doc_id", "id": "doc_id"}
RULES = [("size", "p_size", "le", 40, "deny"), ("price", "p_retailprice", "lt", 1000, "warn"), ("small", "p_size", "ge", 3, "info")]


def query(sql: str | None = None):
    """Register a query, with SQL if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def age_hours() -> F.Column:
    return (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, d):
    return R.lookup(t(spark, d, "customer"), "c_custkey", 42)


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def edge_scan(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()


@query("""
    WITH base AS (SELECT c_custkey, c_name, c_mktsegment, 0::BIGINT AS reads FROM customer WHERE c_custkey % 2 = 0),
         ch AS (SELECT c.c_custkey, CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderpriority END AS seg, o.o_orderkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
         agg AS (SELECT c_custkey, count(*) AS n, max_by(seg, o_orderkey) FILTER (WHERE seg IS NOT NULL) AS seg FROM ch GROUP BY c_custkey)
    SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, b.c_name, coalesce(a.seg, b.c_mktsegment) AS c_mktsegment, coalesce(b.reads, 0) + coalesce(a.n, 0) AS reads
    FROM base b FULL JOIN agg a ON a.c_custkey = b.c_custkey
""")
def upsert_counter(spark, d):
    base = t(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment", F.lit(0).cast("long").alias("reads"))
    changes = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey")), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("c_mktsegment"), "o_orderkey")
    return R.upsert(base, changes, "c_custkey", "reads", "o_orderkey")


@query("""
    WITH o AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
         n AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')
    SELECT * FROM o UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority)
""")
def insert_or_ignore(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    keys = ["o_custkey", "o_orderpriority"]
    return R.insert_or_ignore(o.where("o_orderstatus = 'F'").select(*keys), o.where("o_orderstatus = 'O'").select(*keys), keys)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <> 7 UNION ALL SELECT o_orderkey + 1000000000, 7 FROM orders WHERE o_custkey = 7")
def replace_relations(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return R.replace_group(o, "o_custkey", 7, o.where("o_custkey = 7").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_custkey"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def retention(spark, d):
    return R.retain(t(spark, d, "events"), "ts", now(), 7).select("event_id", "ts", "event_type")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def top_groups(spark, d):
    return R.top_groups(t(spark, d, "events"), "user_id", 20)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30")
def daily_error_rate(spark, d):
    return A.daily_rate(t(spark, d, "events"), "ts", F.col("event_type") == "error", 30).withColumn("rate", F.round("rate", 6))


@query("SELECT round(coalesce(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 1.0), 6) AS success_rate FROM events")
def success_rate(spark, d):
    return t(spark, d, "events").agg(F.round(A.rate(F.col("event_type") != "error"), 6).alias("success_rate"))


@query(f"""
    SELECT user_id, event_type, count(*) AS n, round(sum(exp(-ln(2) * ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000.0) / 72)), 6) AS weight
    FROM events WHERE event_type = 'error' GROUP BY user_id, event_type HAVING sum(exp(-ln(2) * ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000.0) / 72)) > 1.5
""")
def decayed_errors(spark, d):
    e = t(spark, d, "events").where("event_type = 'error'")
    return A.decayed(e, ["user_id", "event_type"], age_hours(), 72.0).where("weight > 1.5").withColumn("weight", F.round("weight", 6))


@query("""
    WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS w FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2),
         s AS (SELECT a AS item, b AS other, w AS weight FROM p UNION ALL SELECT b, a, w FROM p)
    SELECT item, other, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY weight DESC, other) AS rank FROM s) WHERE rank <= 3
""")
def coedit_neighbors(spark, d):
    pairs = R.pairs_in(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return R.top_within(R.neighbours(pairs, "a", "b"), "item", [F.desc("weight"), F.asc("other")], 3)


@query("""
    SELECT c.c_custkey, c_name, n_name, r_name, o.n_orders, round(o.total, 2) AS total, o.last_order
    FROM customer c LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total, max(o_orderdate) AS last_order FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
""")
def star_join(spark, d):
    orders = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last_order"))
    places = t(spark, d, "nation").join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    c = t(spark, d, "customer").join(places, "c_nationkey", "left").select("c_custkey", "c_name", "n_name", "r_name")
    return R.star(c, "c_custkey", [orders])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_audit(spark, d):
    return R.without(t(spark, d, "customer"), t(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)")
def orphans_not_exists(spark, d):
    return R.without(t(spark, d, "part"), t(spark, d, "lineitem").where("l_quantity > 49"), "p_partkey", "l_partkey").select("p_partkey")


@query("""
    SELECT o_orderkey, l_suppkey, o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_returnflag NOT IN ('A') AND (o_orderstatus = 'P' OR l_quantity > 48) ORDER BY o_totalprice DESC, o_orderkey, l_linenumber LIMIT 25
""")
def failing_candidates(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "lineitem").where("l_returnflag NOT IN ('A')"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.where("o_orderstatus = 'P' OR l_quantity > 48").orderBy(F.desc("o_totalprice"), "o_orderkey", "l_linenumber").limit(25).select("o_orderkey", "l_suppkey", "o_totalprice")


@query("SELECT DISTINCT l_suppkey AS supplier, o_custkey AS consumer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey")
def consumer_map(spark, d):
    j = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.where("l_suppkey != o_custkey").select(F.col("l_suppkey").alias("supplier"), F.col("o_custkey").alias("consumer")).distinct()


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def theta_contains(spark, d):
    docs, items = t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    found = R.contains_any(docs, "doc_id", "text", items, "item")
    return found.join(items.withColumnRenamed("item", "pattern"), "pattern").select("doc_id", "item_id")


@query("SELECT d.doc_id, w.word FROM documents d JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT DISTINCT p_type FROM part) w ON contains(lower(d.text), lower(w.word))")
def theta_words(spark, d):
    p = t(spark, d, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(p.select(F.col("p_type").alias("word")))
    return R.contains_any(t(spark, d, "documents"), "doc_id", "text", words, "word", ignore_case=True).withColumnRenamed("pattern", "word")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 100 AND source LIKE '%src1%' ORDER BY doc_id LIMIT 50")
def dsl_filter(spark, d):
    return t(spark, d, "documents").where(filter_column("lang = en AND size > 100 AND source LIKE 'src1'", DOC_FIELDS)).orderBy("doc_id").limit(50).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id FROM documents WHERE (lower(lang) = 'fr' OR lower(lang) = 'de') AND NOT lower(source) = 'src3' AND (contains(lower(lang), 'e') OR contains(lower(source), 'e') OR contains(lower(CAST(n_chars AS VARCHAR)), 'e') OR contains(lower(CAST(doc_id AS VARCHAR)), 'e'))")
def bool_dsl(spark, d):
    return t(spark, d, "documents").where(boolean_column("(lang:fr OR lang:de) NOT source:src3 e", DOC_FIELDS)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%RC7%' ORDER BY doc_id LIMIT 100")
def like_search(spark, d):
    return t(spark, d, "documents").where(F.col("text").ilike("%license%") | F.col("source").ilike("%RC7%")).orderBy("doc_id").limit(100).select("doc_id")


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS path, 'p_size' AS metric, CAST(p_size AS DOUBLE) AS value, 'size' AS rule, 'deny' AS severity, CAST(40.0 AS DOUBLE) AS threshold FROM part WHERE NOT p_size <= 40
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_retailprice', p_retailprice, 'price', 'warn', CAST(1000.0 AS DOUBLE) FROM part WHERE NOT p_retailprice < 1000
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_size', CAST(p_size AS DOUBLE), 'small', 'info', CAST(3.0 AS DOUBLE) FROM part WHERE NOT p_size >= 3
""")
def rule_violations(spark, d):
    m = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr("stack(2, 'p_size', cast(p_size as double), 'p_retailprice', p_retailprice) as (metric, value)"))
    return R.violations(m, RULES)


@query("""
    WITH v AS (SELECT 'deny' AS severity, count(*) AS n FROM part WHERE NOT p_size <= 40 UNION ALL SELECT 'warn', count(*) FROM part WHERE NOT p_retailprice < 1000 UNION ALL SELECT 'info', count(*) FROM part WHERE NOT p_size >= 3)
    SELECT coalesce(sum(n) FILTER (WHERE severity = 'deny'), 0)::BIGINT AS deny, coalesce(sum(n) FILTER (WHERE severity = 'warn'), 0)::BIGINT AS warn, coalesce(sum(n) FILTER (WHERE severity = 'info'), 0)::BIGINT AS info FROM v
""")
def severity_counts(spark, d):
    return rule_violations(spark, d).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("deny", "warn", "info")))


@query("""
    WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type = 'error' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'error' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.n AS before, b.n AS after
    FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n
""")
def violation_diff(spark, d):
    e = t(spark, d, "events").where("event_type = 'error'")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    count = lambda x: x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return R.diff(count(e.where(F.col("ts") < half)), count(e.where(F.col("ts") >= half)), "user_id", "n")


@query("""
    WITH e AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 86400000000.0 AS age FROM events),
         churn AS (SELECT count(*) AS users, count(*) FILTER (WHERE n > 1) AS busy FROM (SELECT user_id, count(*) AS n FROM e WHERE age <= 7 AND event_type = 'purchase' GROUP BY 1))
    SELECT n1, n7, velocity, success, churn, CASE WHEN n1 > 1.5 * velocity THEN 'rising' WHEN n1 < 0.5 * velocity THEN 'falling' ELSE 'stable' END AS trend, round(0.85 * success + 0.15 * least(velocity, 5) / 5, 6) AS score FROM (
    SELECT count(*) FILTER (WHERE age <= 1) AS n1, count(*) FILTER (WHERE age <= 7) AS n7, round(count(*) FILTER (WHERE age <= 7) / 7.0, 6) AS velocity,
           round(coalesce(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) FILTER (WHERE age <= 7), 1.0), 6) AS success, (SELECT round(CASE WHEN users = 0 THEN 0 ELSE busy / users END, 6) FROM churn) AS churn FROM e)
""")
def trend_report(spark, d):
    e = t(spark, d, "events").withColumn("age", age_hours() / 24)
    week = e.where("age <= 7")
    users = week.where("event_type = 'purchase'").groupBy("user_id").count().agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("count") > 1).alias("busy"))
    one = e.agg(F.count_if(F.col("age") <= 1).alias("n1"), F.count_if(F.col("age") <= 7).alias("n7"), F.round(F.coalesce(F.avg(F.when(F.col("age") <= 7, (F.col("event_type") != "error").cast("double"))), F.lit(1.0)), 6).alias("success"))
    j = one.withColumn("k", F.lit(1)).join(users.withColumn("k", F.lit(1)), "k").withColumn("velocity", F.round(F.col("n7") / 7.0, 6))
    trend = F.when(F.col("n1") > 1.5 * F.col("velocity"), "rising").when(F.col("n1") < 0.5 * F.col("velocity"), "falling").otherwise("stable")
    return j.select("n1", "n7", "velocity", "success", F.round(F.when(F.col("users") == 0, 0.0).otherwise(F.col("busy") / F.col("users")), 6).alias("churn"), trend.alias("trend"), F.round(0.85 * F.col("success") + 0.15 * F.least(F.col("velocity"), F.lit(5.0)) / 5, 6).alias("score"))


@query("""
    WITH r AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1)
    SELECT round(regr_slope(rate, x), 6) AS slope, CASE WHEN regr_slope(rate, x) > 0.01 THEN 'up' WHEN regr_slope(rate, x) < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM (SELECT rate, date_diff('day', DATE '2024-01-01', day) AS x FROM r)
""")
def trend_slope(spark, d):
    r = A.daily_rate(t(spark, d, "events"), "ts", F.col("event_type") == "error", 10_000).withColumn("x", F.datediff("day", F.lit("2024-01-01")))
    s = A.slope("x", "rate")
    return r.agg(F.round(s, 6).alias("slope"), F.when(s > 0.01, "up").when(s < -0.01, "down").otherwise("flat").alias("trend"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def churn_having(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1, 2)
    SELECT user_id, sum(n)::BIGINT AS n, min(lo) AS first_seq, max(hi) AS last_seq, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS actions FROM c GROUP BY 1
""")
def entity_projection(spark, d):
    p = A.projection(t(spark, d, "events"), "user_id", "event_type", "event_id")
    return p.withColumn("actions", F.array_join(F.transform(F.map_entries("actions"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    p = A.latencies(t(spark, d, "events"), "event_type", "value")
    return p.select("event_type", "n", F.round("total", 2).alias("total"), *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p99", "p999")))


@query("""
    WITH x AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, round(CASE WHEN max(n) <= 1 OR sum(v) <= 0 THEN 0 ELSE sum((2 * i - n - 1) * v) / (max(n) * sum(v)) END, 6) AS gini FROM x GROUP BY 1
""")
def gini(spark, d):
    return A.gini(t(spark, d, "part"), "p_brand", "p_retailprice").withColumn("gini", F.round("gini", 6))


@query("SELECT c_custkey, round(pow(greatest(c_acctbal / 10000, 0.01) * greatest((c_nationkey + 1) / 25.0, 0.01) * greatest(length(c_mktsegment) / 10.0, 0.01), 1 / 3.0), 6) AS score FROM customer")
def geo_mean(spark, d):
    parts = (F.col("c_acctbal") / 10000, (F.col("c_nationkey") + 1) / 25.0, F.length("c_mktsegment") / 10.0)
    return t(spark, d, "customer").select("c_custkey", F.round(A.geometric_mean(*parts), 6).alias("score"))


@query("""
    WITH e AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev1 FROM events), c AS (SELECT prev1, event_type, count(*) AS n FROM e WHERE prev1 IS NOT NULL GROUP BY 1, 2)
    SELECT prev1, event_type, n, round(n / sum(n) OVER (PARTITION BY prev1), 6) AS p FROM c
""")
def markov1(spark, d):
    return S.transitions(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").withColumn("p", F.round("p", 6))


@query("""
    WITH e AS (SELECT event_type, lag(event_type) OVER w AS prev1, lag(event_type, 2) OVER w AS prev2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT prev2, prev1, event_type, count(*) AS n FROM e WHERE prev2 IS NOT NULL GROUP BY 1, 2, 3)
    SELECT prev2, prev1, event_type, n, round(n / sum(n) OVER (PARTITION BY prev2, prev1), 6) AS p FROM c
""")
def markov2(spark, d):
    return S.transitions(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 2).withColumn("p", F.round("p", 6))


@query("""
    WITH e AS (SELECT event_type, lag(event_type) OVER w AS p1, lag(event_type, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         u AS (SELECT p1, event_type, count(*) / sum(count(*)) OVER (PARTITION BY p1) AS p FROM e WHERE p1 IS NOT NULL GROUP BY 1, 2),
         b AS (SELECT p2, p1, event_type, count(*) / sum(count(*)) OVER (PARTITION BY p2, p1) AS p FROM e WHERE p2 IS NOT NULL GROUP BY 1, 2, 3),
         s AS (SELECT b.p2 AS prev2, b.p1 AS prev1, u.event_type, 0.4 * u.p + 0.6 * coalesce(x.p, 0) AS score FROM (SELECT DISTINCT p2, p1 FROM b) b JOIN u ON u.p1 = b.p1 LEFT JOIN b x ON x.p2 = b.p2 AND x.p1 = b.p1 AND x.event_type = u.event_type)
    SELECT prev2, prev1, event_type, score, rank FROM (SELECT prev2, prev1, event_type, round(score, 6) AS score, row_number() OVER (PARTITION BY prev2, prev1 ORDER BY round(score, 9) DESC, event_type) AS rank FROM s) WHERE rank <= 3
""")
def next_topk(spark, d):
    e = t(spark, d, "events")
    one = S.transitions(e, "user_id", ["ts", "event_id"], "event_type").select("prev1", "event_type", F.col("p").alias("p1"))
    two = cut(S.transitions(e, "user_id", ["ts", "event_id"], "event_type", 2)).select("prev2", "prev1", "event_type", F.col("p").alias("p2"))
    j = two.select("prev2", "prev1").distinct().join(one, "prev1").join(two, ["prev2", "prev1", "event_type"], "left")
    s = j.withColumn("score", F.round(0.4 * F.col("p1") + 0.6 * F.coalesce("p2", F.lit(0.0)), 9)).withColumn("state", F.struct("prev2", "prev1"))
    return R.top_within(s, "state", [F.desc("score"), F.asc("event_type")], 3).select("prev2", "prev1", "event_type", F.round("score", 6).alias("score"), "rank")


@query("SELECT event_id, user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rate FROM events")
def rolling_rate(spark, d):
    return S.rolling_rate(t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 20).select("event_id", "user_id", F.round("rate", 6).alias("rate"))


@query("""
    WITH a AS (SELECT *, avg(value) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(value - mean - 0.5) OVER w AS cum FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, round(cum, 4) AS cum, cum - least(min(cum) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) > 100 AS alarm FROM b
""")
def page_hinkley(spark, d):
    return S.page_hinkley(t(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.5, 100.0).select("event_id", "user_id", F.round("cum", 4).alias("cum"), "alarm")


@query("""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events), b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM a WHERE i <= 40)
    SELECT user_id, max(n) AS n, round(avg(value) FILTER (WHERE i <= n - n // 2) - avg(value) FILTER (WHERE i > n - n // 2), 6) AS difference, round(1 - 1 / sqrt(max(n)), 6) AS confidence,
           abs(avg(value) FILTER (WHERE i <= n - n // 2) - avg(value) FILTER (WHERE i > n - n // 2)) >= 5 AS drift FROM b WHERE n >= 10 GROUP BY 1
""")
def half_window_drift(spark, d):
    h = S.half_drift(t(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 40, 5.0)
    return h.select("user_id", "n", F.round("difference", 6).alias("difference"), F.round("confidence", 6).alias("confidence"), "drift")


@query()
def cusum(spark, d):
    step, start, columns = S.cusum_step("value")
    return S.fold(t(spark, d, "events").select("event_id", "ts", "user_id", "value"), "user_id", ["ts", "event_id"], step, start, columns).select("event_id", "user_id", F.round("up", 6).alias("up"), F.round("down", 6).alias("down"), "alarm")


@query()
def ema_value(spark, d):
    e = t(spark, d, "events").select("event_id", "ts", "user_id", (F.col("event_type") != "error").cast("double").alias("ok"))
    step, start, columns = S.ema_step("ok")
    return S.fold(e, "user_id", ["ts", "event_id"], step, start, columns).select("event_id", "user_id", F.round("q", 9).alias("q"))


@query("""
    WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
    SELECT user_id, run::BIGINT AS run, first(event_type) AS value, count(*) AS n FROM b GROUP BY user_id, run
""")
def run_lengths(spark, d):
    return S.run_lengths(t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT user_id, position, event_type AS value FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events)")
def run_lengths_decoded(spark, d):
    return S.expand_runs(run_lengths(spark, d), "user_id")


@query("""
    WITH e AS (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev1 FROM conversations), c AS (SELECT prev1, role, count(*) AS n FROM e WHERE prev1 IS NOT NULL GROUP BY 1, 2)
    SELECT prev1, role, n, round(n / sum(n) OVER (PARTITION BY prev1), 6) AS p FROM c
""")
def conversation_transitions(spark, d):
    return S.transitions(t(spark, d, "conversations"), "conv_id", ["turn"], "role").withColumn("p", F.round("p", 6))


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 5")
def latest_per_key(spark, d):
    return R.top_within(t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id", "ts")


@query("""
    WITH n AS (SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS now, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-30' AND ts >= TIMESTAMP '2024-01-29') AS before FROM events GROUP BY 1)
    SELECT event_type, now, before, CASE WHEN before = 0 THEN now > 0 ELSE abs(now - before) / before > 0.5 END AS drift FROM n
""")
def day_over_day(spark, d):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    n = t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("ts") >= day("2024-01-30")).alias("now"), F.count_if((F.col("ts") < day("2024-01-30")) & (F.col("ts") >= day("2024-01-29"))).alias("before"))
    return n.withColumn("drift", F.when(F.col("before") == 0, F.col("now") > 0).otherwise(F.abs(F.col("now") - F.col("before")) / F.col("before") > 0.5))


@query("SELECT count(*) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitems FROM customer")
def table_counts(spark, d):
    one = lambda name, out: t(spark, d, name).agg(F.count(F.lit(1)).alias(out)).withColumn("k", F.lit(1))
    return one("customer", "customers").join(one("orders", "orders"), "k").join(one("lineitem", "lineitems"), "k").drop("k")


@query("""
    SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
           count(*) FILTER (WHERE o_totalprice > 300000) AS large, count(DISTINCT o_custkey) AS customers FROM orders
""")
def conditional_sums(spark, d):
    return t(spark, d, "orders").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_totalprice") > 300000).alias("large"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS consumers FROM lineitem GROUP BY 1, 2 ORDER BY consumers DESC, 1, 2 LIMIT 30")
def fan_in(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("consumers")).orderBy(F.desc("consumers"), "l_partkey", "l_suppkey").limit(30)


LANGUAGE_SQL = "CASE WHEN e = 'rs' THEN 'rust' WHEN e IN ('py', 'pyi', 'pyw') THEN 'python' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN e = 'go' THEN 'go' WHEN e IN ('c', 'h') THEN 'c' WHEN e IN ('cpp', 'cc', 'cxx', 'hpp') THEN 'cpp' WHEN e = 'java' THEN 'java' WHEN e = 'rb' THEN 'ruby' WHEN e IN ('sh', 'bash', 'zsh') THEN 'shell' WHEN e = 'sql' THEN 'sql' WHEN e IN ('md', 'markdown') THEN 'markdown' WHEN e = 'toml' THEN 'toml' WHEN e IN ('yaml', 'yml') THEN 'yaml' WHEN e = 'json' THEN 'json' WHEN e = 'html' THEN 'html' WHEN e = 'css' THEN 'css' END"
EXTENSIONS = "rs py pyi pyw ts tsx js jsx mjs cjs go c h cpp cc cxx hpp java rb sh bash zsh sql md markdown toml yaml yml json html css exe PY".split()


@query(f"SELECT p_partkey, {LANGUAGE_SQL} AS language FROM (SELECT p_partkey, [{', '.join(repr(x) for x in EXTENSIONS)}][(p_partkey % {len(EXTENSIONS)})::INT + 1] AS e FROM part)")
def detect_language(spark, d):
    extension = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("p_partkey") % len(EXTENSIONS)).cast("int"))
    return t(spark, d, "part").select("p_partkey", language(F.concat(F.lit("src/v1.2/"), F.col("p_name"), F.lit("."), extension)).alias("language"))


@query(f"""
    WITH u AS (SELECT user_id, count(*) AS edits, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 3600000000.0 AS age, count(*) FILTER (WHERE event_type = 'error') AS blast FROM events GROUP BY 1)
    SELECT user_id, round(edits * pow(0.5, age / 24) * (1 + blast), 4) AS heat FROM u
""")
def heat_score(spark, d):
    u = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("edits"), F.max("ts").alias("ts"), F.count_if(F.col("event_type") == "error").alias("blast"))
    return u.select("user_id", F.round(heat(F.col("edits"), age_hours(), 24.0, F.col("blast")), 4).alias("heat"))
