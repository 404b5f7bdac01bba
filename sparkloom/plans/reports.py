"""Queries of notes, rule quality, wiring and health reports, fused signals, fusion variants, vector arithmetic and collections; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.code import semantic_weight
from sparkloom.functions.rounds import cut
from sparkloom.operators import graphs as G
from sparkloom.operators import reports as P
from sparkloom.operators import sequences as S
from sparkloom.operators import stats as ST
from sparkloom.operators import text as X
from sparkloom.operators import vectors as V
from sparkloom.plans.search import EDGES_SQL, QUERY, bm25_sql, supply_edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"


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


#: Rules: parts, hit by their order lines and preventing where a line came back.
RULES_SQL = "rules AS (SELECT p_partkey AS id, p_name AS pattern, p_size % 5 AS severity, count(l_orderkey) AS hits, count(*) FILTER (WHERE l_returnflag = 'R') AS prevented FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3)"


def rules(spark: SparkSession, d: str) -> DataFrame:
    hits = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("l_returnflag") == "R").alias("prevented"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("pattern"), (F.col("p_size") % 5).alias("severity"))
    return p.join(hits, "id", "left").fillna(0, ["hits", "prevented"])


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name || chr(10) || p_type END AS notes FROM part")
def notes_appended(spark, d):
    return t(spark, d, "part").select("p_partkey", P.appended(F.when(F.col("p_size") % 3 != 0, F.col("p_name")), F.col("p_type")).alias("notes"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_name || '; ' ELSE p_name || '; ' || p_type || '; ' END || 'quality:' || p_size AS notes FROM part")
def notes_retagged(spark, d):
    old = F.when(F.col("p_size") % 3 == 0, F.lit(None)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("quality:low; "), "p_name")).otherwise(F.concat("p_name", F.lit("; quality:high; "), "p_type"))
    return t(spark, d, "part").select("p_partkey", P.retagged(old, "quality:", F.concat(F.lit("quality:"), F.col("p_size").cast("string"))).alias("notes"))


@query(f"WITH {RULES_SQL} SELECT * FROM rules ORDER BY id")
def rule_list(spark, d):
    return rules(spark, d).orderBy("id")


@query(f"WITH {RULES_SQL} SELECT id, round(prevented / greatest(hits, 1), 9) AS f1 FROM rules")
def rule_f1(spark, d):
    return rules(spark, d).select("id", F.round(P.rule_score(F.col("prevented"), F.col("hits")), 9).alias("f1"))


@query(f"WITH {RULES_SQL} SELECT id FROM rules WHERE NOT (hits >= 25 AND prevented / greatest(hits, 1) < 0.3)")
def rules_kept(spark, d):
    return P.archived(rules(spark, d), "prevented", "hits", 25, 0.3).select("id")


@query(f"WITH {RULES_SQL} SELECT count(*) AS n, coalesce(sum(hits), 0)::BIGINT AS hits, coalesce(sum(prevented), 0)::BIGINT AS prevented FROM rules")
def rule_totals(spark, d):
    return rules(spark, d).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("prevented"), F.lit(0)).alias("prevented"))


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderkey")
def unresolved(spark, d):
    return t(spark, d, "orders").where("o_orderstatus = 'P'").orderBy("o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_linestatus = 'O' AND l_partkey = 7 ORDER BY l_discount DESC, l_orderkey, l_linenumber")
def pending_suggestions(spark, d):
    li = t(spark, d, "lineitem").where("l_linestatus = 'O' AND l_partkey = 7")
    return li.orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


PATHS_SQL = "p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'tmp/' || p_name WHEN 1 THEN p_name || '_bak' WHEN 2 THEN p_name || '.bak' WHEN 3 THEN 'src/' || p_name || '_old.rs' WHEN 4 THEN p_name || 'xbak' ELSE 'a_backup/' || p_name END AS path FROM part)"


@query(f"WITH {PATHS_SQL} SELECT p_partkey, path FROM p WHERE contains(path, 'tmp/') OR contains(path, '_bak') OR contains(path, '.bak') OR contains(path, '_old') OR contains(path, '_backup')")
def churn_paths(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    path = F.when(k == 0, F.concat(F.lit("tmp/"), n)).when(k == 1, F.concat(n, F.lit("_bak"))).when(k == 2, F.concat(n, F.lit(".bak"))).when(k == 3, F.concat(F.lit("src/"), n, F.lit("_old.rs"))).when(k == 4, F.concat(n, F.lit("xbak"))).otherwise(F.concat(F.lit("a_backup/"), n))
    return t(spark, d, "part").select("p_partkey", path.alias("path")).where(P.churned(F.col("path")))


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' ORDER BY c_custkey, o_orderkey")
def workflow_resume(spark, d):
    o = t(spark, d, "orders").where("o_orderstatus != 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")
    return t(spark, d, "customer").select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").orderBy("c_custkey", "o_orderkey").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("""
    SELECT s_suppkey, c_custkey, CASE WHEN s_acctbal = c_acctbal THEN 1.0 WHEN c_name LIKE '%1%' THEN 0.8 ELSE 0.5 END::DOUBLE AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 7 = c_custkey % 7
    ORDER BY score DESC, s_suppkey, c_custkey LIMIT 50
""")
def entity_resolve(spark, d):
    s = t(spark, d, "supplier").withColumn("k", F.col("s_suppkey") % 7)
    c = t(spark, d, "customer").withColumn("k", F.col("c_custkey") % 7)
    j = s.join(c, (s["s_nationkey"] == c["c_nationkey"]) & (s["k"] == c["k"]))
    score = F.when(F.col("s_acctbal") == F.col("c_acctbal"), 1.0).when(F.col("c_name").like("%1%"), 0.8).otherwise(0.5)
    return j.select("s_suppkey", "c_custkey", score.alias("score")).orderBy(F.desc("score"), "s_suppkey", "c_custkey").limit(50)


@query("""
    WITH b AS (SELECT user_id, ts, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS c FROM events WHERE event_type IN ('view', 'purchase')), n AS (SELECT *, lead(c) OVER w AS nc, lead(ts) OVER w AS nt FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, c DESC))
    SELECT user_id, ts, CASE WHEN nc = 0 THEN nt END AS taken_at FROM n WHERE c = 1
""")
def choice_outcomes(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_type")
    return P.taken(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts")


CHAIN_SQL = "c AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'Broken' ELSE l_returnflag END AS kind, l_discount * 10 AS confidence FROM lineitem)"


def chain_rows(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "Broken").otherwise(F.col("l_returnflag")).alias("kind"), (F.col("l_discount") * 10).alias("confidence"))


@query(f"WITH {CHAIN_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE confidence < 0.3 OR kind = 'Broken') AS broken, round(coalesce(avg(confidence), 0), 6) AS confidence FROM c")
def chain_report(spark, d):
    return P.chains(chain_rows(spark, d), "kind", "confidence").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {CHAIN_SQL} SELECT kind, count(*) AS n FROM c GROUP BY 1")
def chain_kinds(spark, d):
    return chain_rows(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH {CHAIN_SQL}, s AS (SELECT count(*) AS symbols, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)) AS orphans FROM part),
         x AS (SELECT count(*) AS total, count(*) FILTER (WHERE confidence < 0.3 OR kind = 'Broken') AS broken, avg(confidence) AS confidence FROM c), m AS (SELECT avg(s_acctbal / 10000) AS integration, count(*) FILTER (WHERE s_acctbal / 10000 < 0.5) AS below FROM supplier)
    SELECT symbols, orphans, round(orphans / symbols, 9) AS orphan_rate, total, broken, round(integration, 9) AS integration, below,
           round(greatest(0, least(1, 0.4 * (1 - orphans / symbols) + 0.3 * (1 - broken / total) * greatest(0.1, least(1, confidence)) + 0.3 * greatest(0, least(1, integration)))), 9) AS score FROM s, x, m
""")
def wiring_report(spark, d):
    used = t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("used", F.lit(True))
    symbols = t(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left")
    modules = t(spark, d, "supplier").select((F.col("s_acctbal") / 10000).alias("integration"))
    r = P.wiring(symbols, F.col("used").isNull(), P.chains(chain_rows(spark, d), "kind", "confidence"), modules, "integration")
    return r.select(*(F.round(c, 9).alias(c) if c in ("orphan_rate", "integration", "score") else c for c in r.columns))


@query("""
    WITH x AS (SELECT p_brand, avg(p_retailprice) / 2000 AS score, sum(p_size)::DOUBLE AS weight, count(*) AS points FROM part GROUP BY 1), m AS (SELECT sum(score * weight) / sum(weight) AS p, greatest(1, sum(points))::DOUBLE AS n FROM x)
    SELECT round(p, 9) AS score, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 9) AS lower, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 9) AS upper,
           CASE WHEN p >= 0.8 THEN 'healthy' WHEN p >= 0.4 THEN 'degraded' ELSE 'critical' END AS status FROM m
""")
def health_report(spark, d):
    x = t(spark, d, "part").groupBy("p_brand").agg((F.avg("p_retailprice") / 2000).alias("score"), F.sum("p_size").cast("double").alias("weight"), F.count(F.lit(1)).alias("points"))
    return P.health(x, "score", "weight", "points").select(*(F.round(c, 9).alias(c) for c in ("score", "lower", "upper")), "status")


@query("""
    WITH w AS (SELECT count(*) AS tools, coalesce(avg(s), 0) AS tool_score FROM (SELECT avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS s FROM events GROUP BY user_id)), q AS (SELECT count(*) AS entries FROM nation), a AS (SELECT count(*) AS arms, coalesce(sum(n), 0)::BIGINT AS pulls FROM (SELECT count(*) AS n FROM events GROUP BY event_type))
    SELECT tools, round(tool_score, 9) AS tool_score, entries, arms, pulls, round(CASE WHEN tools > 0 OR entries > 0 THEN least(1, 0.4 * least(1, entries / 100) + 0.3 * tool_score + CASE WHEN arms > 0 THEN 0.2 ELSE 0 END + 0.1) ELSE 0.5 END, 9) AS score FROM w, q, a
""")
def learning_report(spark, d):
    e = t(spark, d, "events")
    tools = e.groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("s"))
    r = P.learning(tools, "s", t(spark, d, "nation"), e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "n")
    return r.select("tools", F.round("tool_score", 9).alias("tool_score"), "entries", "arms", "pulls", F.round("score", 9).alias("score"))


HALVES_SQL = "h AS (SELECT user_id, max(n) AS n, avg(value) FILTER (WHERE i <= n // 2) AS older, avg(value) FILTER (WHERE i > n // 2) AS recent FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1)"


@query(f"WITH {HALVES_SQL} SELECT user_id, n, round(older, 6) AS older, round(recent, 6) AS recent, CASE WHEN recent - older > 0.05 THEN 1 WHEN recent - older < -0.05 THEN -1 ELSE 0 END AS trend FROM h")
def reward_trend(spark, d):
    h = P.half_means(t(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return h.select("user_id", "n", F.round("older", 6).alias("older"), F.round("recent", 6).alias("recent"), P.direction(F.col("older"), F.col("recent"), 0.05).alias("trend"))


@query(f"WITH {HALVES_SQL} SELECT user_id, CASE WHEN trunc(recent) - trunc(older) > 10 THEN 1 WHEN trunc(recent) - trunc(older) < -10 THEN -1 ELSE 0 END AS trend FROM h")
def ema_trend(spark, d):
    h = P.half_means(t(spark, d, "events"), "user_id", ["ts", "event_id"], "value", whole=True)
    return h.select("user_id", P.direction(F.col("older"), F.col("recent"), 10).alias("trend"))


@query("SELECT event_type, round(avg(abs(value - 50)), 6) AS mean FROM events GROUP BY 1")
def mean_error(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.abs(F.col("value") - 50)), 6).alias("mean"))


@query(f"SELECT event_id, user_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) // 60000000 AS minutes FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '{NOW}' - INTERVAL 3 DAYS ORDER BY ts, event_id LIMIT 20")
def stuck_candidates(spark, d):
    old = t(spark, d, "events").where("event_type = 'error'").where(F.col("ts") < F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS"))
    minutes = F.floor((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60000000)
    return old.orderBy("ts", "event_id").limit(20).select("event_id", "user_id", minutes.cast("long").alias("minutes"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS open, count(*) FILTER (WHERE l_tax = 0) AS untaxed, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) FILTER (WHERE l_quantity < 2) AS single FROM lineitem")
def wiring_diagnostic(spark, d):
    tests = {"a": "l_returnflag = 'A'", "open": "l_returnflag = 'N' AND l_linestatus = 'O'", "untaxed": "l_tax = 0", "discounted": "l_discount > 0.05", "single": "l_quantity < 2"}
    return t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.expr(x)).alias(k) for k, x in tests.items()))


@query("SELECT p_brand, round(CASE WHEN count(*) > 0 THEN least(count(*) FILTER (WHERE p_size < 5) + count(*) - count(DISTINCT p_name), count(*)) / count(*) ELSE 0 END, 9) AS ratio FROM part GROUP BY 1")
def redundancy(spark, d):
    n = F.count(F.lit(1))
    return t(spark, d, "part").groupBy("p_brand").agg(F.round(P.redundancy(F.count_if(F.col("p_size") < 5), n - F.countDistinct("p_name"), n), 9).alias("ratio"))


@query("""
    WITH s AS (SELECT p_partkey, p_size / 50.0 AS modularity, least(p_retailprice / 2000, 1) AS acyclicity, (p_partkey % 11) / 10.0 AS depth, (p_partkey % 5) / 4.0 AS equality FROM part), m AS (SELECT *, least(modularity, acyclicity, depth, equality) AS lo FROM s)
    SELECT p_partkey, CASE WHEN (abs(modularity - lo) < 1e-6)::INT + (abs(acyclicity - lo) < 1e-6)::INT + (abs(depth - lo) < 1e-6)::INT + (abs(equality - lo) < 1e-6)::INT > 1 THEN 'tied' WHEN modularity = lo THEN 'modularity' WHEN acyclicity = lo THEN 'acyclicity' WHEN depth = lo THEN 'depth' ELSE 'equality' END AS cause FROM m
""")
def bottleneck(spark, d):
    parts = {"modularity": F.col("p_size") / 50.0, "acyclicity": F.least(F.col("p_retailprice") / 2000, F.lit(1.0)), "depth": (F.col("p_partkey") % 11) / 10.0, "equality": (F.col("p_partkey") % 5) / 4.0}
    return t(spark, d, "part").select("p_partkey", P.bottleneck(parts).alias("cause"))


@query(f"SELECT count(*) FILTER (WHERE event_type = 'purchase') AS edits, count(*) FILTER (WHERE event_type = 'click') AS commands, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 5 HOURS")
def session_assess(spark, d):
    e = t(spark, d, "events").where(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 5 HOURS"))
    return e.agg(*(F.count_if(F.col("event_type") == k).alias(c) for c, k in (("edits", "purchase"), ("commands", "click"), ("errors", "error"))), F.countDistinct("user_id").alias("users"))


@query("SELECT p_brand, arg_max(p_type, (rate, -rk)) AS strategy FROM (SELECT p_brand, p_type, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS rate, dense_rank() OVER (ORDER BY p_type) AS rk FROM part GROUP BY 1, 2) GROUP BY 1")
def strategy_pick(spark, d):
    """The strategy of the best rate, ties to the first by name."""
    r = t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg((F.col("p_size") > 25).cast("double")).alias("rate"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("rate"), "p_type")
    return r.withColumn("_i", F.row_number().over(w)).where("_i = 1").select("p_brand", F.col("p_type").alias("strategy"))


@query("""
    WITH w AS (SELECT user_id, (i - 1) // 10 + 1 AS evaluation, avg(value) AS mean FROM (SELECT user_id, value / 100 AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) GROUP BY 1, 2 HAVING count(*) = 10), l AS (SELECT *, mean - lag(mean) OVER (PARTITION BY user_id ORDER BY evaluation) AS delta FROM w)
    SELECT user_id, evaluation, round(mean, 9) AS mean, CASE WHEN delta IS NULL OR delta > 0.02 THEN 'keep' WHEN delta < -0.05 THEN 'reset' WHEN mean < 0 THEN 'decrease_explore_interval' ELSE 'increase_ema_alpha' END AS decision FROM l
""")
def self_optimizer(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 100).alias("value"))
    return P.evaluations(e, "user_id", ["ts", "event_id"], "value", 10).withColumn("mean", F.round("mean", 9))


@query()
def adaptive_alpha(spark, d):
    e = t(spark, d, "events").select("event_id", "ts", "user_id", (F.col("value") / 100).alias("expected"), (F.col("event_type") != "error").cast("double").alias("actual"))
    return S.fold(e, "user_id", ["ts", "event_id"], *P.alpha_step("expected", "actual")).select("event_id", F.round("alpha", 9).alias("alpha"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'critical' WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS priority FROM events")
def event_priority(spark, d):
    k = F.col("event_type")
    return t(spark, d, "events").select("event_id", F.when(k.isin("signup", "error"), "critical").when(k == "purchase", "high").when(k == "click", "medium").otherwise("low").alias("priority"))


@query(f"""
    WITH RECURSIVE {EDGES_SQL}, r(node, distance) AS (SELECT -1::BIGINT, 0 UNION SELECT e.src, r.distance + 1 FROM r JOIN e ON e.dst = r.node WHERE r.distance < 3), f AS (SELECT node, min(distance) AS distance FROM r GROUP BY 1 HAVING min(distance) > 0),
         n AS (SELECT count(*) FILTER (WHERE distance = 1) AS direct, count(*) FILTER (WHERE distance > 1) AS transitive, (SELECT count(DISTINCT dst) FROM e WHERE src = -1) AS together FROM f)
    SELECT direct, transitive, together, round(CASE WHEN direct + transitive + together = 0 THEN 0 ELSE (0.5 * direct + 0.3 * transitive + 0.2 * together) / (direct + transitive + together) END, 9) AS severity FROM n
""")
def enriched_blast(spark, d):
    e = cut(supply_edges(spark, d))
    r = G.blast_radius(e, spark.range(1).select((F.col("id") - 1).alias("node")), 3)
    n = r.agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("transitive")).withColumn("_k", F.lit(1))
    c = e.where("src = -1").agg(F.countDistinct("dst").alias("together")).withColumn("_k", F.lit(1))
    return n.join(c, "_k").select("direct", "transitive", "together", F.round(P.enriched_severity(F.col("direct"), F.col("transitive"), F.col("together")), 9).alias("severity"))


@query(f"""
    WITH RECURSIVE {EDGES_SQL}, r(node, distance) AS (SELECT -1::BIGINT, 0 UNION SELECT e.src, r.distance + 1 FROM r JOIN e ON e.dst = r.node WHERE r.distance < 2), f AS (SELECT node, min(distance) AS distance FROM r GROUP BY 1)
    SELECT 'node' AS kind, node AS a, NULL::BIGINT AS b, distance::INT AS distance FROM f UNION ALL SELECT 'link', e.src, e.dst, NULL FROM e JOIN f x ON x.node = e.src JOIN f y ON y.node = e.dst
""")
def blast_view(spark, d):
    e = cut(supply_edges(spark, d))
    origin = spark.range(1).select((F.col("id") - 1).alias("node"))
    return G.blast_view(e, origin, 2)


SIGNAL_SQL = "s AS (SELECT o_custkey AS k, o_orderkey AS i, o_totalprice / 100000 AS x, least(o_orderkey % 100 / 100, 0.99) AS c FROM orders)"


def signals(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 100000).alias("x"), F.least(F.col("o_orderkey") % 100 / 100, F.lit(0.99)).alias("c"))


@query(f"""
    WITH {SIGNAL_SQL}, m AS (SELECT *, max(x) OVER (PARTITION BY k) AS m, row_number() OVER (PARTITION BY k ORDER BY x DESC, i) AS r FROM s), p AS (SELECT *, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY k) AS p FROM m)
    SELECT k, count(*) AS n, round(sum(p * x), 5) AS fused, max(i) FILTER (WHERE r = 1) AS dominant, round(max(p), 5) AS top, round(-sum(p * ln(p)) + 1e-9, 5) AS entropy, round(min(x) + 1e-9, 5) AS lo, round(max(x) + 1e-9, 5) AS hi, round(coalesce(max(x) - max(x) FILTER (WHERE r = 2), 0) + 1e-9, 5) AS margin FROM p GROUP BY 1
""")
def signal_softmax(spark, d):
    f = P.softmax_fused(signals(spark, d), "k", "i", "x")
    return f.select("k", "n", "dominant", *(F.round(c, 5).alias(c) for c in ("fused", "top")), *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("entropy", "lo", "hi", "margin")))


@query(f"""
    WITH {SIGNAL_SQL}, b AS (SELECT *, round(c * 100) / 100 AS p FROM s), w AS (SELECT *, greatest(0, (p + 3.8416 / 200 - 1.96 * sqrt((p * (1 - p) + 3.8416 / 400) / 100)) / (1 + 3.8416 / 100)) AS w FROM b),
         g AS (SELECT k, stddev_pop(x) / abs(avg(x)) AS cv, CASE WHEN abs(sum(c)) < 1e-12 THEN avg(x) ELSE sum(x * c) / sum(c) END AS vc, CASE WHEN abs(sum(w)) < 1e-12 THEN avg(x) ELSE sum(x * w) / sum(w) END AS vw, 1 - product(1 - c) AS confidence, max(w) AS bound FROM w GROUP BY 1)
    SELECT k, round(CASE WHEN coalesce(cv > 0.3, false) THEN vw ELSE vc END, 6) AS value, round(confidence, 6) AS confidence, coalesce(cv > 0.3, false) AS conflict, round(bound, 6) AS bound FROM g
""")
def reconcile(spark, d):
    r = P.reconciled(signals(spark, d), "k", "x", "c")
    return r.select("k", F.round("value", 6).alias("value"), F.round("confidence", 6).alias("confidence"), "conflict", F.round("bound", 6).alias("bound"))


HIST_SQL = "h AS (SELECT floor(value / 5) AS b, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS p, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS q FROM events GROUP BY 1)"


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy(F.floor(F.col("value") / 5).alias("b")).agg(*(F.count_if(F.col("event_type") == k).cast("double").alias(c) for c, k in (("p", "error"), ("q", "view"))))


@query(f"WITH {HIST_SQL}, s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM h) SELECT round(greatest(0, coalesce(sum(CASE WHEN p > 1e-12 THEN p * ln(p / greatest(q, 1e-12)) END), 0)), 9) AS kl FROM s")
def kl(spark, d):
    return P.kl_divergence(histogram(spark, d), "p", "q").withColumn("kl", F.round("kl", 9))


@query(f"""
    WITH c AS (SELECT value AS x, count(*) FILTER (WHERE event_type = 'error') AS a, count(*) FILTER (WHERE event_type <> 'error') AS b FROM events GROUP BY 1), r AS (SELECT sum(a) OVER (ORDER BY x) AS ra, sum(b) OVER (ORDER BY x) AS rb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c), k AS (SELECT max(abs(ra / n1 - rb / n2)) AS ks FROM r),
         {HIST_SQL}, s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM h), m AS (SELECT p, q, (p + q) / 2 AS m FROM s), j AS (SELECT sqrt(greatest(0, sum(CASE WHEN p > 1e-12 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 1e-12 THEN q * ln(q / m) ELSE 0 END) / 2)) AS js FROM m)
    SELECT round(ks, 9) AS ks, round(js, 9) AS js, CASE WHEN ks > 0.3 OR js > 0.25 THEN 'high' WHEN ks > 0.15 OR js > 0.1 THEN 'medium' WHEN ks > 0.05 OR js > 0.05 THEN 'low' ELSE 'none' END AS severity FROM k, j
""")
def drift_severity(spark, d):
    k = ST.ks(t(spark, d, "events"), "value", F.col("event_type") != "error").select(F.col("d").alias("ks"), F.lit(1).alias("_k"))
    j = ST.js_distance(histogram(spark, d), "b", "p", "q").withColumn("_k", F.lit(1))
    return k.join(j, "_k").select(F.round("ks", 9).alias("ks"), F.round("js", 9).alias("js"), P.drift_band(F.col("ks"), F.col("js")).alias("severity"))


@query(f"SELECT user_id, CASE WHEN count(*) >= 70 THEN 'promote' WHEN (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 86400000000.0 >= 1.5 THEN 'demote' ELSE 'keep' END AS tier FROM events GROUP BY 1")
def tiers(spark, d):
    idle = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 8.64e10
    n = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), idle.alias("idle"))
    return n.select("user_id", P.tier(F.col("n") / 7, F.col("idle") * 20).alias("tier"))


@query("SELECT l_partkey, l_suppkey, n // 2 AS n FROM (SELECT l_partkey, l_suppkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2) WHERE NOT (n <= 1 AND last < TIMESTAMP '1996-01-01')")
def coedit_decay(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last"))
    return g.where(~((F.col("n") <= 1) & (F.col("last") < F.lit("1996-01-01").cast("timestamp_ntz")))).select("l_partkey", "l_suppkey", F.expr("n div 2").alias("n"))


LISTS_SQL = "a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50), c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents ORDER BY rank LIMIT 50)"


def three_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    return [X.ranked(docs.select("doc_id", s.cast("long").alias("score")), "doc_id", 50) for s in (F.col("n_chars"), -F.col("n_chars"), -F.col("doc_id"))]


@query(f"WITH {LISTS_SQL} SELECT doc_id, round(sum(p), 9) AS score FROM (SELECT doc_id, 1.0 / (60 + rank) AS p FROM a UNION ALL SELECT doc_id, 0.9 * pow(0.5, 2) / (60 + rank) FROM b UNION ALL SELECT doc_id, 0.8 * pow(0.5, 3) / (60 + rank) FROM c) GROUP BY 1")
def rrf_decay(spark, d):
    a, b, c = three_lists(spark, d)
    return X.rrf_decayed([(a, 1.0, 0), (b, 0.9, 2), (c, 0.8, 3)], "doc_id", 0.5).withColumn("score", F.round("score", 9))


@query(f"WITH {LISTS_SQL} SELECT doc_id, round(sum(1.0 / 3 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1")
def rrf_normalized(spark, d):
    return X.rrf_normalized(three_lists(spark, d), "doc_id").withColumn("score", F.round("score", 9))


@query(f"""
    WITH k AS (SELECT doc_id, score FROM ({bm25_sql(QUERY, "")})), f AS (SELECT d.doc_id, n_chars / 20000 AS fusion, CASE WHEN lang = 'en' THEN n_chars / 50000 END AS semantic, k.score AS keyword FROM documents d LEFT JOIN k USING (doc_id))
    SELECT doc_id, round(fusion + 0.3 * coalesce(semantic, 0) + 0.1 * coalesce(keyword, 0), 6) AS score, round(0.3 * coalesce(semantic, 0) + 0.1 * coalesce(keyword, 0), 6) AS delta FROM f WHERE fusion + 0.3 * coalesce(semantic, 0) + 0.1 * coalesce(keyword, 0) >= 0.1
""")
def rerank(spark, d):
    docs = t(spark, d, "documents")
    keyword = X.bm25(docs, "doc_id", "text", QUERY).withColumnRenamed("score", "keyword")
    c = docs.select("doc_id", (F.col("n_chars") / 20000).alias("fusion"), F.when(F.col("lang") == "en", F.col("n_chars") / 50000).alias("semantic")).join(keyword, "doc_id", "left")
    return P.reranked(c, "fusion", "semantic", "keyword", 0.1).select("doc_id", F.round("score", 6).alias("score"), F.round("delta", 6).alias("delta"))


@query("SELECT doc_id, round(n_chars * CASE WHEN lang = 'en' THEN 1 + 0.2 * CASE source WHEN 'src0' THEN 1.5 WHEN 'src1' THEN 1.2 WHEN 'src2' THEN 0.8 ELSE 0.5 END ELSE 1 END, 6) AS score FROM documents")
def semantic_weighting(spark, d):
    s = F.col("source")
    intent = F.when(s == "src0", "debug").when(s == "src1", "understand").when(s == "src2", "refactor").otherwise("explore")
    return t(spark, d, "documents").select("doc_id", F.round(semantic_weight(F.col("n_chars").cast("double"), intent, F.col("lang") == "en"), 6).alias("score"))


@query("SELECT doc_id FROM (SELECT doc_id, string_split_regex(lower(source || ' ' || text), '[^\\p{L}\\p{N}_]+') AS ws FROM documents) WHERE list_contains(ws, 'the') AND list_contains(ws, 'src3')")
def recall_terms(spark, d):
    return X.all_terms(t(spark, d, "documents"), ["source", "text"], "the, SRC3!").select("doc_id")


@query("""
    WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: octet_length(encode(w)) >= 2)) AS token FROM documents)
    SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS tokens, count(DISTINCT token) AS terms FROM w
""")
def index_stats(spark, d):
    docs = t(spark, d, "documents")
    w = docs.select(F.explode(X.tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    one = w.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("terms")).withColumn("_k", F.lit(1))
    return docs.agg(F.count(F.lit(1)).alias("docs")).withColumn("_k", F.lit(1)).join(one, "_k").drop("_k")


@query("SELECT doc_id, trim(substr(text, greatest(p - 30, 1), least(p - 1, 30))) AS before FROM (SELECT doc_id, text, instr(text, 'License') AS p FROM documents) WHERE p > 0")
def context_snippets(spark, d):
    at = F.instr("text", "License")
    return t(spark, d, "documents").where(at > 0).select("doc_id", X.context_before(F.col("text"), at - 1, 30).alias("before"))


@query()
def command_hashes(spark, d):
    return X.command_states(t(spark, d, "part"), "p_partkey", "p_name")


@query()
def path_vectors(spark, d):
    e = V.path_embedding(t(spark, d, "pages"), "page_id", "url")
    return e.select("page_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@query()
def blast_approximate(spark, d):
    """The pages nearest to the first by the embedding of their paths."""
    e = cut(V.path_embedding(t(spark, d, "pages"), "page_id", "url"))
    q = list(e.where("page_id = 0").first()["embedding"])
    return V.top_k(e.where("page_id != 0"), "page_id", "embedding", q, 10).withColumn("score", F.round("score", 9))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1) AS q FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(list_zip(v, q), lambda x: x[1] + x[2])), 6) AS added, round(list_sum(list_transform(list_zip(v, q), lambda x: x[1] - x[2])), 6) AS subtracted, round(list_sum(v) * 2.5, 6) AS scaled, round(list_sum(list_transform(list_zip(v, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS squared,
           round(list_sum(list_transform(v, lambda x: greatest(x, 0))), 6) AS relu, round(list_dot_product(v, q) + q[(vec_id % 64)::INT + 1], 6) AS product, round(v[3] * q[5], 9) AS cell FROM e
""")
def vector_arithmetic(spark, d):
    e = t(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 1").first()["embedding"]]
    v, w = F.col("embedding"), V.literal(q)
    product = V.with_bias(V.dot(v, w), q, F.col("vec_id") % 64)
    one = lambda c, n: F.round(V.summed(c), 6).alias(n)
    return e.select("vec_id", one(V.added(v, w), "added"), one(V.subtracted(v, w), "subtracted"), one(V.scaled(v, 2.5), "scaled"), F.round(V.squared_euclidean(v, w), 6).alias("squared"), one(V.relu(F.transform(v, lambda x: x.cast("double"))), "relu"), F.round(product, 6).alias("product"), F.round(F.get(F.get(V.outer(v, w), F.lit(2)), F.lit(4)), 9).alias("cell"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1) AS q FROM embeddings) SELECT vec_id, round(list_dot_product(v, q), 6) AS y FROM e")
def mat_vec(spark, d):
    e = t(spark, d, "embeddings")
    return V.mat_vec(e, "vec_id", "embedding", list(e.where("vec_id = 1").first()["embedding"])).withColumn("y", F.round("y", 6))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) + 0.0 AS distance FROM e q, e WHERE q.vec_id % 20 = 0
""")
def pairwise_distances(spark, d):
    from sparkloom.plans.search import every_twentieth

    e = t(spark, d, "embeddings")
    return V.similarities(every_twentieth(e), e, "vec_id", "embedding").select("query_id", "vec_id", (F.round(1 - F.col("score"), 6) + 0.0).alias("distance"))


@query("SELECT o_custkey AS src, o_orderkey AS dst, round(CASE WHEN abs(sum(o_totalprice) OVER (PARTITION BY o_custkey)) < 1e-12 THEN 0 ELSE o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) END, 9) AS share FROM orders")
def attention_weights(spark, d):
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_totalprice").alias("w"))
    return V.attention(e, "src", "w").select("src", "dst", F.round("share", 9).alias("share"))


@query("SELECT l_orderkey AS edge, count(DISTINCT l_partkey) AS members, min(l_partkey) AS first, max(l_partkey) AS last FROM lineitem GROUP BY 1")
def hyperedge_members(spark, d):
    e = G.hyperedges(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return G.members_of(e).groupBy("edge").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first"), F.max("node").alias("last"))


@query("""
    WITH RECURSIVE n AS (SELECT n_nationkey::BIGINT AS k FROM nation), e AS (SELECT a.k AS src, b.k AS dst FROM n a JOIN n b ON b.k IN (a.k + 1, a.k + 3)), r(path) AS (SELECT [k] FROM n UNION ALL SELECT list_append(path, dst) FROM r JOIN e ON e.src = path[-1])
    SELECT array_to_string(path, '-') AS path, len(path)::INT AS nodes FROM r ORDER BY len(path) DESC, path LIMIT 1
""")
def longest_path(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    e = n.withColumn("dst", F.explode(F.array(F.col("src") + 1, F.col("src") + 3))).join(n.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    return G.longest_path(e).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), F.size("path").alias("nodes"))


@query("""
    WITH c AS (SELECT event_type AS other, count(*)::DOUBLE AS w FROM events GROUP BY 1), k AS (SELECT p_partkey, ['click', 'error', 'purchase', 'signup', 'view'][(p_partkey % 5)::INT + 1] AS candidate FROM part)
    SELECT p_partkey, candidate, w AS strength FROM k LEFT JOIN c ON other = candidate ORDER BY strength DESC, p_partkey LIMIT 25
""")
def pheromone_rerank(spark, d):
    c = t(spark, d, "events").groupBy(F.col("event_type").alias("candidate")).agg(F.count(F.lit(1)).cast("double").alias("strength"))
    k = t(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), (F.col("p_partkey") % 5).cast("int")).alias("candidate"))
    return k.join(c, "candidate", "left").orderBy(F.desc("strength"), "p_partkey").limit(25).select("p_partkey", "candidate", "strength")


@query("""
    WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 10 <> 3), u AS (SELECT id, v, label FROM p WHERE id % 10 <> 7 UNION ALL SELECT id, list_transform(v, lambda x: -x), 99 FROM p WHERE id % 10 = 7), q AS (SELECT v AS q FROM p WHERE id = 0),
         s AS (SELECT id, label, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM u, q WHERE label IN (1, 2, 3, 99))
    SELECT id, label, round(score, 6) AS score FROM s WHERE score >= 0.05 ORDER BY s.score DESC, id LIMIT 10
""")
def collection_search(spark, d):
    """A collection is made, filled, partly deleted and overwritten, and searched with a filter and a threshold."""
    from sparkloom.sources.collections import Collection

    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")
    c = Collection.create(spark, "vectors", 64, "cosine", "label int")
    c.upsert(e)
    c.delete(e.where("id % 10 = 3").select("id"))
    c.upsert(e.where("id % 10 = 7").withColumn("vector", F.transform("vector", lambda x: -x)).withColumn("label", F.lit(99)))
    q = [float(x) for x in e.where("id = 0").first()["vector"]]
    return c.search(q, 10, where=F.col("label").isin(1, 2, 3, 99), least=0.05).select("id", "label", F.round("score", 6).alias("score"))


@query("SELECT s_suppkey, round(greatest(0, (0.7 + 3.8416 / 200 - 1.96 * sqrt((0.7 * 0.3 + 3.8416 / 400) / 100)) / (1 + 3.8416 / 100)), 9) AS wilson, round(100 * pow(0.5, s_nationkey / 7.0), 9) AS halved, round(-1000 + 400 / 1.1 + 900 / 1.21, 6) AS npv FROM supplier")
def sql_functions(spark, d):
    """The functions that registry.register() gives to Spark SQL."""
    from sparkloom.functions.registry import register

    register(spark)
    t(spark, d, "supplier").createOrReplaceTempView("_supplier")
    return spark.sql("SELECT s_suppkey, round(wilson_lower(70, 100), 9) AS wilson, round(100 * half_life(s_nationkey, 7), 9) AS halved, round(npv(array(-1000, 400, 900), 0.1), 6) AS npv FROM _supplier")


@query()
def leader_clusters(spark, d):
    from sparkloom.operators.learning import leader_clusters as clusters

    return clusters(t(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.1, 20)


@query("SELECT s_suppkey, s_nationkey + 4000 AS srid, 'POINT (' || s_suppkey || ' ' || (s_nationkey + 0.5) || ')' AS wkt FROM supplier")
def geometries(spark, d):
    from sparkloom.functions.geometry import from_ewkb, point_ewkb

    s = t(spark, d, "supplier").withColumn("g", point_ewkb(F.col("s_suppkey"), F.col("s_nationkey") + 0.5, F.col("s_nationkey") + 4000))
    return s.select("s_suppkey", from_ewkb(F.col("g")).alias("r")).select("s_suppkey", "r.srid", "r.wkt")


@query("SELECT l_orderkey AS file, count(*) AS symbols FROM lineitem GROUP BY 1")
def symbol_index(spark, d):
    from sparkloom.sources.files import symbol_documents

    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("line"))
    return symbol_documents(li, "file", "name", "kind", "line").select("file", F.expr("json_array_length(document)").cast("long").alias("symbols"))


@query("SELECT user_id AS id, CAST(NULL AS VARCHAR) AS command, event_type AS command_short, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success FROM events")
def migrated_log(spark, d):
    from sparkloom.sources.tables import migrated

    old = t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("command_short"), (F.col("event_type") != "error").cast("long").alias("success"), "props")
    return migrated(old, "bash_outcomes").select("id", "command", "command_short", "success")
