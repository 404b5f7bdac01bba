"""Queries of stores, sessions, co-access, pooled vectors, plans and learners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.code import chunks, each, intent, keyword_matches
from sparkloom.operators import learning as L
from sparkloom.operators import relational as R
from sparkloom.operators import sequences as S
from sparkloom.operators import text as X
from sparkloom.operators import vectors as V
from sparkloom.streaming.projections import fingerprints

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


@query("""
    SELECT least(prev, event_type) AS a, greatest(prev, event_type) AS b, count(*)::DOUBLE AS strength FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
    WHERE prev IS NOT NULL AND prev <> event_type GROUP BY 1, 2
""")
def reinforce_paths(spark, d):
    return L.reinforced(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"SELECT event_id, user_id, round(value * pow(0.5, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000.0 / 168), 6) AS value FROM events WHERE value * pow(0.5, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000.0 / 168) >= 1")
def evaporate(spark, d):
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    e = t(spark, d, "events").select("event_id", "user_id", "value", age.alias("age"))
    return L.evaporated(e, "value", "age", 168.0, 1.0).select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("""
    WITH q AS (SELECT p_brand, greatest(avg(p_retailprice) / 1000, 0.01) AS q FROM part GROUP BY 1) SELECT p_brand, greatest(floor(q / (SELECT sum(q) FROM q) * 1000), 5)::BIGINT AS budget FROM q
""")
def budget_by_value(spark, d):
    q = t(spark, d, "part").groupBy("p_brand").agg((F.avg("p_retailprice") / 1000).alias("q"))
    return L.budget_shares(q, "q", 1000, 5).select("p_brand", "budget")


@query("""
    WITH k AS (SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS needs FROM orders)
    SELECT a.task, a.status, a.status = 'pending' AND (a.needs IS NULL OR coalesce(b.status, '') = 'done') AS ready FROM k a LEFT JOIN k b ON b.task = a.needs
""")
def plan_ready(spark, d):
    tasks = t(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"))
    deps = tasks.where("task > 0").select("task", F.expr("task div 2").alias("needs"))
    return L.plan_status(tasks, deps)


@query("""
    WITH e AS (SELECT l_orderkey AS src, l_partkey % 500 AS vec_id, l_quantity AS w FROM lineitem WHERE l_orderkey < 50), v AS (SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[64]::DOUBLE AS x64 FROM embeddings)
    SELECT src, round(sum(w * x1) / sum(w), 6) AS x1, round(sum(w * x64) / sum(w), 6) AS x64 FROM e JOIN v USING (vec_id) GROUP BY 1
""")
def pooled_neighbours(spark, d):
    e = t(spark, d, "lineitem").where("l_orderkey < 50").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") % 500).alias("dst"), F.col("l_quantity").alias("w"))
    v = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return V.pooled(e, "src", "dst", "w", v, "vec_id", "v").select("src", F.round(F.get("pooled", F.lit(0)), 6).alias("x1"), F.round(F.get("pooled", F.lit(63)), 6).alias("x64"))


@query("""
    WITH e AS (SELECT l_orderkey AS src, l_partkey % (SELECT count(*) FROM embeddings) AS vec_id, l_quantity AS w FROM lineitem), v AS (SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[64]::DOUBLE AS x64 FROM embeddings)
    SELECT src, round(sum(w * x1) / sum(w), 6) AS x1, round(sum(w * x64) / sum(w), 6) AS x64 FROM e JOIN v USING (vec_id) GROUP BY 1
""")
def pooled_neighbours_all(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") % F.lit(v.count())).alias("dst"), F.col("l_quantity").alias("w"))
    return V.pooled(e, "src", "dst", "w", v, "vec_id", "v").select("src", F.round(F.get("pooled", F.lit(0)), 6).alias("x1"), F.round(F.get("pooled", F.lit(63)), 6).alias("x64"))


@query()
def keyword_hits(spark, d):
    return each(t(spark, d, "documents"), "doc_id", "text", keyword_matches(["the", "then", "License", "idiot"]), "keyword string, start long")


INTENT_SQL = {
    "understand": "how|why|what|explain|describe|understand|works",
    "debug": "fix|bug|error|fail|broken|panic|exception|issue|wrong",
    "implement": "add|create|build|make|implement|new|write|code",
    "refactor": "rename|extract|inline|refactor|move|change|simplify|cleanup|restructure",
    "document": "document|describe|annotate|comment|explain|spec",
}


@query(f"""
    WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM conversations), c AS (SELECT conv_id, turn, {", ".join(f"len(list_filter(ws, lambda x: regexp_matches(x, '{v}'))) AS {k}" for k, v in INTENT_SQL.items())} FROM w),
         s AS (SELECT *, {" + ".join(INTENT_SQL)} AS total, greatest({", ".join(INTENT_SQL)}) AS n FROM c)
    SELECT conv_id, turn, CASE WHEN total = 0 OR total - 1 > n THEN 'explore' {" ".join(f"WHEN {k} = n THEN '{k}'" for k in INTENT_SQL)} END AS intent, n,
           round(CASE WHEN total = 0 THEN 1.0 ELSE greatest(0.3, CASE WHEN total - 1 > n THEN total - 1 ELSE n END / (2 * total - 1)) END, 9) AS confidence FROM s
""")
def intents(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.intent", "i.n", F.round("i.confidence", 9).alias("confidence"))


@query()
def text_chunks(spark, d):
    return each(t(spark, d, "documents"), "doc_id", "text", chunks, "chunk long, first_line long, last_line long, piece string").withColumn("size", F.length("piece")).drop("piece")


@query("SELECT p_name, p_brand, count(*) AS n FROM part WHERE p_name LIKE 'red%' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def prefix_scan(spark, d):
    p = t(spark, d, "part").where(F.startswith("p_name", F.lit("red")))
    return p.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_name", "p_brand").limit(20)


@query()
def session_fingerprints(spark, d):
    return fingerprints(t(spark, d, "conversations"), "conv_id", ["turn", "role", "text"])


@query("SELECT label, count(*) AS docs, sum(CASE WHEN size >= 2 THEN 1 ELSE 0 END)::BIGINT AS large FROM (SELECT label, vec_id % 7 AS g, count(*) AS size FROM embeddings GROUP BY 1, 2) GROUP BY 1")
def group_sizes(spark, d):
    g = t(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 7).alias("g")).agg(F.count(F.lit(1)).alias("size"))
    return g.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("size") >= 2).alias("large"))


@query("""
    WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM r GROUP BY user_id, session
""")
def sessions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS")
    s = t(spark, d, "events").withColumn("session", F.sum(F.when(near, 0).otherwise(1)).over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("SELECT s_suppkey, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 10")
def slowest_join(spark, d):
    j = t(spark, d, "supplier").select("s_suppkey").join(t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_discount"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    g = j.groupBy("s_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "s_suppkey").limit(10)


@query()
def double_q(spark, d):
    e = t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kinds = ["click", "error", "purchase", "signup", "view"]
    return S.fold(e, "user_id", ["ts", "event_id"], *L.double_q_step("value", "event_type", kinds)).select("event_id", F.round("q", 6).alias("q"), F.round("td_error", 6).alias("td_error"))


@query()
def ftrl(spark, d):
    e = t(spark, d, "events").select("event_id", "ts", "user_id", F.array((F.col("value") / 50), F.lit(1.0)).alias("x"), (F.col("event_type") == "error").cast("double").alias("y"))
    return S.fold(e, "user_id", ["ts", "event_id"], *L.ftrl_step("x", "y")).select("event_id", F.round("p", 6).alias("p"))


@query("SELECT DISTINCT word AS term, 'part' AS kind FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) UNION SELECT DISTINCT c_mktsegment, 'segment' FROM customer")
def term_registry(spark, d):
    words = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term"), F.lit("part").alias("kind"))
    return words.unionByName(t(spark, d, "customer").select(F.col("c_mktsegment").alias("term"), F.lit("segment").alias("kind"))).distinct()


@query("SELECT event_type, user_id, n, rank FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 3")
def top_per_group(spark, d):
    n = t(spark, d, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return R.top_within(n, "event_type", [F.desc("n"), F.asc("user_id")], 3)


@query("SELECT doc_id, round(score, 6) AS similarity FROM (SELECT a.doc_id, len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) AS score FROM (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS l FROM documents) a, (SELECT list_distinct(string_split(text, chr(10))) AS l FROM documents WHERE doc_id = 3) b) WHERE score > 0")
def shared_lines(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.array_distinct(F.split("text", "\n")).alias("l"))
    q = lines.where("doc_id = 3").first()["l"]
    return lines.select("doc_id", F.round(X.jaccard(F.col("l"), F.lit(q).cast("array<string>")), 6).alias("similarity")).where("similarity > 0")
