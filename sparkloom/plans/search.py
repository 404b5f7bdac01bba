"""Queries over vectors, text, graphs, statistics and money; each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.rounds import cut
from sparkloom.functions.scalars import code_words, money
from sparkloom.operators import aggregates as A
from sparkloom.operators import graphs as G
from sparkloom.operators import stats as ST
from sparkloom.operators import text as X
from sparkloom.operators import vectors as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOP = 10
QUERY = "the thing and that"


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with SQL if there is some."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


#: SQL of each metric between v (a row's vector) and q (the query's), as lists of doubles.
METRIC_SQL = {
    "cosine": "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))",
    "dot": "list_dot_product(v, q)",
    "euclidean": "list_distance(v, q)",
    "manhattan": "list_sum(list_transform(list_zip(v, q), lambda x: abs(x[1] - x[2])))",
    "chebyshev": "list_max(list_transform(list_zip(v, q), lambda x: abs(x[1] - x[2])))",
    "pearson": "list_dot_product(list_transform(v, lambda x: x - list_avg(v)), list_transform(q, lambda x: x - list_avg(q))) / (sqrt(list_dot_product(list_transform(v, lambda x: x - list_avg(v)), list_transform(v, lambda x: x - list_avg(v)))) * sqrt(list_dot_product(list_transform(q, lambda x: x - list_avg(q)), list_transform(q, lambda x: x - list_avg(q)))))",
}

for _metric, _sql in METRIC_SQL.items():
    _order = "DESC" if V.METRICS[_metric][1] else "ASC"

    @query(f"WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings) SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {_sql} AS score FROM x ORDER BY score {_order}, vec_id LIMIT {TOP})", f"{_metric}_topk")
    def _topk(spark, d, metric=_metric):
        return V.top_k(t(spark, d, "embeddings"), "vec_id", "embedding", first_vector(spark, d), TOP, metric).withColumn("score", F.round("score", 6))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS s FROM e q, e WHERE q.vec_id < 20)
    SELECT query_id, vec_id, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def pairwise_topk(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.top_k_batch(q, e, "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


def every_twentieth(e: DataFrame) -> DataFrame:
    """The query set of searches over all embeddings; it grows with the table."""
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS s FROM e q, e WHERE q.vec_id % 20 = 0)
    SELECT query_id, vec_id, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""")
def pairwise_topk_all(spark, d):
    e = t(spark, d, "embeddings")
    return V.top_k_batch(every_twentieth(e), e, "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


@query()
def ivf_topk(spark, d):
    e = t(spark, d, "embeddings")
    return V.ivf_top_k_batch(every_twentieth(e), e, "vec_id", "embedding", TOP, V.ivf_centroids(e, "vec_id", "embedding")).withColumn("score", F.round("score", 6))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)
    SELECT vec_id, round(lo, 6) AS zero, round(greatest((hi - lo) / 15, 1e-10), 6) AS scale, list_sum(list_transform(v, lambda x: floor((x - lo) / greatest((hi - lo) / 15, 1e-10) + 0.5)))::BIGINT AS code_sum FROM e
""")
def quantize_u4(spark, d):
    q = V.quantized(t(spark, d, "embeddings"), "embedding")
    return q.select("vec_id", F.round("zero", 6).alias("zero"), F.round("scale", 6).alias("scale"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id, list_position(v, list_max(v)) - 1 AS argmax, list_position(v, list_min(v)) - 1 AS argmin, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_max(v) / sqrt(list_dot_product(v, v)), 6) AS top,
           round(list_max(list_transform(v, lambda x: exp(x - list_max(v)))) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS softmax_top FROM e
""")
def vector_ops(spark, d):
    e = t(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    v = F.col("v")
    return e.select("vec_id", V.argmax(v).alias("argmax"), V.argmin(v).alias("argmin"), F.round(V.norm(v), 6).alias("norm"), F.round(F.array_max(V.normalized(v)), 6).alias("top"), F.round(F.array_max(V.softmax(v)), 6).alias("softmax_top"))


TOKENS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: octet_length(encode(w)) >= 2)"


@query(f"""
    WITH t AS (SELECT doc_id, {TOKENS_SQL} AS ws FROM documents), q AS (SELECT list_distinct(ws) AS q FROM t WHERE doc_id = 1), j AS (SELECT doc_id, list_distinct(ws) AS s, q FROM t, q)
    SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(s, q))) = 0 THEN 1.0 ELSE len(list_intersect(s, q)) / len(list_distinct(list_concat(s, q))) END, 6) AS score FROM j
""")
def jaccard(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.array_distinct(X.tokens("text")).alias("s"))
    q = docs.where("doc_id = 1").first()
    return docs.select("doc_id", F.round(X.jaccard(F.col("s"), F.lit(q["s"]).cast("array<string>")), 6).alias("score"))


@query(f"""
    WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents), p AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), f AS (SELECT token, count(*) AS df FROM p GROUP BY 1)
    SELECT doc_id, token, tf, df, round(tf * (ln((SELECT count(*) FROM documents)::DOUBLE / df) + 1), 6) AS tfidf FROM p JOIN f USING (token)
""")
def tfidf(spark, d):
    docs = t(spark, d, "documents")
    return X.tfidf(cut(X.postings(docs, "doc_id", "text")), "doc_id", docs.count()).select("doc_id", "token", "tf", "df", F.round("tfidf", 6).alias("tfidf"))


@query()
def tfidf_embedding(spark, d):
    docs = t(spark, d, "documents")
    w = X.tfidf(cut(X.postings(docs, "doc_id", "text")), "doc_id", docs.count())
    return X.hashed_embedding(w, "doc_id", "tfidf").select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


SPLIT_SQL = "list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')"


def bm25_sql(query: str, limit: str, average: str = "(SELECT avg(len(ws)) FROM t)") -> str:
    terms = list(dict.fromkeys(query.split()))
    tf = lambda w: f"CASE WHEN len(list_filter(ws, lambda w: w = '{w}')) > 0 THEN len(list_filter(ws, lambda w: w = '{w}'))::DOUBLE WHEN contains(low, '{w}') THEN 0.5 ELSE 0.0 END"
    part = lambda i: f"f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / a))"
    return f"""
    WITH t AS (SELECT doc_id, {SPLIT_SQL} AS ws, lower(text) AS low FROM documents), m AS (SELECT *, len(ws)::DOUBLE AS n, {average} AS a, {", ".join(f"{tf(w)} AS f{i}" for i, w in enumerate(terms))} FROM t),
         s AS (SELECT doc_id, n, {" + ".join(part(i) for i in range(len(terms)))} AS score FROM m)
    SELECT doc_id, n, score FROM s WHERE score > 0 ORDER BY round(score, 9) DESC, doc_id {limit}"""


@query(f"SELECT doc_id, CASE WHEN n < 50 THEN 'short' WHEN n < 200 THEN 'medium' ELSE 'long' END AS bucket, round(score, 6) AS score FROM ({bm25_sql(QUERY, '', 'CASE WHEN len(ws) < 50 THEN 25.0 WHEN len(ws) < 200 THEN 100.0 ELSE 350.0 END')})")
def bm25_bucket(spark, d):
    return X.bm25_bucketed(t(spark, d, "documents"), "doc_id", "text", QUERY).select("doc_id", "bucket", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({bm25_sql(QUERY, 'LIMIT 20')})")
def bm25(spark, d):
    s = X.bm25(t(spark, d, "documents"), "doc_id", "text", QUERY).withColumn("score", F.round("score", 9))
    return s.orderBy(F.desc("score"), "doc_id").limit(20).withColumn("score", F.round("score", 6))


@query(f"""
    WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({bm25_sql(QUERY, 'LIMIT 50')})), l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50),
         u AS (SELECT doc_id, 0.7 / (60 + rank) AS p FROM b UNION ALL SELECT doc_id, 0.3 / (60 + rank) FROM l)
    SELECT doc_id, round(sum(p), 9) AS score FROM u GROUP BY 1
""")
def rrf(spark, d):
    docs = t(spark, d, "documents")
    text = X.ranked(X.bm25(docs, "doc_id", "text", QUERY).withColumn("score", F.round("score", 9)), "doc_id", 50)
    size = X.ranked(docs.select("doc_id", F.col("n_chars").alias("score")), "doc_id", 50)
    return X.rrf([(text, 0.7), (size, 0.3)], "doc_id").withColumn("score", F.round("score", 9))


@query("SELECT word, levenshtein(lower(word), 'wigdet')::INT AS distance FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE levenshtein(lower(word), 'wigdet') <= 3")
def fuzzy_terms(spark, d):
    words = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return X.fuzzy(words, "word", "wigdet", 3)


@query(f"SELECT DISTINCT token FROM (SELECT unnest({TOKENS_SQL}) AS token FROM documents) WHERE starts_with(token, 'thin') ORDER BY token LIMIT 15")
def suggest(spark, d):
    return X.suggest(t(spark, d, "documents").select(F.explode(X.tokens("text")).alias("token")), "token", "thin", 15)


@query(f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents), w AS (SELECT doc_id, line, unnest({TOKENS_SQL}) AS token FROM l)
    SELECT token, doc_id, line, count(*) AS n FROM w GROUP BY 1, 2, 3
""")
def inverted_index(spark, d):
    return X.inverted_index(t(spark, d, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


@query("""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: NOT regexp_matches(x, '^[{}()\\[\\];, ]*$')) AS ls FROM documents),
         b AS (SELECT doc_id, unnest(range(1, greatest(len(ls) - 5, 0) + 1)) AS pos, ls FROM l), h AS (SELECT doc_id, pos, array_to_string(list_slice(ls, pos, pos + 5), chr(10)) AS h FROM b),
         m AS (SELECT doc_id, h FROM h GROUP BY 1, 2 HAVING max(pos) >= min(pos) + 6), c AS (SELECT doc_id, count(*) AS blocks FROM m GROUP BY 1),
         d AS (SELECT doc_id, count(DISTINCT line) AS duplicated FROM (SELECT doc_id, unnest(range(pos, pos + 6)) AS line FROM h JOIN m USING (doc_id, h)) GROUP BY 1)
    SELECT l.doc_id, len(ls) AS lines, coalesce(duplicated, 0) AS duplicated, coalesce(blocks, 0) AS blocks, round(CASE WHEN len(ls) > 0 THEN coalesce(duplicated, 0) / len(ls) ELSE 0 END, 9) AS ratio FROM l LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def dup_shingles(spark, d):
    return X.duplicate_lines(t(spark, d, "documents"), "doc_id", "text").withColumn("ratio", F.round("ratio", 9))


@query("SELECT p_partkey, amount, currency, confidence, start FROM (SELECT p_partkey, round(p_retailprice, 2) AS amount, 'USD' AS currency, CAST(0.95 AS DOUBLE) AS confidence, length(p_name) + 7 AS start FROM part UNION ALL SELECT p_partkey, p_size * 1000000.0::DOUBLE, 'EUR', CAST(0.85 AS DOUBLE), length(p_name) + 7 + length('$' || printf('%.2f', p_retailprice)) + 13 FROM part)")
def money_amounts(spark, d):
    said = F.concat("p_name", F.lit(" costs $"), F.format_string("%.2f", "p_retailprice"), F.lit(", or 5%, but "), F.col("p_size").cast("string"), F.lit(" million euros"))
    found = money(t(spark, d, "part").select("p_partkey", said.alias("text")), "p_partkey", "text")
    return found.select("p_partkey", F.round("amount", 2).alias("amount"), "currency", "confidence", "start")


@query("SELECT page_id, list_filter(string_split_regex(lower(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '(^|[^A-Za-z0-9])([A-Z]{2,})([A-Z][a-z])', '\\1\\2 \\3', 'g')), '[^a-z0-9]+'), lambda w: len(w) > 0) AS words FROM pages")
def code_tokens(spark, d):
    return t(spark, d, "pages").select("page_id", code_words("url").alias("words"))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """A digraph over parts and suppliers: part -> supplier of its small orders, supplier -> part of its large ones."""
    li = t(spark, d, "lineitem").where("l_quantity <= 2 OR l_quantity >= 49")
    return li.select(F.when(F.col("l_quantity") <= 2, F.col("l_partkey")).otherwise(-1 - F.col("l_suppkey")).alias("src"), F.when(F.col("l_quantity") <= 2, -1 - F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("dst")).distinct()


EDGES_SQL = "e AS (SELECT DISTINCT CASE WHEN l_quantity <= 2 THEN l_partkey ELSE -1 - l_suppkey END AS src, CASE WHEN l_quantity <= 2 THEN -1 - l_suppkey ELSE l_partkey END AS dst FROM lineitem WHERE l_quantity <= 2 OR l_quantity >= 49)"


@query(f"WITH RECURSIVE {EDGES_SQL}, r(node, distance) AS (SELECT -1::BIGINT, 0 UNION SELECT e.src, r.distance + 1 FROM r JOIN e ON e.dst = r.node WHERE r.distance < 3) SELECT node, min(distance)::INT AS distance FROM r GROUP BY node HAVING min(distance) > 0")
def blast_bfs(spark, d):
    origin = spark.range(1).select((F.col("id") - 1).alias("node"))
    return G.blast_radius(supply_edges(spark, d), origin, 3)


@query(f"WITH {EDGES_SQL} SELECT src AS node, count(*) AS dependents FROM e GROUP BY src")
def direct_dependents(spark, d):
    return supply_edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))


NATIONS_SQL = "e AS (SELECT DISTINCT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey + 1, a.n_nationkey + 3, (a.n_nationkey * 7) % 25) AND a.n_nationkey <> b.n_nationkey)"


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    to = n.withColumn("dst", F.explode(F.array(F.col("src") + 1, F.col("src") + 3, F.col("src") * 7 % 25)))
    return to.where("src != dst").join(n.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


@query(f"""
    WITH RECURSIVE {NATIONS_SQL}, p(path) AS (SELECT [src, dst] FROM e WHERE src = 0 UNION ALL SELECT list_append(path, dst) FROM p JOIN e ON e.src = path[-1] WHERE path[-1] <> 9 AND NOT list_contains(path, dst) AND len(path) < 6)
    SELECT array_to_string(path, '-') AS path, len(path)::INT AS nodes FROM p WHERE path[-1] = 9 ORDER BY len(path), p.path LIMIT 10
""")
def simple_paths(spark, d):
    p = G.simple_paths(nation_edges(spark, d), 0, 9, 6, 10)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), "nodes")


@query(f"""
    WITH RECURSIVE {NATIONS_SQL}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
    SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE EXISTS (SELECT 1 FROM r u JOIN r v ON u.a = v.b AND u.b = v.a WHERE u.a = x.a AND u.b <> x.a) GROUP BY 1
""")
def scc(spark, d):
    return G.strong_components(nation_edges(spark, d))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT a.n_nationkey::BIGINT AS src, b.n_nationkey::BIGINT AS dst FROM nation a JOIN nation b ON b.n_nationkey IN (a.n_nationkey + 1, a.n_nationkey + 3)), r(node, layer) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.layer + 1 FROM r JOIN e ON e.src = r.node)
    SELECT node, max(layer)::INT AS layer FROM r GROUP BY 1
""")
def topo(spark, d):
    return G.layers(nation_edges(spark, d).where("dst = src + 1 OR dst = src + 3"))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """A digraph of all order lines: part -> supplier where the quantity is odd, supplier -> part where it is even."""
    li = t(spark, d, "lineitem")
    odd = F.col("l_quantity").cast("long") % 2 == 1
    part, supplier = F.col("l_partkey"), -1 - F.col("l_suppkey")
    return li.select(F.when(odd, part).otherwise(supplier).alias("src"), F.when(odd, supplier).otherwise(part).alias("dst")).distinct()


@query()
def scc_all(spark, d):
    return G.strong_components(order_edges(spark, d))


@query("SELECT l_orderkey * 10 + l_linenumber AS node, l_linenumber - 1 AS layer FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1))")
def topo_all(spark, d):
    """Chains of all orders' lines, where these are numbered without gaps."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("hi"), F.min("l_linenumber").alias("lo")).where("n > 1 AND hi = n AND lo = 1").select("l_orderkey")
    e = li.join(n, "l_orderkey", "left_semi").where("l_linenumber > 1")
    return G.layers(e.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") - 1).alias("src"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dst")))


@query("WITH RECURSIVE e AS (SELECT DISTINCT CASE WHEN l_quantity::BIGINT % 2 = 1 THEN l_partkey ELSE -1 - l_suppkey END AS src, CASE WHEN l_quantity::BIGINT % 2 = 1 THEN -1 - l_suppkey ELSE l_partkey END AS dst FROM lineitem), r(node, distance) AS (SELECT -1::BIGINT, 0 UNION SELECT e.src, r.distance + 1 FROM r JOIN e ON e.dst = r.node WHERE r.distance < 3) SELECT node, min(distance)::INT AS distance FROM r GROUP BY node HAVING min(distance) > 0")
def blast_all(spark, d):
    return G.blast_radius(order_edges(spark, d), spark.range(1).select((F.col("id") - 1).alias("node")), 3)


def pair_edges(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 40).alias("s")).distinct()
    return li.select("l_orderkey", F.col("s").alias("a")).join(li.select("l_orderkey", F.col("s").alias("b")), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


PAIRS_SQL = "li AS (SELECT DISTINCT l_orderkey, l_suppkey % 40 AS s FROM lineitem), p AS (SELECT x.s AS a, y.s AS b, count(*)::DOUBLE AS w FROM li x JOIN li y ON x.l_orderkey = y.l_orderkey AND x.s < y.s GROUP BY 1, 2)"


@query(f"""
    WITH {PAIRS_SQL}, m AS (SELECT sum(w) AS m FROM p), k AS (SELECT c, sum(w) AS k FROM (SELECT a % 4 AS c, w FROM p UNION ALL SELECT b % 4, w FROM p) GROUP BY 1)
    SELECT round((SELECT sum(w) FROM p WHERE a % 4 = b % 4) / m - (SELECT sum(k * k) FROM k) / (4 * m * m), 9) AS q FROM m
""")
def modularity_q(spark, d):
    e = cut(pair_edges(spark, d))
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node") % 4)
    return G.modularity(e, nodes).withColumn("q", F.round("q", 9))


@query()
def communities(spark, d):
    return G.communities(pair_edges(spark, d))


@query("""
    WITH n AS (SELECT user_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE event_type <> 'error')::DOUBLE AS ok FROM events GROUP BY 1)
    SELECT user_id, round(greatest(0, (ok / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((ok / n * (1 - ok / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)), 6) AS lower,
           round(least(1, (ok / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((ok / n * (1 - ok / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)), 6) AS upper FROM n
""")
def wilson(spark, d):
    n = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("event_type") != "error").cast("double").alias("ok"))
    return n.select("user_id", F.round(ST.wilson_lower(F.col("ok"), F.col("n")), 6).alias("lower"), F.round(ST.wilson_upper(F.col("ok"), F.col("n")), 6).alias("upper"))


@query("""
    WITH c AS (SELECT value AS x, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY 1), r AS (SELECT sum(a) OVER (ORDER BY x) AS ra, sum(b) OVER (ORDER BY x) AS rb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c)
    SELECT round(max(abs(ra / n1 - rb / n2)), 9) AS d, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2 FROM r
""")
def ks(spark, d):
    return ST.ks(t(spark, d, "events"), "value", F.col("event_id") % 2 == 1).withColumn("d", F.round("d", 9))


@query("""
    WITH h AS (SELECT floor(value / 5) AS b, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS p, count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS q FROM events GROUP BY 1), s AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM h), m AS (SELECT p, q, (p + q) / 2 AS m FROM s)
    SELECT round(sqrt(greatest(0, sum(CASE WHEN p > 1e-12 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 1e-12 THEN q * ln(q / m) ELSE 0 END) / 2)), 9) AS js FROM m
""")
def js(spark, d):
    h = t(spark, d, "events").groupBy(F.floor(F.col("value") / 5).alias("b")).agg(*(F.count_if(F.col("event_type") == k).cast("double").alias(c) for c, k in (("p", "error"), ("q", "view"))))
    return ST.js_distance(h, "b", "p", "q").withColumn("js", F.round("js", 9))


@query("""
    WITH s AS (SELECT abs(quality - least(n_chars / 2000.0, 1)) AS s FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) AS n FROM s), k AS (SELECT n, ceil((n + 1) * 0.9)::BIGINT AS k FROM n), q AS (SELECT n, CASE WHEN k > n THEN 1.0 ELSE (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) AS i FROM s) WHERE i = k) END AS q FROM k)
    SELECT n, round(q, 6) AS q, round(CASE WHEN n < 10 THEN 0.7 ELSE greatest(0.5, least(1.0, 1 - q)) END, 6) AS tau FROM q
""")
def conformal(spark, d):
    s = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.abs(F.col("quality") - F.least(F.col("n_chars") / 2000.0, F.lit(1.0))).alias("s"))
    return ST.conformal_threshold(cut(s), "s", 0.1).select("n", F.round("q", 6).alias("q"), F.round("tau", 6).alias("tau"))


def flows(spark: SparkSession, d: str) -> DataFrame:
    """(seg, t, flow): yearly totals by market segment, the first year an outlay."""
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy(F.col("c_mktsegment").alias("seg"), (F.year("o_orderdate") - 1992).alias("t")).agg(F.sum("o_totalprice").alias("total"))
    return y.select("seg", "t", F.when(F.col("t") <= 3, -3 * F.col("total")).otherwise(F.col("total")).alias("flow"))


FLOWS_SQL = "y AS (SELECT c_mktsegment AS seg, (year(o_orderdate) - 1992)::INT AS t, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), f AS (SELECT seg, t, CASE WHEN t <= 3 THEN -3 * total ELSE total END AS flow FROM y)"


@query(f"WITH {FLOWS_SQL} SELECT seg, round(sum(flow / pow(1.08, t)) / 1e6, 4) AS npv FROM f GROUP BY 1")
def npv(spark, d):
    return flows(spark, d).groupBy("seg").agg(F.round(ST.npv(F.col("flow"), F.col("t"), F.lit(0.08)) / 1e6, 4).alias("npv"))


@query(f"WITH {FLOWS_SQL}, s AS (SELECT unnest(['base', 'low', 'high']) AS scenario, unnest([1.0, 0.8, 1.2]) AS factor) SELECT seg, scenario, round(sum(flow * CASE WHEN flow > 0 THEN factor ELSE 1 END / pow(1.08, t)) / 1e6, 4) AS npv, sum(flow * CASE WHEN flow > 0 THEN factor ELSE 1 END / pow(1.08, t)) > 0 AS viable FROM f, s GROUP BY 1, 2")
def stress(spark, d):
    s = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(x).alias("factor")) for k, x in (("base", 1.0), ("low", 0.8), ("high", 1.2)))))
    f = flows(spark, d).withColumn("s", s).withColumn("flow", F.col("flow") * F.when(F.col("flow") > 0, F.col("s.factor")).otherwise(1.0))
    value = ST.npv(F.col("flow"), F.col("t"), F.lit(0.08))
    return f.groupBy("seg", F.col("s.scenario").alias("scenario")).agg(F.round(value / 1e6, 4).alias("npv"), (value > 0).alias("viable"))


@query()
def irr(spark, d):
    series = flows(spark, d).groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("t", "flow"))).alias("f"))

    @F.pandas_udf("double")
    def rate(f):
        return f.map(lambda rows: ST.irr([r["flow"] for r in sorted(rows, key=lambda r: r["t"])]))

    return series.select("seg", F.round(rate("f"), 9).alias("irr"))


@query("""
    SELECT l_partkey, round(CASE WHEN abs(sum(c)) < 1e-12 THEN 0 ELSE sum(v * c) / sum(c) END, 4) AS value, round(1 - product(1 - c), 6) AS confidence, round(stddev_pop(v) / abs(avg(v)), 6) AS cv
    FROM (SELECT l_partkey, l_extendedprice AS v, least(l_quantity / 100, 0.99) AS c FROM lineitem) GROUP BY 1
""")
def bayes_fusion(spark, d):
    li = t(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("v"), F.least(F.col("l_quantity") / 100, F.lit(0.99)).alias("c"))
    mean, sure = ST.fused(F.col("v"), F.col("c"))
    return li.groupBy("l_partkey").agg(F.round(mean, 4).alias("value"), F.round(sure, 6).alias("confidence"), F.round(A.variation("v"), 6).alias("cv"))


@query("SELECT round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)")
def entropy(spark, d):
    e = t(spark, d, "events")
    n = e.count()
    return e.groupBy("event_type").agg((F.count(F.lit(1)) / n).alias("p")).agg(F.round(ST.entropy(F.col("p")), 6).alias("entropy"))
