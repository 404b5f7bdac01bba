"""Searches over all that their tables hold."""

from pyspark.sql import functions as F

from sparkloom.operators import vectors as V
from sparkloom.plans import QUERIES, search

FOLDER = "/root/testdata/sf0.001"


def test_ivf_topk_recall(spark):
    """The registered query against brute force."""
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["ivf_topk"](spark, FOLDER).collect()}
    want = {(r["query_id"], r["vec_id"]) for r in V.top_k_batch(search.every_twentieth(e), e, "vec_id", "embedding", search.TOP).collect()}
    assert {q for q, _ in got} == {r[0] for r in e.where("vec_id % 20 = 0").select("vec_id").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_ivf_bound_skips_nothing(spark):
    """Clusters, a vector without length and fewer rows than k."""
    rows = [(i, [1.0 * (i % 4 == j) + 0.01 * ((i * (j + 3)) % 7) for j in range(4)]) for i in range(40)] + [(40, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    for k in (1, 7, 60):
        key = lambda r: (r["query_id"], r["rank"], round(r["score"], 9))
        assert sorted(map(key, V.ivf_top_k_batch(q, df, "id", "v", k, V.ivf_centroids(df, "id", "v", 4), probes=1).collect())) == sorted(map(key, V.top_k_batch(q, df, "id", "v", k).collect()))


def test_pairwise_topk_all_queries(spark):
    rows = QUERIES["pairwise_topk_all"](spark, FOLDER).collect()
    assert {r["query_id"] for r in rows} == set(range(0, 500, 20)) and len(rows) == 25 * 5


def test_pooled_neighbours_of_all_orders(spark):
    orders = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["pooled_neighbours_all"](spark, FOLDER).count() == orders > 1000
