"""Vector similarity: expressions over array columns, exact top-k, IVF search, quantisation.

Distances are expressions in double. The query side of a search is a literal or a bounded set
of vectors; the corpus is never broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return summed(_zip(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-10, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(summed(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return summed(_zip(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_zip(a, b, lambda x, y: F.abs(x - y)))


def pearson(a: Column, b: Column) -> Column:
    n = F.size(a)
    mean = lambda v: summed(F.transform(v, lambda x: x.cast("double"))) / n
    less = lambda v, m: F.transform(v, lambda x: x.cast("double") - m)
    return cosine(less(a, mean(a)), less(b, mean(b)))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n < 1e-10, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / summed(e))


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def argmax(a: Column) -> Column:
    """0-based; null without values."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1)


def argmin(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)) - 1)


METRICS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {"cosine": (cosine, True), "dot": (dot, True), "pearson": (pearson, True), "euclidean": (euclidean, False), "manhattan": (manhattan, False), "chebyshev": (chebyshev, False)}


def top_k(df: DataFrame, id_col: str, vector: str, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """(id, score) of the k best, ties by id: partial top-k in each task, then one merge of k rows a task."""
    f, larger = METRICS[metric]
    scored = df.select(id_col, f(F.col(vector), literal(query)).alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    return scored.orderBy(F.desc("score") if larger else F.asc("score"), id_col).limit(max(0, k))


#: Query vectors that are collected at once; more of them take further passes over the corpus.
MAX_QUERIES = 100_000


def in_parts(queries: DataFrame) -> list[DataFrame]:
    """The queries (query_id, vector), counted and parted by hash so that no part has many more than MAX_QUERIES."""
    parts = max(1, -(-queries.count() // MAX_QUERIES))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def top_k_batch(queries: DataFrame, df: DataFrame, id_col: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows by cosine of each stated query vector.

    The queries (query_id, vector) are collected in counted parts and sent to the tasks in
    blocks; a task multiplies matrices and keeps k rows of each query, so what is shuffled is k rows
    of each query and task.
    """
    return reduce(DataFrame.unionByName, [_top_k_of(part, df, id_col, vector, k, block) for part in in_parts(queries)])


def similarities(queries: DataFrame, df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(query_id, id, score): the cosine of every stated query with every row."""

    def of(part: DataFrame) -> DataFrame:
        rows = part.collect()
        ids = np.array([r["query_id"] for r in rows], np.int64)
        q = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-10) if len(rows) else 1

        def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo in range(0, len(b), 256):
                    own = b.iloc[lo : lo + 256]
                    x = np.array(own[vector].tolist(), np.float64)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
                    for at in range(0, len(ids), 4096):
                        some = ids[at : at + 4096]
                        yield pd.DataFrame({"query_id": np.repeat(some, len(own)), id_col: np.tile(own[id_col].to_numpy(), len(some)), "score": (q[at : at + 4096] @ x.T).reshape(-1)})

        return df.select(id_col, vector).mapInPandas(scores, f"query_id long, {id_col} long, score double")

    return reduce(DataFrame.unionByName, map(of, in_parts(queries)))


def _top_k_of(queries: DataFrame, df: DataFrame, id_col: str, vector: str, k: int, block: int) -> DataFrame:
    rows = queries.orderBy("query_id").collect()
    ids = np.array([r["query_id"] for r in rows], np.int64)
    q = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-10) if len(rows) else 1

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for b in batches:
            x = np.array(b[vector].tolist(), np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
            own = b[id_col].to_numpy(np.int64)
            for lo in range(0, len(ids), block):
                for i, s in enumerate(q[lo : lo + block] @ x.T, lo):
                    score, who = np.concatenate([kept[i][0], s]), np.concatenate([kept[i][1], own])
                    first = np.lexsort((who, -score))[:k]
                    kept[i] = score[first], who[first]
        for i, (score, who) in enumerate(kept):
            yield pd.DataFrame({"query_id": ids[i], id_col: who, "score": score})

    found = df.select(id_col, vector).mapInPandas(best, f"query_id long, {id_col} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quantized(df: DataFrame, vector: str) -> DataFrame:
    """Add scale, zero and codes: each vector in 4 bits a component, code = round((x - zero) / scale)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    zero, top = F.array_min(v), F.array_max(v)
    d = df.withColumn("zero", zero).withColumn("scale", F.greatest((top - zero) / 15, F.lit(1e-10)))
    return d.withColumn("codes", F.transform(vector, lambda x: F.floor((x.cast("double") - F.col("zero")) / F.col("scale") + 0.5).cast("int")))


def dequantized(df: DataFrame) -> Column:
    return F.transform("codes", lambda c: c * F.col("scale") + F.col("zero"))


def ivf_centroids(df: DataFrame, id_col: str, vector: str, k: int = 8, rounds: int = 10) -> np.ndarray:
    """k-means by cosine: the first k vectors by id start; means of the assigned vectors follow; an empty cluster keeps its own."""
    centroids = np.array([r[vector] for r in df.orderBy(id_col).limit(k).select(vector).collect()], np.float64)
    size = centroids.shape[1] if len(centroids) else 0
    for _ in range(rounds if size else 0):
        means = assigned(df, vector, centroids).select("list", F.posexplode(vector).alias("i", "x")).groupBy("list", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).collect()  # k times the dimension
        new = centroids.copy()
        for r in means:
            new[r["list"], r["i"]] = r["x"]
        if np.allclose(new, centroids, atol=1e-12):
            break
        centroids = new
    return centroids


def assigned(df: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """Add list: the most similar centroid, ties to the lower."""
    scores = F.array(*(cosine(F.col(vector), literal(c.tolist())) for c in centroids))
    return df.withColumn("list", argmax(scores).cast("int"))


def ivf_top_k(df: DataFrame, id_col: str, vector: str, query: list[float], k: int, centroids: np.ndarray, probes: int = 2) -> DataFrame:
    """top_k among the lists of the nearest centroids. df is best stored with its list as partition column, which prunes the scan."""
    q = np.asarray(query, np.float64)
    near = np.argsort(-(centroids @ q) / np.maximum(np.linalg.norm(centroids, axis=1) * np.linalg.norm(q), 1e-10), kind="stable")[:probes]
    return top_k(assigned(df, vector, centroids).where(F.col("list").isin(near.tolist())), id_col, vector, query, k)


def ivf_top_k_batch(queries: DataFrame, df: DataFrame, id_col: str, vector: str, k: int, centroids: np.ndarray, probes: int = 2) -> DataFrame:
    """(query_id, id, score, rank): top_k_batch by way of the lists, with the same rows.

    The lists of the nearest centroids are scored first. A row of another list is at most as similar as
    the angles between query, centroid and the list's farthest row allow; lists where that reaches the
    k-th score so far are scored too. The queries are collected, as in top_k_batch. df is read three times.
    """
    rows = queries.orderBy("query_id").collect()
    ids = np.array([r["query_id"] for r in rows], np.int64)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    q = unit(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), -1)) if len(rows) else np.zeros((0, centroids.shape[-1]))
    c = unit(centroids)
    listed = assigned(df, vector, centroids).select(id_col, vector, "list")

    def scored(wanted: np.ndarray) -> DataFrame:
        """wanted: for each list and query, whether the list is scored."""

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = {}
            for b in batches:
                for n, part in b.groupby("list"):
                    own = part[id_col].to_numpy(np.int64)
                    x = unit(np.array(part[vector].tolist(), np.float64))
                    for i in np.flatnonzero(wanted[n]):
                        s, who = q[i] @ x.T, own
                        if i in kept:
                            s, who = np.concatenate([kept[i][0], s]), np.concatenate([kept[i][1], who])
                        first = np.lexsort((who, -s))[:k]
                        kept[i] = s[first], who[first]
            for i, (s, who) in kept.items():
                yield pd.DataFrame({"query_id": ids[i], id_col: who, "score": s})

        return listed.mapInPandas(best, f"query_id long, {id_col} long, score double")

    to = c @ q.T
    nearest = np.zeros(to.shape, bool)
    np.put_along_axis(nearest, np.argsort(-to, axis=0, kind="stable")[:probes], True, axis=0)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    found = scored(nearest)
    ranked = found.withColumn("rank", F.row_number().over(w))
    at = dict(ranked.where(F.col("rank") == k).select("query_id", "score").collect())
    least = np.array([at.get(i, -2.0) for i in ids.tolist()])
    own = F.array_max(F.array(*(cosine(F.col(vector), literal(x.tolist())) for x in centroids)))
    wide = {r["list"]: r["far"] for r in listed.groupBy("list").agg(F.min(own).alias("far")).collect()}
    radius = np.arccos(np.clip([wide.get(n, 1.0) for n in range(len(c))], -1, 1))[:, None]
    bound = np.cos(np.maximum(0, np.arccos(np.clip(to, -1, 1)) - radius))
    more = scored(~nearest & (bound >= least - 1e-6))
    return found.unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def threshold_matches(df: DataFrame, id_col: str, vector: str, query: list[float], least: float, k: int) -> DataFrame:
    return top_k(df, id_col, vector, query, k).where(F.col("score") >= least)


#: Values of the vectors that are sent to every task, and edges that are dealt to one.
MAX_VALUES, EDGES_A_TASK = 1 << 23, 200_000


def pooled(edges: DataFrame, src: str, dst: str, weight: str, vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(src, pooled): the weighted mean of the neighbours' vectors, by place.

    Edges are dealt by source and meet the vectors there, where these are counted to be at most
    MAX_VALUES values; else edges are shuffled with their vectors. A task sorts its edges and adds
    vectors up source by source, so that no row is made of a place and no task holds a source's edges.
    A null place adds nothing, but its edge's weight counts; places without any value are null. Null
    weights do not count, and null vectors are none.
    """
    found = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias(dst), F.col(vector).cast("array<double>").alias("_v"))
    n, width = found.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    width = width or 0
    known = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(weight).cast("double").alias("_w"))
    parts = max(1, -(-known.count() // EDGES_A_TASK))
    right = found.withColumnRenamed(dst, "_d")
    if n * width <= MAX_VALUES:
        dealt = known.repartition(parts, "_s").join(F.broadcast(right), "_d")
    else:
        dealt = known.join(right, "_d").repartition(parts, "_s")
    ordered = dealt.select("_s", "_w", "_v").sortWithinPartitions("_s")

    def rows(source: pa.Array, total: np.ndarray, weights: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = total[:, :width] / weights[:, None]
        longest = total[:, width].astype(np.int64)
        held = np.arange(width)[None, :] < longest[:, None]
        values = pa.array(mean[held], pa.float64(), mask=~seen[held])
        offsets = pa.array(np.concatenate([[0], np.cumsum(longest)]), pa.int32())
        return pa.RecordBatch.from_arrays([source, pa.ListArray.from_arrays(offsets, values)], names=[src, "pooled"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the last source so far: it may go on
        for b in batches:
            if not b.num_rows:
                continue
            s, w, v = b.column("_s"), b.column("_w"), b.column("_v")
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten()
            held = np.arange(width)[None, :] < size[:, None]
            x, has = np.zeros((len(size), width)), np.zeros((len(size), width), bool)
            x[held] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
            has[held] = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            sure = pc.is_valid(w).to_numpy(zero_copy_only=False)
            w = pc.fill_null(w, 0.0).to_numpy(zero_copy_only=False)
            x[~sure] = 0
            has &= sure[:, None]
            code = s.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.diff(code, prepend=-1))
            total = np.concatenate([np.add.reduceat(w[:, None] * x, at), np.maximum.reduceat(size, at)[:, None]], axis=1)
            weights, seen, source = np.add.reduceat(w, at), np.logical_or.reduceat(has, at), s.take(pa.array(at))
            if left is not None:
                if left[0][0].as_py() == source[0].as_py():
                    total[0, :width] += left[1][0, :width]
                    total[0, width] = max(total[0, width], left[1][0, width])
                    weights[0] += left[2][0]
                    seen[0] |= left[3][0]
                else:
                    yield rows(*left)
            if len(at) > 1:
                yield rows(source[:-1], total[:-1], weights[:-1], seen[:-1])
            left = source[-1:], total[-1:], weights[-1:], seen[-1:]
        if left is not None:
            yield rows(*left)

    kind = edges.select(src).schema[0].dataType.simpleString()
    return ordered.mapInArrow(add, f"`{src}` {kind}, pooled array<double>")


def added(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def subtracted(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def scaled(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def squared_euclidean(a: Column, b: Column) -> Column:
    return summed(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def mat_vec(matrix: DataFrame, row: str, vector: str, by: list[float]) -> DataFrame:
    """(row, y): a matrix, a row of it in each row, times a vector."""
    return matrix.select(row, dot(F.col(vector), literal(by)).alias("y"))


def with_bias(y: Column, bias: list[float], at: Column) -> Column:
    """y and the bias of its place."""
    return y + F.get(literal(bias), at.cast("int"))


def outer(a: Column, b: Column) -> Column:
    """Rows of the outer product."""
    return F.transform(a, lambda x: F.transform(b, lambda y: x.cast("double") * y.cast("double")))


def path_embedding(df: DataFrame, id_col: str, path: str, size: int = 64) -> DataFrame:
    """(id, embedding): FNV-1a of each segment picks a place, earlier segments weigh more (1, 1/2, ...), of length 1."""
    from sparkloom.operators.text import fnv1a

    @F.pandas_udf("array<double>")
    def embed(paths: pd.Series) -> pd.Series:
        def one(p: str) -> list[float]:
            v = np.zeros(size)
            for i, segment in enumerate(p.split("/")):
                v[fnv1a(segment.encode()) % size] += 1 / (i + 1)
            return (v / max(np.linalg.norm(v), 1e-10)).tolist()

        return paths.map(one)

    return df.select(id_col, embed(F.coalesce(F.col(path), F.lit(""))).alias("embedding"))


def attention(edges: DataFrame, src: str, weight: str) -> DataFrame:
    """Add share: an edge's part of its source's weight; 0 where that has none."""
    total = edges.groupBy(src).agg(F.sum(weight).alias("_t"))
    return edges.join(total, src).withColumn("share", F.when(F.abs("_t") < 1e-12, F.lit(0.0)).otherwise(F.col(weight) / F.col("_t"))).drop("_t")
