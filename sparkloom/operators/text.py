"""Text search and ranking: token tables, TF-IDF, BM25, rank fusion, edit distance, duplication."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.rounds import cut

K1, B, PARTIAL = 1.2, 0.75, 0.5
RRF_K = 60


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters, digits and underscores of two bytes or more."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), "[^\\p{L}\\p{N}_]+"), lambda w: F.octet_length(w) >= 2)


def postings(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, token, tf, length): one shuffle by id and token, with counts combined before it."""
    t = df.select(id_col, tokens(text).alias("_t"))
    return t.select(id_col, F.size("_t").alias("length"), F.explode("_t").alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def tfidf(posted: DataFrame, id_col: str, n: int) -> DataFrame:
    """Add tfidf = tf (ln(n / df) + 1)."""
    df = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return posted.join(df, "token").withColumn("tfidf", F.col("tf") * (F.log(F.lit(float(n)) / F.col("df")) + 1))


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def hashed_embedding(weights: DataFrame, id_col: str, weight: str, size: int = 128) -> DataFrame:
    """(id, embedding): weights hashed by FNV-1a into size buckets, negative where hash / size is odd, of length 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["token"].drop_duplicates()
            h = b["token"].map(dict(zip(own, (fnv1a(t.encode()) for t in own)))).to_numpy(np.uint64)
            sign = np.where(h // np.uint64(size) % np.uint64(2), -1.0, 1.0)
            yield pd.DataFrame({id_col: b[id_col], "i": (h % np.uint64(size)).astype(np.int32), "x": sign * b[weight].to_numpy()})

    kind = dict(weights.dtypes)[id_col]
    summed = weights.select(id_col, "token", weight).mapInPandas(run, f"{id_col} {kind}, i int, x double").groupBy(id_col, "i").agg(F.sum("x").alias("x"))
    cells = F.map_from_entries(F.collect_list(F.struct("i", "x")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0)))
    d = summed.groupBy(id_col).agg(cells.alias("m")).select(id_col, dense.alias("v"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return d.select(id_col, F.when(n < 1e-10, F.col("v")).otherwise(F.transform("v", lambda x: x / n)).alias("embedding"))


#: White space as Unicode has it.
WHITE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def term_counts(df: DataFrame, id_col: str, text: str, terms: list[str]) -> DataFrame:
    """(id, n, tf): words parted by white space, and each term's count among them, or half where it only stands within a word.

    The texts are split once: what is written is numbers, which scores and averages are made from.
    """
    low = df.select(id_col, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    split = F.struct(F.array_remove(F.split("low", WHITE), "").alias("w"), F.col("low"))
    d = low.select(id_col, F.explode(F.array(split)).alias("t")).select(id_col, "t.w", "t.low")  # a generated row is not computed again by each use
    whole = lambda t: F.size("w") - F.size(F.array_remove("w", t))
    tf = [F.when(whole(t) > 0, whole(t).cast("double")).when(F.contains("low", F.lit(t)), F.lit(PARTIAL)).otherwise(F.lit(0.0)) for t in terms]
    return cut(d.select(id_col, F.size("w").alias("n"), F.array(*tf).cast("array<double>").alias("tf")))


def bm25_of(counted: DataFrame, id_col: str, average: Column) -> DataFrame:
    """(id, score) of term_counts() against an average length; without inverse document frequency."""
    length = K1 * (1 - B + B * F.col("n") / average)
    score = F.aggregate("tf", F.lit(0.0), lambda a, f: a + F.when(f > 0, f * (K1 + 1) / (f + length)).otherwise(F.lit(0.0)))
    return counted.select(id_col, F.when(average > 0, score).otherwise(F.lit(0.0)).alias("score"))


def bm25(df: DataFrame, id_col: str, text: str, query: str, average: float | None = None) -> DataFrame:
    """(id, score) of the rows with a query term, the average length counted over all rows if it is not given."""
    counted = term_counts(df, id_col, text, query_terms(query))
    if average is None:
        average = float(counted.agg(F.avg("n")).first()[0] or 1.0)
    return bm25_of(counted, id_col, F.lit(average)).where("score > 0")


def bm25_bucketed(df: DataFrame, id_col: str, text: str, query: str) -> DataFrame:
    """(id, bucket, score): the average length is that of the row's bucket: 25 below 50 words, 100 below 200, else 350."""
    counted = term_counts(df, id_col, text, query_terms(query))
    average = F.when(F.col("n") < 50, 25.0).when(F.col("n") < 200, 100.0).otherwise(350.0)
    bucket = F.when(F.col("n") < 50, "short").when(F.col("n") < 200, "medium").otherwise("long")
    return bm25_of(counted, id_col, average).join(counted.select(id_col, bucket.alias("bucket")), id_col).where("score > 0")


def ranked(scores: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, score, rank) of the first k, ties by id."""
    top = scores.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # at most k rows


def rrf(lists: list[tuple[DataFrame, float]], id_col: str, k: int = RRF_K) -> DataFrame:
    """(id, score): weighted reciprocal rank fusion, sum of weight / (k + rank); rank 0 gives nothing."""
    each = [d.select(id_col, F.when(F.col("rank") > 0, F.lit(float(w)) / (k + F.col("rank"))).otherwise(F.lit(0.0)).alias("part")) for d, w in lists]
    return reduce(DataFrame.unionByName, each).groupBy(id_col).agg(F.sum("part").alias("score"))


def fuzzy(terms: DataFrame, term: str, query: str, most: int) -> DataFrame:
    """Terms within an edit distance of the query, without regard to case."""
    return terms.withColumn("distance", F.levenshtein(F.lower(term), F.lit(query.lower()))).where(F.col("distance") <= most)


def suggest(terms: DataFrame, term: str, prefix: str, k: int) -> DataFrame:
    """Distinct terms that begin with the prefix, without regard to case, the first k."""
    return terms.select(term).where(F.startswith(F.lower(term), F.lit(prefix.lower()))).distinct().orderBy(term).limit(k)


def jaccard(a: Column, b: Column) -> Column:
    """Of sets: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def duplicate_lines(df: DataFrame, id_col: str, text: str, size: int = 6) -> DataFrame:
    """(id, lines, duplicated, blocks, ratio) of each text: lines in blocks of size lines that the text repeats.

    Lines count by their words; empty lines and lines of brackets, semicolons and commas alone do
    not count. A block repeats if it stands twice without overlap, which is where its last place is
    at least size lines behind its first; then all its places are duplicated.
    """
    words = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, WHITE, " ")))
    lines = df.select(id_col, F.explode(F.array(F.struct(F.filter(words, lambda x: ~x.rlike("^[{}()\\[\\];, ]*$")).alias("l")))).alias("t")).select(id_col, "t.l")
    block = lambda i: F.sha2(F.concat_ws("\n", F.slice("l", i, size)), 256)
    starts = F.when(F.size("l") >= size, F.transform(F.sequence(F.lit(1), F.size("l") - size + 1), lambda i: F.struct(i.alias("at"), block(i).alias("h"))))
    blocks = lines.select(id_col, F.explode(starts).alias("b")).select(id_col, "b.at", "b.h")
    met = blocks.groupBy(id_col, "h").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).where(F.col("hi") - F.col("lo") >= size)
    hit = blocks.join(met.select(id_col, "h"), [id_col, "h"])
    covered = hit.select(id_col, F.explode(F.sequence("at", F.col("at") + size - 1)).alias("line")).distinct().groupBy(id_col).agg(F.count(F.lit(1)).alias("duplicated"))
    each = lines.select(id_col, F.size("l").cast("long").alias("lines")).join(covered, id_col, "left").join(met.groupBy(id_col).agg(F.count(F.lit(1)).alias("blocks")), id_col, "left")
    duplicated = F.coalesce("duplicated", F.lit(0))
    return each.select(id_col, "lines", duplicated.alias("duplicated"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.when(F.col("lines") > 0, duplicated / F.col("lines")).otherwise(F.lit(0.0)).alias("ratio"))


def inverted_index(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(token, id, line, n): lower-cased tokens by 1-based line."""
    lines = df.select(id_col, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    return lines.select(id_col, (F.col("_i") + 1).alias("line"), F.explode(tokens("_line")).alias("token")).groupBy("token", id_col, "line").agg(F.count(F.lit(1)).alias("n"))


def rrf_decayed(lists: list[tuple[DataFrame, float, int]], id_col: str, decay: float, k: int = RRF_K) -> DataFrame:
    """rrf() with each list's weight times decay to the power of its age."""
    return rrf([(d, w * decay**age) for d, w, age in lists], id_col, k)


def rrf_normalized(lists: list[DataFrame], id_col: str, k: int = RRF_K) -> DataFrame:
    """rrf() with even weights that sum to 1."""
    return rrf([(d, 1.0 / len(lists)) for d in lists], id_col, k)


def all_terms(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows that have every term of the query, parted at other than word characters, as a word of one of the columns; no terms find nothing."""
    import re

    terms = [w for w in re.split(r"\W+", query.lower()) if w]
    words = F.split(F.lower(F.concat_ws(" ", *columns)), "[^\\p{L}\\p{N}_]+")
    return df.where(reduce(lambda a, t: a & F.array_contains(words, t), terms, F.lit(bool(terms))))


def command_states(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, states): FNV-1a of each word, in order."""

    @F.pandas_udf("array<long>")
    def states(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.array([fnv1a(w.encode()) for w in t.split()], np.uint64).view(np.int64).tolist())

    return df.select(id_col, states(F.coalesce(F.col(text), F.lit(""))).alias("states"))


def context_before(text: Column, start: Column, size: int = 50) -> Column:
    """The characters before a place (0-based), at most size of them, without white space around."""
    lo = F.greatest(start - size, F.lit(0))
    return F.trim(F.substring(text, (lo + 1).cast("int"), (start - lo).cast("int")))
