"""Statistics, calibration and finance as grouped expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.rounds import cut

#: Normal quantiles by confidence.
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def wilson_lower(ok: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 without trials."""
    p = ok / n
    return F.when(n > 0, F.greatest(F.lit(0.0), (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))).otherwise(F.lit(0.0))


def wilson_upper(ok: Column, n: Column, z: float = 1.96) -> Column:
    p = ok / n
    return F.when(n > 0, F.least(F.lit(1.0), (p + z * z / (2 * n) + z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n))).otherwise(F.lit(1.0))


def ks(df: DataFrame, x: str, second: Column) -> DataFrame:
    """(d, n1, n2): the largest distance of the two samples' distribution functions.

    Equal values are first combined; the running counts are windows over ranges of values, each
    range starting from the counts of the ranges below it, so no task sorts a whole sample.
    """
    one = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.sum((~second).cast("long")).alias("a"), F.sum(second.cast("long")).alias("b"))
    ranged = one.repartitionByRange("x").withColumn("_p", F.spark_partition_id())
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = ranged.groupBy("_p").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b")).select("_p", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_a0"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    total = one.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    upto = Window.partitionBy("_p").orderBy("x")
    run = ranged.select("_p", "x", F.sum("a").over(upto).alias("ra"), F.sum("b").over(upto).alias("rb")).join(base, "_p").crossJoin(total)  # total is one row
    return run.groupBy("n1", "n2").agg(F.max(F.abs((F.col("ra") + F.col("_a0")) / F.col("n1") - (F.col("rb") + F.col("_b0")) / F.col("n2"))).alias("d")).select("d", "n1", "n2")


def ks_critical(n1: int, n2: int, alpha: float) -> float:
    return math.sqrt(-math.log(alpha / 2) / 2) * math.sqrt((n1 + n2) / (n1 * n2))


def js_distance(df: DataFrame, bucket: str, p: str, q: str, epsilon: float = 1e-12) -> DataFrame:
    """(js): the root of the Jensen-Shannon divergence, natural logarithm, of two histograms in columns p and q."""
    total = df.agg(F.sum(p).alias("_p"), F.sum(q).alias("_q"))
    d = df.crossJoin(total).select((F.col(p) / F.col("_p")).alias("p"), (F.col(q) / F.col("_q")).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)  # total is one row
    term = lambda a: F.when(F.col(a) > epsilon, F.col(a) * F.log(F.col(a) / F.col("m"))).otherwise(F.lit(0.0))
    return d.agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(term("p") + term("q")) / 2)).alias("js"))


def fused(value: Column, confidence: Column) -> tuple[Column, Column]:
    """Aggregates: the confidence-weighted mean, and 1 - prod(1 - confidence)."""
    total = F.sum(confidence)
    mean = F.when(F.abs(total) < 1e-12, F.lit(0.0)).otherwise(F.sum(value * confidence) / total)
    return mean, 1 - F.product(1 - confidence)


def nth_smallest(df: DataFrame, x: str, k: int) -> float | None:
    """The k-th smallest value: values are counted, ranges of values are summed, and only the range that holds the rank is sorted."""
    one = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(one.repartitionByRange("x").withColumn("_p", F.spark_partition_id()))
    before = 0
    for r in ranged.groupBy("_p").agg(F.sum("n").alias("n")).orderBy("_p").collect():  # one row for each range
        if before + r["n"] >= k:
            upto = F.sum("n").over(Window.orderBy("x"))
            return ranged.where(F.col("_p") == r["_p"]).withColumn("upto", upto).where(F.col("upto") >= k - before).agg(F.min("x")).first()[0]
        before += r["n"]
    return None


def conformal_threshold(df: DataFrame, score: str, alpha: float, least: int = 10) -> DataFrame:
    """(n, q, tau): q is the ceil((n + 1)(1 - alpha))-th smallest score, 1 where that rank exceeds n and 0 at rank 0; tau is 1 - q within 0.5 and 1, 0.7 below least rows."""
    n = df.where(F.col(score).isNotNull()).count()
    k = math.ceil((n + 1) * (1 - alpha))
    q = None if not n else 0.0 if k <= 0 else 1.0 if k > n else nth_smallest(df, score, k)
    tau = 0.7 if n < least else min(1.0, max(0.5, 1 - q))
    return df.sparkSession.createDataFrame([(n, q, tau)], "n long, q double, tau double")


def npv(flow: Column, t: Column, rate: Column) -> Column:
    """Aggregate: sum flow / (1 + rate)^t."""
    return F.sum(flow / F.pow(1 + rate, t))


def irr(flows: list[float], guess: float = 0.1, tolerance: float = 1e-9, steps: int = 200) -> float | None:
    """Newton's method on one series; None without a change of sign or without convergence."""
    if not (any(f > 0 for f in flows) and any(f < 0 for f in flows)):
        return None
    r = guess
    for _ in range(steps):
        value = sum(f / (1 + r) ** t for t, f in enumerate(flows))
        change = sum(-t * f / (1 + r) ** (t + 1) for t, f in enumerate(flows))
        if change == 0:
            return None
        new = r - value / change
        if new <= -1:
            return None
        if abs(new - r) < tolerance:
            return new
        r = new
    return None


def entropy(p: Column) -> Column:
    """Aggregate over shares: -sum p ln p."""
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)))
