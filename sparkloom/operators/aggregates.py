"""Grouped statistics: rates, decay, histograms, concentration, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def rate(ok: Column) -> Column:
    """Share of true rows; 1 without rows."""
    return F.coalesce(F.avg(ok.cast("double")), F.lit(1.0))


def daily_rate(df: DataFrame, ts: str, bad: Column, days: int) -> DataFrame:
    """(day, n, rate) of the last days that have rows, ascending."""
    d = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg(bad.cast("double")).alias("rate"))
    return d.orderBy(F.desc("day")).limit(days).orderBy("day")


def decayed(df: DataFrame, keys: list[str], age: Column, half_life: float) -> DataFrame:
    """(keys, weight, n): the sum of 2^(-age / half_life)."""
    return df.groupBy(*keys).agg(F.sum(F.exp(-LN2 * age / half_life)).alias("weight"), F.count(F.lit(1)).alias("n"))


def slope(x: str, y: str) -> Column:
    """Least-squares slope; null below two points or without spread."""
    return F.regr_slope(F.col(y), F.col(x))


def gini(df: DataFrame, key: str, x: str) -> DataFrame:
    """(key, gini) = sum (2 i - n - 1) x_i / (n sum x) over ascending x; 0 for one row or no positive sum."""
    w = Window.partitionBy(key).orderBy(x)
    d = df.where(F.col(x).isNotNull()).withColumn("_i", F.row_number().over(w))
    n, total = F.count(F.lit(1)), F.sum(x)
    weighted = F.sum((2 * F.col("_i")) * F.col(x)) - (n + 1) * total
    return d.groupBy(key).agg(F.when((n <= 1) | (total <= 0), F.lit(0.0)).otherwise(weighted / (n * total)).alias("gini"))


def geometric_mean(*parts: Column, floor: float = 0.01) -> Column:
    product = F.lit(1.0)
    for p in parts:
        product = product * F.greatest(p, F.lit(floor))
    return F.pow(product, 1.0 / len(parts))


def projection(df: DataFrame, entity: str, action: str, seq: str) -> DataFrame:
    """(entity, n, first_seq, last_seq, actions): counts of each action as a map, summed in two steps."""
    per = df.groupBy(entity, action).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("lo"), F.max(seq).alias("hi"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(action), F.lit("")).alias("k"), F.col("n").alias("v")))))
    return per.groupBy(entity).agg(F.sum("n").alias("n"), F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"), counts.alias("actions"))


def latencies(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, total, p50, p90, p99, p999), linear percentiles."""
    share = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    return df.groupBy(label).agg(F.count(value).alias("n"), F.sum(value).alias("total"), *(F.percentile(value, p).alias(k) for k, p in share.items()))


def weighted_mean(value: Column, weight: Column) -> Column:
    total = F.sum(weight)
    return F.when(F.abs(total) < 1e-12, F.lit(0.0)).otherwise(F.sum(value * weight) / total)


def variation(x: str) -> Column:
    """Population standard deviation over the absolute mean."""
    return F.stddev_pop(x) / F.abs(F.avg(x))
