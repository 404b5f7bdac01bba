"""Structured Streaming: projections of events, deduplication, index upkeep, incremental skips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def entity_counts(events: DataFrame, entity: str = "entity", action: str = "action") -> DataFrame:
    """Running counts by entity and action; update or complete mode."""
    return events.groupBy(entity, action).agg(F.count(F.lit(1)).alias("n"))


def windowed_rate(events: DataFrame, ts: str, key: str, bad: F.Column, late: str = "10 minutes", size: str = "5 minutes", step: str | None = None) -> DataFrame:
    """(window, key, n, rate) of event-time windows; later rows than the watermark allows are left out."""
    w = F.window(ts, size, step) if step else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("window"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(bad.cast("double")).alias("rate"))


def once(events: DataFrame, key: str, ts: str, ttl: str = "1 hour") -> DataFrame:
    """The first event of each key within a time to live."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def micro_batches(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds") -> DataStreamWriter:
    """Batches go to write(batch, number); a number that comes again after a failure must replace its former write."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def upsert_postings(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that keeps one row a key: each batch is a numbered folder, read back with the highest batch winning."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/part={number}")

    return write


def current_postings(parts: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in parts.columns if c not in (*keys, "batch", "part")]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def fingerprints(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fingerprint): one number for a key's rows, whatever their order; repeats count."""
    h = F.xxhash64(*columns)
    several = (F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.count(F.lit(1)))  # of these, only xor loses equal rows
    return rows.groupBy(key).agg(F.xxhash64(*several).alias("fingerprint"))


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose fingerprint is new or other than before."""
    return new.join(old.withColumnRenamed("fingerprint", "_old"), key, "left").where(~F.col("fingerprint").eqNullSafe(F.col("_old"))).select(key, "fingerprint")
