"""An append-only event log as JSON lines, with a hash on each event.

seq is given by the producer, or by append() after the highest seq of the log; the hash covers
all other columns in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts", T.StringType()), T.StructField("actor", T.StringType()), T.StructField("action", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("hash", T.StringType())])
HASHED = ["seq", "ts", "actor", "action", "entity", "payload"]


def hash_of() -> Column:
    return F.sha2(F.to_json(F.struct(*HASHED), {"ignoreNullFields": "false"}), 256)


def sealed(events: DataFrame) -> DataFrame:
    """The events with their hash."""
    return events.select(*HASHED).withColumn("hash", hash_of())


def append(events: DataFrame, folder: str, after: int = 0) -> None:
    """Write events (without seq) after the given seq, in order of ts, actor, action and entity."""
    ordered = events.repartitionByRange("ts", "actor", "action", "entity").withColumn("_p", F.spark_partition_id())
    inner = Window.partitionBy("_p").orderBy("ts", "actor", "action", "entity", "payload")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = ordered.withColumn("_r", F.row_number().over(inner)).join(counts, "_p").withColumn("seq", (F.col("_r") + F.col("_base") + after).cast("long"))
    sealed(numbered).write.mode("append").json(folder)


def replay(spark: SparkSession, folder: str, from_seq: int = 0) -> DataFrame:
    return spark.read.schema(SCHEMA).json(folder).where(F.col("seq") >= from_seq)


def verify(events: DataFrame) -> DataFrame:
    """(seq, ok) of each event."""
    return events.select("seq", F.coalesce(F.col("hash") == hash_of(), F.lit(False)).alias("ok"))


def first_error(events: DataFrame) -> DataFrame:
    return verify(events).where("NOT ok").orderBy("seq").limit(1)


def read_since(events: DataFrame, seq: int, action: str | None, limit: int) -> DataFrame:
    """A cursor's next page."""
    found = events.where(F.col("seq") > seq)
    return (found if action is None else found.where(F.col("action") == action)).orderBy("seq").limit(limit)
