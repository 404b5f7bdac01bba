"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of text that Python works on at once. Spark itself bounds an Arrow batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
BATCH_ROWS, BATCH_BYTES = 2048, 6 << 20


#: What operators keep in a worker process from task to task.
_KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    """A cache of a worker process that outlives tasks; let_go empties it."""
    _KEPT.append(cache)
    return cache


def let_go() -> None:
    """In a task that needs none of the kept caches: give their memory back. Workers go from one operator's tasks to another's."""
    held = [c for c in _KEPT if c]
    if not held:
        return
    for c in held:
        c.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where unset, a temporary one in local mode, as in tests, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def buckets_for(rows: int) -> int:
    """Buckets to number so many rows in: about a million rows each, 256 at least."""
    return max(256, -(-rows // 1_000_000))


def bucket_of(uid: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("int")


def numbered(df: DataFrame, keys: list[str], uid: str, out: str, buckets: int) -> DataFrame:
    """Add out: numbers 0, 1, ... without gaps among rows of equal keys, fixed by uid (unique in each key).

    A key's rows are dealt over buckets by uid and numbered there; the buckets' counts,
    summed in order, shift the numbers, so that no task holds a whole key. df is read twice: stage it.
    """
    b = df.withColumn("_b", bucket_of(F.col(uid), buckets))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(*keys, "_b").orderBy(uid)
    ranked = b.withColumn("_r", F.row_number().over(inner) - 1)
    return ranked.join(shift, [*keys, "_b"]).withColumn(out, (F.col("_r") + F.col("_shift")).cast("long")).drop("_b", "_r", "_shift")


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values as bytes; null is empty."""
    return [x or b"" for x in batch.column(column).to_pylist()]


def arrow_rows(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches to BATCH_ROWS rows and, but for a single row, BATCH_BYTES bytes of the column."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            base = upto[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + BATCH_ROWS, int(np.searchsorted(upto, base + BATCH_BYTES, "right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that Python gets, the text as UTF-8 bytes."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


#: Ids that may be broadcast: 8 bytes each.
MAX_BROADCAST_IDS = 500_000


def bounded(ids: DataFrame) -> DataFrame:
    """Staged ids with a broadcast hint if they are counted to be at most MAX_BROADCAST_IDS; else they meet the documents by a shuffled join."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def key_of(text: Column) -> Column:
    """A text's name among those of one id: two 64-bit hashes."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def first_of(id_col: str = "doc_id", row: str = "row") -> Column:
    """Aggregate: the row with the smallest id (none: only where all lack one), of equal ids the one with the smallest row number."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc_id"), F.col(row).alias("row")))


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs without the rows that are decided to go; decided: staged, one row for each document with doc_id, name (key_of its text) and kept.

    Ids of one row are settled by id alone: those that go are counted and, as far as they are few,
    broadcast, so that no text is shuffled. Rows that share their id (or have none) are settled by id and text.
    """
    per = stage(decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("n > 1 OR NOT kept"), "settled")
    left = bounded(per.select(F.col("doc_id").alias("_gone")))
    alone = docs.join(left, docs["doc_id"].eqNullSafe(left["_gone"]), "left_anti")
    many = per.where("n > 1").select(F.col("doc_id").alias("_many"))
    if many.isEmpty():
        return alone
    many = bounded(many)
    wanted = decided.where("kept").join(many, decided["doc_id"].eqNullSafe(many["_many"]), "left_semi").select(F.col("doc_id").alias("_id"), F.col("name").alias("_name")).distinct()
    rows = docs.join(many, docs["doc_id"].eqNullSafe(many["_many"]), "left_semi").select(F.struct(*docs.columns).alias("r"), F.col("doc_id").cast("long").alias("id"), key_of(F.col("text")).alias("name"))
    rows = rows.join(wanted, rows["id"].eqNullSafe(wanted["_id"]) & (rows["name"] == wanted["_name"]), "left_semi")
    one = rows.groupBy("id", "name").agg(F.first("r").alias("r")).select("r.*")  # rows of one id and text are repeats
    return alone.unionByName(one.select(*docs.columns))
