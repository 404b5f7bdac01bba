"""Folders of files as tables: walks by extension, content hashes, moves, checkpoints, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scalars import glob_regex


def walk(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(path, length, modificationTime, content) of files with one of the extensions, at any depth."""
    wanted = "{" + ",".join(extensions) + "}" if len(extensions) > 1 else extensions[0]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{wanted}").load(folder)


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("hash"))


def glob(paths: DataFrame, pattern: str) -> DataFrame:
    return paths.where(F.col("path").rlike(glob_regex(pattern)))


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, old_path, new_path) by content hash: moved, duplicate (the old path is still there), new, or gone."""
    o = old.groupBy("hash").agg(F.min("path").alias("old_path"))
    fresh = new.join(old.select("path", "hash"), ["path", "hash"], "left_anti")
    still = new.join(old.select("path", "hash"), ["path", "hash"], "left_semi").select("hash").distinct().withColumn("still", F.lit(True))
    j = fresh.select("hash", F.col("path").alias("new_path")).join(o, "hash", "left").join(still, "hash", "left")
    kind = F.when(F.col("old_path").isNull(), "new").when(F.col("still"), "duplicate").otherwise("moved")
    gone = old.join(new.select("hash").distinct(), "hash", "left_anti").select(F.lit("gone").alias("kind"), F.col("path").alias("old_path"), F.lit(None).cast("string").alias("new_path"))
    return j.select(kind.alias("kind"), "old_path", "new_path").unionByName(gone)


def overlaid(base: DataFrame, overlay: DataFrame, key: str, value: str) -> DataFrame:
    """The overlay's value wins; keys of both."""
    j = base.select(key, F.col(value).alias("_base")).join(overlay.select(key, F.col(value).alias("_over")), key, "full")
    return j.select(key, F.coalesce("_over", "_base").alias(value))


def latest(spark: SparkSession, folder: str, pattern: str = r"(\d+)") -> DataFrame:
    """(path, stamp, value) of the text file whose name has the highest number."""
    files = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    stamp = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1).cast("long")
    return files.withColumn("stamp", stamp).orderBy(F.desc("stamp"), "path").limit(1).select("path", "stamp", "value")


def list_dir(paths: DataFrame, folder: str) -> DataFrame:
    """Paths below a folder, at any depth."""
    return paths.where(F.startswith("path", F.lit(folder.rstrip("/") + "/")))


def load_all(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(path, value): every JSON file of a folder parsed with the schema; what does not parse has a null value."""
    files = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", F.from_json("value", schema).alias("value"))


def symbol_documents(symbols: DataFrame, file: str, name: str, kind: str, line: str) -> DataFrame:
    """(file, document): each file's symbols as one JSON text, in order of line and name; a file's symbols fit a row."""
    one = F.struct(F.col(line).alias("line"), F.col(name).alias("name"), F.col(kind).alias("kind"))
    return symbols.groupBy(file).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("document"))
