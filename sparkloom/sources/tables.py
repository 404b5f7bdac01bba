"""Log tables by name: their columns, empty tables, rows brought to the columns of today, typed appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the log tables; new ones are only ever added at the end.
TABLES = {
    "bash_outcomes": "id long, command string, command_short string, exit_code int, success int, error_pattern string, file_context string, executed_at timestamp, command_hash string",
    "edit_history": "id long, file_path string, edit_type string, summary string, error_pattern string, language string, symbol_context string, session_id string, edited_at timestamp",
    "file_access_log": "id long, file_path string, session_id string, accessed_at timestamp",
    "file_coedits": "source_path string, target_path string, coedit_count long, last_coedit_at timestamp",
    "learning_drift": "metric_name string, value double, window_id long, recorded_at timestamp",
    "learning_tool_outcomes": "tool_name string, file_path string, success int, latency_ms long, context_json string, recorded_at timestamp",
    "symbol_events": "sequence_id string, file_path string, content_hash string, operation string, symbol string, recorded_at timestamp",
    "benchmark_runs": "commit_hash string, bench_name string, p50_ms double, p95_ms double, p99_ms double, samples long, recorded_at timestamp",
    "task_metrics": "task_id string, metric string, value double, recorded_at timestamp",
}


def ensure(spark: SparkSession, name: str) -> DataFrame:
    """An empty table with its columns."""
    return spark.createDataFrame([], TABLES[name])


def migrated(df: DataFrame, name: str) -> DataFrame:
    """The rows with the columns of today: missing ones are null, known ones take their type, unknown ones go."""
    wanted = ensure(df.sparkSession, name).schema
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def record(df: DataFrame, name: str, folder: str) -> None:
    """Append rows of a log table."""
    migrated(df, name).write.mode("append").parquet(f"{folder}/{name}")


def load(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """All rows of a log table, whichever columns their files were written with."""
    return migrated(spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}"), name)
