"""Functions for Spark SQL. They are SQL expressions, which the optimizer inlines; one line of Python runs only where no expression exists."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparkloom.operators.stats import irr
from sparkloom.operators.text import fnv1a

DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
NORM = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"

#: By name: parameters, result, expression.
EXPRESSIONS = {
    "cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN {NORM.format('a')} * {NORM.format('b')} < 1e-10 THEN 0D ELSE {DOT} / ({NORM.format('a')} * {NORM.format('b')}) END"),
    "dot_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", DOT),
    "euclidean_distance": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "wilson_lower": ("ok DOUBLE, n DOUBLE", "DOUBLE", "CASE WHEN n > 0 THEN greatest(0D, (ok / n + 3.8416D / (2 * n) - 1.96D * sqrt((ok / n * (1 - ok / n) + 3.8416D / (4 * n)) / n)) / (1 + 3.8416D / n)) ELSE 0D END"),
    "wilson_upper": ("ok DOUBLE, n DOUBLE", "DOUBLE", "CASE WHEN n > 0 THEN least(1D, (ok / n + 3.8416D / (2 * n) + 1.96D * sqrt((ok / n * (1 - ok / n) + 3.8416D / (4 * n)) / n)) / (1 + 3.8416D / n)) ELSE 1D END"),
    "half_life": ("age DOUBLE, half DOUBLE", "DOUBLE", "pow(0.5D, age / half)"),
    "npv": ("flows ARRAY<DOUBLE>, rate DOUBLE", "DOUBLE", "aggregate(transform(flows, (x, i) -> x / pow(1 + rate, i)), 0D, (s, x) -> s + x)"),
    "edit_distance": ("a STRING, b STRING", "INT", "levenshtein(lower(a), lower(b))"),
    "jaccard_similarity": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, (parameters, result, expression) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    spark.udf.register("irr", lambda flows: irr(list(flows)) if flows is not None else None, "double")
    spark.udf.register("fnv1a", lambda s: None if s is None else fnv1a(s.encode()) - (1 << 64 if fnv1a(s.encode()) >> 63 else 0), "bigint")
    return [*EXPRESSIONS, "irr", "fnv1a"]
