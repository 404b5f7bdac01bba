"""Lookups, joins, upserts and grouped reports.

Everything is a plan of built-in operators; sides are never hinted to be broadcast, so that
the adaptive planner decides by measured size. Missing values in keys follow SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.rounds import cut


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value))


def upsert(base: DataFrame, changes: DataFrame, key: str, counter: str, order: str) -> DataFrame:
    """The base with changes applied: the last non-null value of each column wins, and counter adds one for each change."""
    columns = [c for c in base.columns if c not in (key, counter)]
    both = base.withColumn("_order", F.lit(None).cast("long")).withColumn("_hit", F.col(counter)).unionByName(
        changes.withColumn("_order", F.col(order).cast("long")).withColumn("_hit", F.lit(1)).select(key, *[F.col(c) if c in changes.columns else F.lit(None).cast(dict(base.dtypes)[c]).alias(c) for c in columns], F.lit(None).cast(dict(base.dtypes)[counter]).alias(counter), "_order", "_hit")
    )
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.coalesce("_order", F.lit(-(1 << 62))))).alias(c) for c in columns]
    return both.groupBy(key).agg(*latest, F.sum("_hit").alias(counter)).select(*base.columns)


def insert_or_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The base and those new rows whose key it lacks, one of each key; null keys count as empty."""
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys]
    names = [f"_{k}" for k in keys]
    fresh = new.select("*", *safe).dropDuplicates(names).join(base.select(*safe).distinct(), names, "left_anti").drop(*names)
    return base.unionByName(fresh.select(*base.columns))


def replace_group(base: DataFrame, key: str, value, new: DataFrame) -> DataFrame:
    """All rows of one key give way to the new ones."""
    return base.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(new)


def retain(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows no older than days before now."""
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))


def top_groups(df: DataFrame, key: str, k: int, out: str = "n") -> DataFrame:
    """The k keys with most rows, ties by key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), key).limit(k)


def star(fact: DataFrame, key: str, sides: list[DataFrame]) -> DataFrame:
    """Left joins of one row each on the same key."""
    return reduce(lambda a, b: a.join(b, key, "left"), sides, fact)


def without(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Rows with no partner."""
    return df.join(other.select(F.col(right).alias("_right")).where(F.col("_right").isNotNull()), F.col(left) == F.col("_right"), "left_anti")


def neighbours(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(item, other, weight) in both directions from pairs of columns a and b."""
    one = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("weight")).select(F.col(a).alias("item"), F.col(b).alias("other"), "weight")
    return one.unionByName(one.select(F.col("other").alias("item"), F.col("item").alias("other"), "weight")).groupBy("item", "other").agg(F.sum("weight").alias("weight"))


def pairs_in(df: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs (a < b) of different items of one group; groups must be small, as an order's lines are."""
    d = df.select(group, item).distinct()
    return d.select(group, F.col(item).alias("a")).join(d.select(group, F.col(item).alias("b")), group).where("a < b")


def top_within(df: DataFrame, key: str, by: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; partial limits run before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("rank") <= k)


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, before, after) for keys added, removed or changed."""
    j = before.select(key, F.col(value).alias("before"), F.lit(1).alias("_b")).join(after.select(key, F.col(value).alias("after"), F.lit(1).alias("_a")), key, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return j.withColumn("change", change).where("change IS NOT NULL").select(key, "change", "before", "after")


def violations(measures: DataFrame, rules: list[tuple[str, str, str, float, str]]) -> DataFrame:
    """measures: (path, metric, value); rules: (name, metric, operator, threshold, severity).

    A rule states what is forbidden: a row violates it if `value operator threshold` is false.
    """
    tests = {"lt": lambda v, t: v < t, "le": lambda v, t: v <= t, "gt": lambda v, t: v > t, "ge": lambda v, t: v >= t, "eq": lambda v, t: F.abs(v - t) < 2.220446049250313e-16, "ne": lambda v, t: F.abs(v - t) >= 2.220446049250313e-16}
    found = [F.when((F.col("metric") == m) & ~tests[op](F.col("value"), F.lit(float(t))), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(float(t)).alias("threshold"))) for name, m, op, t, severity in rules]
    return measures.withColumn("v", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull()))).select("path", "metric", "value", "v.rule", "v.severity", "v.threshold")


#: Bytes of patterns that one pass over the texts looks for.
PATTERN_BYTES = 32 << 20


def contains_any(texts: DataFrame, id_col: str, text: str, patterns: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(id, pattern): each text with each distinct pattern that stands in it, wherever it begins and ends.

    Distinct patterns are counted and go to the tasks in parts of about PATTERN_BYTES, one pass over
    the texts for each part; a task finds all patterns of a part at once in an automaton, so
    texts are neither copied nor shuffled. ignore_case folds ASCII letters. A null text or pattern
    meets nothing; an empty pattern stands in every text.
    """
    fold = (lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if ignore_case else (lambda c: c)
    distinct = cut(patterns.select(F.col(pattern).cast("string").alias("p"), fold(F.col(pattern).cast("string")).alias("f")).where("p IS NOT NULL").distinct())
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("f") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // PATTERN_BYTES))
    kind = dict(texts.dtypes)[id_col]
    out = None
    for i in range(parts):
        forms: dict[str, list[str]] = {}
        for r in distinct.where(F.pmod(F.xxhash64("f"), F.lit(parts)) == i).collect():
            forms.setdefault(r["f"], []).append(r["p"])
        found = texts.select(id_col, fold(F.col(text).cast("string")).alias("_text")).where("_text IS NOT NULL").mapInArrow(_finder(forms), f"`{id_col}` {kind}, pattern string")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(forms: dict[str, list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for f in forms:
            if f:
                automaton.add_word(f, f)
        automaton.make_automaton()
        always = forms.get("", [])
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                met = {f for _, f in automaton.iter(t)} if len(automaton) else ()
                own = [*always, *(p for f in met for p in forms[f])]
                at += [i] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=[b.schema.names[0], "pattern"])

    return run
