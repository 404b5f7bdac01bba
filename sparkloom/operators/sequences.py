"""Operators over ordered rows: transitions, running rates, drift alarms, run lengths.

What windows can say is said with windows. Folds with resets keep their order in applyInPandas,
one key at a time; their keys must be such that one key's rows fit a task, as a user's events do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(df: DataFrame, key: str, order: list[str], state: str, lag: int = 1) -> DataFrame:
    """(previous..., state, n, p): counts and shares of the state after the last lag states of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    names = [f"prev{i}" for i in range(lag, 0, -1)]
    d = df.select("*", *(F.lag(state, i).over(w).alias(f"prev{i}") for i in range(lag, 0, -1))).where(F.col(names[0]).isNotNull())
    counts = d.groupBy(*names, state).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*names)))


def rolling_rate(df: DataFrame, key: str, order: list[str], bad: Column, n: int) -> DataFrame:
    """Add rate: the share of bad rows among the key's last n."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-n + 1, 0)
    return df.withColumn("rate", F.avg(bad.cast("double")).over(w))


def page_hinkley(df: DataFrame, key: str, order: list[str], x: str, delta: float, threshold: float) -> DataFrame:
    """Add mean, cum and alarm: cum sums x - running mean - delta, and alarms when it exceeds its minimum by threshold."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("mean", F.avg(x).over(w))
    d = d.withColumn("cum", F.sum(F.col(x) - F.col("mean") - delta).over(w))
    return d.withColumn("alarm", F.col("cum") - F.least(F.min("cum").over(w), F.lit(0.0)) > threshold)


def half_drift(df: DataFrame, key: str, order: list[str], x: str, n: int, threshold: float) -> DataFrame:
    """(key, n, difference, confidence, drift) of the means of the two halves of the last n rows; keys with 10 rows or more."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    d = df.withColumn("_i", F.row_number().over(newest)).where(F.col("_i") <= n)
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    new = F.col("_i") <= F.col("_n") - F.floor(F.col("_n") / 2)
    out = d.where("_n >= 10").groupBy(key).agg(F.max("_n").alias("n"), (F.avg(F.when(new, F.col(x))) - F.avg(F.when(~new, F.col(x)))).alias("difference"))
    return out.withColumn("confidence", 1 - 1 / F.sqrt("n")).withColumn("drift", F.abs("difference") >= threshold)


def run_lengths(df: DataFrame, key: str, order: list[str], x: str) -> DataFrame:
    """(key, run, value, n): maximal runs of equal values."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(x).eqNullSafe(F.lag(x).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    d = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return d.groupBy(key, "run").agg(F.first(x).alias("value"), F.count(F.lit(1)).alias("n"))


def expand_runs(runs: DataFrame, key: str) -> DataFrame:
    """The inverse of run_lengths: (key, position, value)."""
    w = Window.partitionBy(key).orderBy("run", "_k")
    d = runs.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return d.select(key, (F.row_number().over(w) - 1).alias("position"), "value")


def fold(df: DataFrame, key: str, order: list[str], step: Callable, start: dict, columns: str) -> DataFrame:
    """An ordered fold with its own state for each key: step(state, row) gives the new columns of the row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + columns
    names = [c.split()[0] for c in columns.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state = dict(start)
        rows = [step(state, r) for r in pdf.itertuples(index=False)]
        for name, values in zip(names, zip(*rows)):
            pdf[name] = list(values)
        return pdf

    return df.groupBy(key).applyInPandas(run, schema)


def cusum_step(x: str, window: int = 100, least: int = 10, slack: float = 5.0, limit: float = 50.0) -> tuple[Callable, dict, str]:
    """A two-sided CUSUM against the mean of the last rows: sums beyond limit alarm and fall back to 0."""

    def step(state: dict, row) -> tuple:
        value = float(getattr(row, x))
        state["seen"] = [*state.get("seen", []), value][-window:]
        if len(state["seen"]) < least:
            return 0.0, 0.0, ""
        mean = float(np.mean(state["seen"]))
        up = max(0.0, state.get("up", 0.0) + value - mean - slack)
        down = max(0.0, state.get("down", 0.0) - value + mean - slack)
        alarm = "up" if up > limit else "down" if down > limit else ""
        state["up"], state["down"] = (0.0 if alarm == "up" else up), (0.0 if alarm == "down" else down)
        return up, down, alarm

    return step, {}, "up double, down double, alarm string"


def ema_step(x: str, rate: float = 0.1, start: float = 0.5) -> tuple[Callable, dict, str]:
    """An exponential moving average that starts at start."""

    def step(state: dict, row) -> tuple:
        state["q"] += rate * (float(getattr(row, x)) - state["q"])
        return (state["q"],)

    return step, {"q": start}, "q double"


def blend_step(x: str, rate: float = 0.2) -> tuple[Callable, dict, str]:
    """A case value: the first as is, then a moving average; both within -1 and 1."""

    def step(state: dict, row) -> tuple:
        value = min(1.0, max(-1.0, float(getattr(row, x))))
        state["v"] = value if "v" not in state else min(1.0, max(-1.0, state["v"] + rate * (value - state["v"])))
        return (state["v"],)

    return step, {}, "case_value double"
