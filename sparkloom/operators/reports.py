"""Reports and scores over log tables: notes, rule quality, wiring, health, trends, tiers, fused signals.

One-row reports are aggregates; nothing is collected. Scores are Column expressions over a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.stats import wilson_lower, wilson_upper

#: Parts of a path that tell of leftovers.
CHURN = ["tmp/", "_bak", ".bak", "_old", "_backup"]


def appended(notes: Column, note: Column) -> Column:
    """Notes with one more line; the first note stands alone."""
    return F.when(F.coalesce(notes, F.lit("")) == "", note).otherwise(F.concat(notes, F.lit("\n"), note))


def retagged(notes: Column, tag: str, new: Column) -> Column:
    """Notes parted by "; " without those of the tag, and the new one at the end."""
    kept = F.filter(F.split(F.coalesce(notes, F.lit("")), "; "), lambda p: (p != "") & ~p.startswith(tag))
    return F.array_join(F.concat(kept, F.array(new)), "; ")


def churned(path: Column) -> Column:
    """Whether a path holds one of CHURN."""
    return path.rlike("|".join(x.replace(".", "[.]") for x in CHURN))


def rule_score(prevented: Column, hits: Column) -> Column:
    """Prevented errors by hits, of which there is at least one."""
    return prevented / F.greatest(hits, F.lit(1))


def archived(rules: DataFrame, prevented: str, hits: str, least: int, score: float) -> DataFrame:
    """The rules that stay: those with at least `least` hits and a lower score go."""
    return rules.where(~((F.col(hits) >= least) & (rule_score(F.col(prevented), F.col(hits)) < score)))


def chains(df: DataFrame, kind: str, confidence: str) -> DataFrame:
    """(total, broken, confidence): a chain is broken by its kind or below a confidence of 0.3."""
    broken = (F.col(confidence) < 0.3) | (F.col(kind) == "Broken")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(broken).alias("broken"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("confidence"))


def wiring(symbols: DataFrame, orphan: Column, chained: DataFrame, modules: DataFrame, integration: str) -> DataFrame:
    """One row: symbols, orphans, chains and a score of 0.4 (1 - orphan rate) + 0.3 chain health + 0.3 mean integration."""
    s = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(orphan).alias("orphans")).withColumn("_k", F.lit(1))
    m = modules.agg(F.coalesce(F.avg(integration), F.lit(1.0)).alias("integration"), F.count_if(F.col(integration) < 0.5).alias("below")).withColumn("_k", F.lit(1))
    one = s.join(chained.withColumn("_k", F.lit(1)), "_k").join(m, "_k").drop("_k")  # single rows
    rate = F.when(F.col("symbols") > 0, F.least(F.col("orphans") / F.col("symbols"), F.lit(1.0))).otherwise(F.lit(0.0))
    clamp = lambda c, lo=0.0: F.greatest(F.lit(lo), F.least(F.lit(1.0), c))
    health = F.when(F.col("total") > 0, (1 - F.col("broken") / F.col("total")) * clamp(F.col("confidence"), 0.1)).otherwise(F.lit(1.0))
    score = clamp(0.4 * (1 - rate) + 0.3 * health + 0.3 * clamp(F.col("integration")))
    return one.select("symbols", "orphans", rate.alias("orphan_rate"), "total", "broken", "integration", "below", score.alias("score"))


def health(dimensions: DataFrame, score: str, weight: str, points: str) -> DataFrame:
    """(score, lower, upper, status): the weighted mean, its Wilson interval over all data points (one where a dimension has none), and a band."""
    one = dimensions.agg(F.sum(F.col(score) * F.col(weight)).alias("_s"), F.sum(weight).alias("_w"), F.greatest(F.lit(1), F.coalesce(F.sum(F.coalesce(F.col(points), F.lit(1))), F.lit(1))).cast("double").alias("_n"))
    mean = F.when(F.coalesce("_w", F.lit(0.0)) > 0, F.col("_s") / F.col("_w")).otherwise(F.lit(0.0))
    one = one.select(mean.alias("score"), "_n")
    ok = F.col("score") * F.col("_n")
    status = F.when(F.col("score") >= 0.8, "healthy").when(F.col("score") >= 0.4, "degraded").otherwise("critical")
    return one.select("score", wilson_lower(ok, F.col("_n")).alias("lower"), wilson_upper(ok, F.col("_n")).alias("upper"), status.alias("status"))


def learning(tools: DataFrame, score: str, entries: DataFrame, arms: DataFrame, pulls: str) -> DataFrame:
    """One row: counts and 0.4 richness of entries + 0.3 mean tool score + 0.2 arms + 0.1; 0.5 without any data."""
    parts = [
        tools.agg(F.count(F.lit(1)).alias("tools"), F.coalesce(F.avg(score), F.lit(0.0)).alias("tool_score")),
        entries.agg(F.count(F.lit(1)).alias("entries")),
        arms.agg(F.count(F.lit(1)).alias("arms"), F.coalesce(F.sum(pulls), F.lit(0)).alias("pulls")),
    ]
    one = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        one = one.join(p.withColumn("_k", F.lit(1)), "_k")  # single rows
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rich = 0.4 * clamp(F.col("entries") / 100) + 0.3 * clamp(F.col("tool_score")) + F.when(F.col("arms") > 0, 0.2).otherwise(0.0) + 0.1
    return one.drop("_k").withColumn("score", F.when((F.col("tools") > 0) | (F.col("entries") > 0), clamp(rich)).otherwise(F.lit(0.5)))


def half_means(df: DataFrame, key: str, order: list[str], x: str, whole: bool = False) -> DataFrame:
    """(key, n, older, recent): means of the older and the newer half of each key's rows, the middle row being newer; whole truncates them."""
    w = Window.partitionBy(key)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    old = F.col("_i") <= F.floor(F.col("_n") / 2)
    cut = (lambda c: c.cast("long")) if whole else (lambda c: c)
    return d.groupBy(key).agg(F.max("_n").alias("n"), cut(F.avg(F.when(old, F.col(x)))).alias("older"), cut(F.avg(F.when(~old, F.col(x)))).alias("recent"))


def direction(older: Column, recent: Column, band: float) -> Column:
    """1 improving, -1 degrading, 0 within the band or without two halves."""
    return F.when(recent - older > band, 1).when(recent - older < -band, -1).otherwise(0)


def bottleneck(scores: dict[str, Column], tie: float = 1e-6) -> Column:
    """The name of the lowest score, tied where another is as low."""
    least = F.least(*scores.values())
    low = F.filter(F.array(*(F.struct(F.lit(k).alias("name"), c.alias("x")) for k, c in scores.items())), lambda s: F.abs(s["x"] - least) < tie)
    return F.when(F.size(low) == 1, F.get(low, F.lit(0))["name"]).otherwise(F.lit("tied"))


def redundancy(dead: Column, duplicates: Column, total: Column) -> Column:
    """Dead and duplicate functions by all, at most 1; 0 without functions."""
    return F.when(total > 0, F.least(dead + duplicates, total) / total).otherwise(F.lit(0.0))


def evaluations(df: DataFrame, key: str, order: list[str], x: str, size: int = 50, keep: float = 0.02, reset: float = -0.05) -> DataFrame:
    """(key, evaluation, mean, decision) of each full window of size rows against the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("evaluation", F.floor((F.row_number().over(w) - 1) / size) + 1).groupBy(key, "evaluation").agg(F.avg(x).alias("mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size)
    delta = F.col("mean") - F.lag("mean").over(Window.partitionBy(key).orderBy("evaluation"))
    decision = F.when(delta.isNull() | (delta > keep), "keep").when(delta < reset, "reset").when(F.col("mean") < 0, "decrease_explore_interval").otherwise("increase_ema_alpha")
    return d.select(key, "evaluation", "mean", decision.alias("decision"))


def alpha_step(expected: str, actual: str, start: float = 1.0, size: int = 50) -> tuple[Callable, dict, str]:
    """An exploration rate for sequences.fold(): the mean absolute regret of the last size rows, once there are half of them, raises it above 0.3 and lowers it below 0.05 by a twentieth, within 0.1 and 5."""

    def step(state: dict, row) -> tuple:
        state["seen"] = [*state.get("seen", []), abs(float(getattr(row, expected)) - float(getattr(row, actual)))][-size:]
        alpha = state.get("alpha", min(5.0, max(0.1, start)))
        if len(state["seen"]) >= size // 2:
            mean = sum(state["seen"]) / len(state["seen"])
            alpha = min(5.0, max(0.1, alpha * (1.05 if mean > 0.3 else 0.95 if mean < 0.05 else 1.0)))
        state["alpha"] = alpha
        return (alpha,)

    return step, {}, "alpha double"


def tier(accesses: Column, idle_days: Column) -> Column:
    """promote from 10 accesses on, else demote from 30 idle days on."""
    return F.when(accesses >= 10, "promote").when(idle_days >= 30, "demote").otherwise("keep")


def enriched_severity(direct: Column, transitive: Column, together: Column) -> Column:
    """(0.5 direct + 0.3 transitive + 0.2 edited together) by their number; 0 without any."""
    total = direct + transitive + together
    return F.when(total == 0, F.lit(0.0)).otherwise((0.5 * direct + 0.3 * transitive + 0.2 * together) / total)


def softmax_fused(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """(key, n, fused, dominant, top, entropy, lo, hi, margin): each key's estimates weighted by their softmax.

    dominant is the first row by order with the highest estimate, top its weight, margin its lead over the next.
    """
    high = df.groupBy(key).agg(F.max(x).alias("_m"))
    d = df.join(high, key).withColumn("_e", F.exp(F.col(x) - F.col("_m")))
    sums = d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_e").alias("_z"), F.sum(F.col("_e") * F.col(x)).alias("_ex"), F.sum(F.col("_e") * (F.col(x) - F.col("_m"))).alias("_el"),
        F.min(F.when(F.col(x) == F.col("_m"), F.col(order))).alias("dominant"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count_if(F.col(x) == F.col("_m")).alias("_ties"), F.max(F.when(F.col(x) < F.col("_m"), F.col(x))).alias("_second"),
    )
    margin = F.when((F.col("_ties") > 1) | F.col("_second").isNull(), F.lit(0.0)).otherwise(F.col("hi") - F.col("_second"))
    return sums.select(key, "n", (F.col("_ex") / F.col("_z")).alias("fused"), "dominant", (1 / F.col("_z")).alias("top"), (F.log("_z") - F.col("_el") / F.col("_z")).alias("entropy"), "lo", "hi", margin.alias("margin"))


def reconciled(df: DataFrame, key: str, value: str, confidence: str, limit: float = 0.3) -> DataFrame:
    """(key, value, confidence, conflict, bound, cv): fused by confidence, or where values vary by more than limit, by Wilson bounds of confidences out of 100."""
    bound = wilson_lower(F.round(F.col(confidence) * 100), F.lit(100.0))
    d = df.withColumn("_b", bound)
    cv = F.stddev_pop(value) / F.abs(F.avg(value))
    mean = lambda w: F.when(F.abs(F.sum(w)) < 1e-12, F.avg(value)).otherwise(F.sum(F.col(value) * F.col(w)) / F.sum(w))
    sure = 1 - F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence))))
    g = d.groupBy(key).agg(cv.alias("cv"), mean(confidence).alias("_c"), mean("_b").alias("_w"), sure.alias("confidence"), F.max("_b").alias("bound"))
    conflict = F.coalesce(F.col("cv") > limit, F.lit(False))
    return g.select(key, F.when(conflict, F.col("_w")).otherwise(F.col("_c")).alias("value"), "confidence", conflict.alias("conflict"), "bound", "cv")


def kl_divergence(df: DataFrame, p: str, q: str, epsilon: float = 1e-12) -> DataFrame:
    """(kl): sum p ln(p / q) over shares of the columns p and q, q at least epsilon, the sum at least 0."""
    total = df.agg(F.sum(p).alias("_p"), F.sum(q).alias("_q"))
    d = df.crossJoin(total).select((F.col(p) / F.col("_p")).alias("p"), (F.col(q) / F.col("_q")).alias("q"))  # total is one row
    return d.agg(F.greatest(F.lit(0.0), F.coalesce(F.sum(F.when(F.col("p") > epsilon, F.col("p") * F.log(F.col("p") / F.greatest(F.col("q"), F.lit(epsilon))))), F.lit(0.0))).alias("kl"))


def drift_band(ks: Column, js: Column) -> Column:
    """Bands of a drift by both distances."""
    return F.when((ks > 0.3) | (js > 0.25), "high").when((ks > 0.15) | (js > 0.1), "medium").when((ks > 0.05) | (js > 0.05), "low").otherwise("none")


def taken(choices: DataFrame, outcomes: DataFrame, key: str, at: str) -> DataFrame:
    """Each choice with the key's first outcome after it, which no earlier choice took: between two choices only the last can take one."""
    both = choices.select(key, at, F.lit(1).alias("_c")).unionByName(outcomes.select(key, at, F.lit(0).alias("_c")))
    w = Window.partitionBy(key).orderBy(at, F.desc("_c"))
    nxt = both.withColumn("taken_at", F.when(F.lead("_c").over(w) == 0, F.lead(at).over(w)))
    return nxt.where("_c = 1").drop("_c")


def reranked(candidates: DataFrame, fusion: str, semantic: str, keyword: str, least: float | None = None) -> DataFrame:
    """Add score and delta: the fused score and 0.3 of the semantic, 0.1 of the keyword one, missing ones counting nothing; lower than least go."""
    score = F.col(fusion) + 0.3 * F.coalesce(F.col(semantic), F.lit(0.0)) + 0.1 * F.coalesce(F.col(keyword), F.lit(0.0))
    d = candidates.withColumn("score", score).withColumn("delta", F.col("score") - F.col(fusion))
    return d if least is None else d.where(F.col("score") >= least)
