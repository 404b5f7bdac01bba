"""Online learners as ordered folds for each key, and what is decided from their state.

A learner's updates are sequential within a key; keys run in parallel. State is plain numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ftrl_step(features: str, label: str, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> tuple[Callable, dict, str]:
    """FTRL-proximal logistic regression: predicts a row, then learns its binary label."""

    def step(state: dict, row) -> tuple:
        x = np.asarray(getattr(row, features), float)
        z, n = state.setdefault("z", np.zeros(len(x))), state.setdefault("n", np.zeros(len(x)))
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - float(getattr(row, label))) * x
        state["z"] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
        state["n"] = n + g * g
        return (float(p),)

    return step, {}, "p double"


def double_q_step(reward: str, action: str, actions: list[str], rate: float = 0.1, discount: float = 0.9, sync: int = 10) -> tuple[Callable, dict, str]:
    """Double Q over one state: the online table picks the next action, the target table values it; the target is copied every sync updates."""

    def step(state: dict, row) -> tuple:
        q, t = state.setdefault("q", dict.fromkeys(actions, 0.0)), state.setdefault("t", dict.fromkeys(actions, 0.0))
        a = getattr(row, action)
        best = max(actions, key=lambda k: (q[k], -actions.index(k)))
        error = float(getattr(row, reward)) + discount * t[best] - q[a]
        q[a] += rate * error
        state["i"] = state.get("i", 0) + 1
        if state["i"] % sync == 0:
            state["t"] = dict(q)
        return q[a], error

    return step, {}, "q double, td_error double"


def linucb_step(features: str, arms: list[str], arm: str, reward: str, alpha: float = 1.0) -> tuple[Callable, dict, str]:
    """LinUCB: scores all arms for a row's features (an arm without pulls first), then learns the reward of the arm that was pulled."""

    def step(state: dict, row) -> tuple:
        x = np.asarray(getattr(row, features), float)
        s = state.setdefault("arms", {k: [np.eye(len(x)), np.zeros(len(x)), 0] for k in arms})
        score = {k: float("inf") if n == 0 else float((inv @ b) @ x + alpha * np.sqrt(x @ inv @ x)) for k, (inv, b, n) in s.items()}
        chosen = max(arms, key=lambda k: (score[k], -arms.index(k)))
        own = s[getattr(row, arm)]
        ax = own[0] @ x
        own[0] = own[0] - np.outer(ax, ax) / (1 + x @ ax)
        own[1] = own[1] + float(getattr(row, reward)) * x
        own[2] += 1
        return (chosen,)

    return step, {}, "chosen string"


def exploration_bonus(visits: Column, beta: float = 1.0, most: float = 1.0) -> Column:
    """min(beta / sqrt(visits + 1), most)."""
    return F.least(F.lit(beta) / F.sqrt(visits + 1), F.lit(most))


def budget_shares(df: DataFrame, q: str, total: int, least: int) -> DataFrame:
    """Add budget: a share of total by q (at least 0.01; 0.5 where unknown), truncated, at least `least`."""
    d = df.withColumn("_q", F.greatest(F.coalesce(F.col(q), F.lit(0.5)), F.lit(0.01)))
    s = d.agg(F.sum("_q")).first()[0] or 1.0
    return d.withColumn("budget", F.greatest(F.floor(F.col("_q") / s * total), F.lit(least)).cast("long")).drop("_q")


def importance_sample(df: DataFrame, uid: str, k: int, seed: int = 42, beta: float = 0.4) -> DataFrame:
    """k rows drawn without replacement by a seeded hash, with weight (n p)^-beta over the largest; p is uniform, so weights are 1."""
    drawn = df.orderBy(F.xxhash64(F.lit(seed), uid), uid).limit(k)
    return drawn.withColumn("weight", F.pow(F.lit(1.0), F.lit(-beta)))


def evaporated(df: DataFrame, strength: str, age: str, half_life: float, least: float = 0.001) -> DataFrame:
    """Strengths after exponential decay; those below least go."""
    return df.withColumn(strength, F.col(strength) * F.pow(F.lit(0.5), F.col(age) / half_life)).where(F.col(strength) >= least)


def reinforced(paths: DataFrame, key: str, order: list[str], node: str) -> DataFrame:
    """(a, b, strength): 1 for each pair of different consecutive nodes of a key's path, unordered."""
    w = Window.partitionBy(key).orderBy(*order)
    d = paths.withColumn("_prev", F.lag(node).over(w)).where(F.col("_prev").isNotNull() & (F.col("_prev") != F.col(node)))
    return d.groupBy(F.least("_prev", node).alias("a"), F.greatest("_prev", node).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("strength"))


def plan_status(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(task, status, ready): a pending task is ready when all that it depends on is done. tasks: task, status; deps: task, needs."""
    open_ = deps.join(tasks.select(F.col("task").alias("needs"), "status"), "needs", "left").where(F.coalesce("status", F.lit("")) != "done").select("task").distinct().withColumn("_open", F.lit(True))
    return tasks.join(open_, "task", "left").select("task", "status", ((F.col("status") == "pending") & F.col("_open").isNull()).alias("ready"))


def leader_clusters(df: DataFrame, key: str, id_col: str, vector: str, threshold: float, most: int) -> DataFrame:
    """(key, id, cluster): within a key, in order of id, each vector joins the most similar cluster whose centre is at least threshold away in cosine, else starts one, up to most; later ones without a cluster are left out.

    Centres are normalised means. The rule is sequential, so a key's vectors go to one task; keys run in parallel.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        sums, members, out = [], [], []
        for i, v in zip(pdf[id_col], pdf[vector]):
            x = np.asarray(v, float)
            length = np.linalg.norm(x)
            score = [float(s @ x / (np.linalg.norm(s) * length)) if length and np.linalg.norm(s) else 0.0 for s in sums]
            best = int(np.argmax(score)) if score else -1
            if best >= 0 and score[best] >= threshold:
                sums[best] = sums[best] + x
                members[best] += 1
            elif len(sums) < most:
                best = len(sums)
                sums.append(x)
                members.append(1)
            else:
                continue
            out.append((pdf[key].iloc[0], i, best))
        return pd.DataFrame(out, columns=[key, id_col, "cluster"])

    kinds = dict(df.dtypes)
    return df.select(key, id_col, vector).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, cluster int")


def merged_patterns(patterns: list[tuple[str, set[str]]], threshold: float) -> list[tuple[list[str], set[str]]]:
    """Patterns in order, each merged into the first group whose tags, united so far, have a Jaccard similarity of threshold or more."""
    out: list[tuple[list[str], set[str]]] = []
    for name, tags in patterns:
        for names, own in out:
            union = own | tags
            if (len(own & tags) / len(union) if union else 1.0) >= threshold:
                names.append(name)
                own |= tags
                break
        else:
            out.append(([name], set(tags)))
    return out


def transferred(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], similarity: float, most: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """An arm's inverse and reward vector blended with another's by similarity times the greatest blend."""
    w = min(1.0, max(0.0, similarity)) * most
    return (1 - w) * own[0] + w * other[0], (1 - w) * own[1] + w * other[1]
