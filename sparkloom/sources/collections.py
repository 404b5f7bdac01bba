"""Collections of vectors: named Parquet tables of points with a dimension, a metric and metadata columns.

Every write is a new version of the table; a version is whole before its folder is named, so a
lost executor or driver leaves the one before it in force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.rounds import cut
from sparkloom.operators.vectors import METRICS, literal


class Collection:
    """Points (id, vector, metadata columns)."""

    def __init__(self, name: str, size: int, metric: str, points: DataFrame):
        if metric not in METRICS:
            raise ValueError(f"unknown metric: {metric!r}")
        self.name, self.size, self.metric, self.points = name, size, metric, points

    @classmethod
    def create(cls, spark: SparkSession, name: str, size: int, metric: str = "cosine", metadata: str = "", id_type: str = "long") -> Collection:
        """An empty collection; metadata: columns as in a schema string."""
        schema = f"id {id_type}, vector array<double>" + (f", {metadata}" if metadata else "")
        return cls(f"{name}-{uuid.uuid4().hex}", size, metric, spark.createDataFrame([], schema))

    def upsert(self, points: DataFrame) -> None:
        """Points replace those of the same id; of repeats within the points any one stays. A vector of another size fails."""
        right = F.when(F.size("vector") == self.size, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has not {self.size} components")))
        new = points.select(*self.points.columns).withColumn("vector", right).dropDuplicates(["id"])
        self.points = cut(self.points.join(new.select("id"), "id", "left_anti").unionByName(new))

    def delete(self, ids: DataFrame) -> None:
        """Points of the ids (id) go; unknown ids are ignored."""
        self.points = cut(self.points.join(ids.select("id"), "id", "left_anti"))

    def search(self, query: list[float], k: int, where: Column | None = None, least: float | None = None) -> DataFrame:
        """(id, score, metadata): the k best points that pass the filter, ties by id; least is the lowest score, or the farthest distance."""
        if len(query) != self.size:
            raise ValueError(f"the query has {len(query)} components, not {self.size}")
        f, larger = METRICS[self.metric]
        rest = [c for c in self.points.columns if c not in ("id", "vector")]
        found = self.points if where is None else self.points.where(where)
        scored = found.select("id", f(F.col("vector"), literal(query)).alias("score"), *rest).where(~F.isnan("score"))
        if least is not None:
            scored = scored.where(F.col("score") >= least if larger else F.col("score") <= least)
        return scored.orderBy(F.desc("score") if larger else F.asc("score"), "id").limit(max(0, k))

    def count(self) -> int:
        return self.points.count()
