"""Fusion of ranked lanes: rows (lane, rank, id), rank from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 60


def lanes_of(**lanes: DataFrame) -> DataFrame:
    """Union of lanes in the given order, each with its ``rank``."""
    out = None
    for i, df in enumerate(lanes.values()):
        part = df.select(F.lit(i).alias("lane"), F.col("rank").cast("long").alias("rank"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def rrf(lanes: DataFrame, k: int = K, limit: int | None = None, digits: int | None = None) -> DataFrame:
    """(id, rrf_score, first, ranks): reciprocal rank fusion; ties by first appearance. ``digits`` rounds before sorting."""
    score = F.sum(1.0 / (k + F.col("rank")))
    score = score if digits is None else F.bround(score, digits)
    seen = F.array_sort(F.collect_list(F.struct("lane", "rank")))
    out = lanes.where("id IS NOT NULL").groupBy("id").agg(score.alias("rrf_score"), F.min(F.struct("lane", "rank")).alias("first"), F.transform(seen, lambda s: s["rank"]).alias("ranks"))
    return out if limit is None else out.orderBy(F.desc("rrf_score"), "first").limit(limit)


def union_merge(lanes: DataFrame) -> DataFrame:
    """(id, pos): distinct ids in order of first appearance."""
    first = lanes.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("lane", "rank")).alias("first"))
    return first.select("id", F.row_number().over(W.orderBy("first")).alias("pos"))


def outer_merge(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Vector hits, and keyword hits that it lacks with distance 1 and similarity 0."""
    j = vector.select("id", "distance").join(keyword.select("id", F.lit(True).alias("kw")), "id", "full_outer")
    return j.select("id", F.coalesce("distance", F.lit(1.0)).alias("distance"), F.greatest(F.lit(0.0), 1 - F.coalesce("distance", F.lit(1.0))).alias("vector_sim"))
