"""Reciprocal rank fusion and other merging of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def union_lists(lists: list[DataFrame | None]) -> DataFrame:
    """UNION ALL of ranked lists (query_id, rank, id, ...), numbered by list_no; a missing one is empty."""
    given = [x.withColumn("list_no", F.lit(i)) for i, x in enumerate(lists) if x is not None]
    if not given:
        raise ValueError("no ranked list")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), given)


def reciprocal_rank_fusion(ranked: DataFrame, k: int = K, top: int = 10, payload: list[str] | None = None) -> DataFrame:
    """(query_id, rank, id, score, payload) from ranked(query_id, list_no, rank, id, payload).

    score = sum of 1 / (k + rank) over every occurrence; the payload is that of the
    first list that has the id, and its place there breaks ties.
    """
    payload = payload or []
    place = F.struct("list_no", "rank")
    first = F.min_by(F.struct(*payload), place).alias("_p") if payload else F.lit(None).alias("_p")
    fused = ranked.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(place).alias("_first"), first)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "_first.list_no", "_first.rank")
    out = fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return out.select("query_id", "rank", "id", "score", *(F.col("_p")[c].alias(c) for c in payload))


def merge_candidates(ranked: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """(query_id, number, id): each id once, at its first appearance by list, then rank, renumbered from 1."""
    once = Window.partitionBy("query_id", "id").orderBy("list_no", "rank")
    kept = ranked.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    place = Window.partitionBy("query_id").orderBy("list_no", "rank")
    return kept.select("query_id", F.row_number().over(place).alias("number"), "id", *(payload or []))
