"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60
RECORD_KEY = ("machine", "source", "session_id", "source_path", "doc_id")


def ranked(hits: DataFrame, *order) -> DataFrame:
    """hits with rank from 0. The lists are top-k results, so one task holds them."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def _usable(k: float) -> float:
    """k, or the default where it is negative or not finite."""
    return float(k) if math.isfinite(k) and k >= 0 else float(K)


def fuse(lists: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """keys with score, the sum of 1 / (k + rank + 1) over the lists an item is in; ranks start at 0."""
    return lists.groupBy(*keys).agg(F.sum(1 / (F.lit(_usable(k)) + F.col("rank") + 1)).alias("score"))


def fuse_views(lists: DataFrame, keys: list[str], payload: list[str], k: int = K) -> DataFrame:
    """As fuse(), with the payload from where an item's own score is highest (first view, first rank on ties; a score
    that is no finite number is below all others). lists has view (number), rank and score."""
    finite = F.coalesce(~F.isnan("score") & (F.abs("score") != float("inf")), F.lit(False))
    best = F.struct(finite, F.when(finite, F.col("score")).otherwise(0.0), -F.col("view"), -F.col("rank"))
    return lists.groupBy(*keys).agg(F.sum(1 / (F.lit(_usable(k)) + F.col("rank") + 1)).alias("fused"), *(F.max_by(c, best).alias(c) for c in payload)).withColumnRenamed("fused", "score")


def in_order(fused: DataFrame) -> DataFrame:
    """Fused hits in their full order: score, the later time, then machine, source, session, path and record."""
    return fused.orderBy(F.desc("score"), F.desc("ts"), *RECORD_KEY)


def federate(results: dict[str, DataFrame], order: list, keys: list[str], k: int = K) -> DataFrame:
    """All machines' hits under one order: fused by rank if more than one answered, else with their own scores."""
    if not results:
        raise ValueError("no machine answered")
    named = [df.withColumn("machine", F.lit(m)) for m, df in results.items()]
    if len(named) == 1:
        return named[0]
    w = Window.partitionBy("machine").orderBy(*order)
    lists = named[0].withColumn("rank", F.row_number().over(w) - 1)
    for df in named[1:]:
        lists = lists.unionByName(df.withColumn("rank", F.row_number().over(w) - 1))
    return lists.withColumn("score", 1 / (F.lit(float(k)) + F.col("rank") + 1)).drop("rank")
