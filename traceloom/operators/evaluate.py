"""Measures of retrieval against judged results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, qrels: DataFrame, keys: list[str], fallback: list[str] | None = None) -> DataFrame:
    """results (query_id, rank from 1, keys) with relevance: by keys, else by the older fallback keys, else 0."""
    q = qrels.groupBy("query_id", *keys).agg(F.max("relevance").alias("_rel"))
    out = results.join(q, ["query_id", *keys], "left")
    if fallback:
        old = qrels.groupBy("query_id", *fallback).agg(F.max("relevance").alias("_old"))
        out = out.join(old, ["query_id", *fallback], "left").withColumn("_rel", F.coalesce("_rel", "_old")).drop("_old")
    return out.withColumn("relevance", F.coalesce("_rel", F.lit(0.0))).drop("_rel")


def measures(results: DataFrame, qrels: DataFrame, item: list[str], k: int) -> DataFrame:
    """query_id, recall, reciprocal_rank, ndcg at k; a row for each query that has a positive judgement.

    A repeated item counts once, at its first rank; ranks themselves count repetitions.
    """
    top = judged(results.filter(F.col("rank") <= k), qrels, item)
    first = top.groupBy("query_id", *item).agg(F.min("rank").alias("rank"), F.max("relevance").alias("relevance"))
    gain = (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1.0)
    per = first.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("found"), F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first_rank"), F.sum(gain).alias("dcg"))
    good = qrels.filter("relevance > 0").groupBy("query_id", *item).agg(F.max("relevance").alias("relevance"))
    ideal = good.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), *item)))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("positives"), F.sum(F.when(F.col("rank") <= k, gain)).alias("idcg"))
    return ideal.join(per, "query_id", "left").select(
        "query_id", (F.coalesce("found", F.lit(0)) / F.col("positives")).alias("recall"), F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
    )


def means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def unique_sessions(results: DataFrame, k: int) -> DataFrame:
    return results.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count_distinct(F.struct(*(c for c in ("machine", "source", "session_id", "source_path") if c in results.columns))).alias("sessions"))
