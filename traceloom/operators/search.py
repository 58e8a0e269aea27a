"""Lexical search by BM25."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


def terms_of(query: str) -> list[str]:
    """Distinct tokens of a query, in order; the same rule as for texts."""
    return list(dict.fromkeys(t for t in re.split(r"[^\w]+|_+", query.lower()) if t))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, query: str, key: str, text: str = "text") -> DataFrame:
    """Matching docs with score. No token leaves its row: a document's length and term counts are measured where it
    is read, and only their sums (one row) cross the network. An empty query matches all, with score 0."""
    terms = terms_of(query)
    if not terms:
        return docs.withColumn("score", F.lit(0.0))
    counts = lambda w: F.struct(F.size(w).alias("size"), *(F.size(F.filter(w, _equals(t))).alias(f"tf{k}") for k, t in enumerate(terms)))
    measured = F.transform(F.array(tokens(F.col(text))), counts)  # of one: a text is cut into tokens once
    m = F.col("_m")
    stats = docs.select(F.explode(measured).alias("_m")).agg(F.count("*").alias("n"), F.avg(m["size"]).alias("mean"), *(F.count_if(m[f"tf{k}"] > 0).alias(f"df{k}") for k in range(len(terms)))).first()

    def part(k: int) -> Column:
        tf = m[f"tf{k}"].cast("double")
        idf = F.log(1 + (F.lit(float(stats["n"])) - stats[f"df{k}"] + 0.5) / F.lit(stats[f"df{k}"] + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * m["size"] / F.lit(stats["mean"] or 1.0)))

    total = sum((part(k) for k in range(1, len(terms))), part(0))
    matching = F.filter(measured, lambda x: reduce(add, (x[f"tf{k}"] for k in range(len(terms)))) > 0)
    return docs.withColumn("_m", F.explode(matching)).withColumn("score", total).drop("_m")


def recency(score: Column, ts: Column, now_ms: int, weight: float = 1.0, half_life_days: float = 30.0) -> Column:
    """score * (1 + weight * 2^(-age / half-life)); unchanged where a part is zero or less; a future time has age 0."""
    if weight <= 0 or half_life_days <= 0:
        return score
    age = F.greatest(F.lit(now_ms) - ts, F.lit(0)) / 86_400_000.0
    return F.when((score <= 0) | (ts == 0), score).otherwise(score * (1 + weight * F.exp(-F.log(F.lit(2.0)) * age / half_life_days)))
