"""Mixing to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed by cell (source, language, topic). Cell weights start at the cells' share of tokens and are raked: in
turn, they are scaled so that each source, each language and each topic gets its target share, until all three hold.
A document is then kept with probability min(1, s * weight / share of its cell), with s set so that the expected tokens
are the wanted fraction; the draw is a hash of seed, id and text, the same in every run.

Targets are tables (level, share). Where none is given, a level's target is its share of tokens to the power `alpha`,
scaled to sum to one: below 1 this lifts small levels. A column named topic is used if there is one; otherwise the
topic is the form of the text (`form`).

Defined results: null source, language or topic is the level ''; null text has no tokens; a level without a target, or
with tokens 0, has weight 0 and is never kept; levels of a target that no document has are ignored; an empty table
gives no rows; repeated rows get the same draw.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, join_sized, table

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    alpha: float = 0.7
    fraction: float = 0.8  # of tokens to keep
    rounds: int = 25
    tolerance: float = 0.002  # of a marginal, relative
    seed: int = 17


def form(text: Column, words: Column) -> Column:
    """A topic by the text's form."""
    return (
        F.when(text.rlike(r"(?i)licen[cs]ed under|copyright|all rights reserved"), "legal")
        .when(text.contains(" | "), "table")
        .when(text.rlike(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://"), "contact")
        .when(words < 100, "note")
        .when(words > 1000, "long")
        .otherwise("prose")
    )


def features(docs: DataFrame, text: Column, source: Column, lang: Column, topic: Column | None, key: Column) -> DataFrame:
    """docs with f_tokens, f_source, f_lang, f_topic and f_draw (0 to 1)."""
    t = F.coalesce(text, F.lit(""))
    df = docs.withColumn("f_tokens", F.regexp_count(t, F.lit(WORD)).cast("long"))
    level = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.withColumns({
        "f_source": level(source), "f_lang": level(lang), "f_topic": level(topic) if topic is not None else form(t, F.col("f_tokens")),
        "f_draw": F.shiftrightunsigned(F.xxhash64(F.lit(Mix.seed), key, t), 11) / F.lit(float(2**53)),
    })


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, mix: Mix = Mix()) -> DataFrame:
    """cells: source, lang, topic, tokens. Returns them with weight (sums to 1) and share (of tokens)."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))).withColumn("weight", F.col("share"))
    for d in DIMENSIONS:
        given = (targets or {}).get(d)
        if given is None:
            level = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(mix.alpha)).alias("g"))
        else:
            level = given.select(F.col("level").alias(d), F.col("share").cast("double").alias("g")).join(cells.select(d).distinct(), d, "left_semi")
        whole = level.agg(F.sum("g")).first()[0] or 1.0
        w = w.join(level.select(d, (F.col("g") / whole).alias(f"goal_{d}")), d, "left").withColumn(f"goal_{d}", F.coalesce(f"goal_{d}", F.lit(0.0)))
    for _ in range(mix.rounds):
        for d in DIMENSIONS:
            now = w.groupBy(d).agg(F.sum("weight").alias("now"))
            w = w.join(now, d).withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.col(f"goal_{d}") / F.nullif(F.col("now"), F.lit(0.0))).otherwise(0.0)).drop("now")
        w = cut(w, "rake")
        off = [w.groupBy(d).agg(F.sum("weight").alias("now"), F.max(f"goal_{d}").alias("goal")).agg(F.max(F.when(F.col("goal") > 0, F.abs(F.col("now") / F.nullif(F.col("goal"), F.lit(0.0)) - 1)))).first()[0] or 0.0 for d in DIMENSIONS[:2]]
        if max(off) <= mix.tolerance:
            break
    return w


def calibrate(raked: DataFrame, fraction: float) -> DataFrame:
    """raked with probability: min(1, s * weight / share), for the s at which `fraction` of the tokens is expected.
    s is narrowed by a factor of 32 in each of a few passes over the cells."""
    ratio = F.when(F.col("share") > 0, F.col("weight") / F.nullif(F.col("share"), F.lit(0.0))).otherwise(0.0)
    kept = lambda s: F.sum(F.col("share") * F.least(F.lit(1.0), s * ratio))
    low, high = 0.0, 1.0
    reach = raked.agg(F.sum(F.when(F.col("weight") > 0, F.col("share")))).first()[0] or 0.0
    wanted = min(fraction, reach * (1 - 1e-9))
    while wanted > 0 and (raked.agg(kept(high)).first()[0] or 0.0) < wanted and high < 1e12:
        low, high = high, high * 32
    for _ in range(7):
        steps = [low + (high - low) * k / 32 for k in range(33)]
        got = list(raked.agg(*(F.coalesce(kept(s), F.lit(0.0)).alias(f"k{k}") for k, s in enumerate(steps))).first())
        at = next((k for k, g in enumerate(got) if g >= wanted), 32)
        low, high = steps[max(at - 1, 0)], steps[at]
    return raked.withColumn("probability", F.least(F.lit(1.0), high * ratio))


def plan(narrow: DataFrame, targets: dict[str, DataFrame] | None = None, mix: Mix = Mix()) -> DataFrame:
    """narrow: features of all documents. Returns f_source, f_lang, f_topic, f_weight, f_probability by cell."""
    cells = cut(narrow.groupBy(*(F.col(f"f_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("f_tokens").alias("tokens")), "cells")
    found = calibrate(rake(cells, targets, mix), mix.fraction)
    return cut(found.select(*(F.col(d).alias(f"f_{d}") for d in DIMENSIONS), F.when(F.col("share") > 0, F.col("weight") / F.nullif(F.col("share"), F.lit(0.0))).otherwise(0.0).alias("f_weight"), F.col("probability").alias("f_probability")), "plan")


def sample_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", targets: dict[str, DataFrame] | None = None, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs that are drawn, with the columns of docs. Texts are read twice and never shuffled."""
    rows = docs.select(F.struct("*").alias("row"))
    of = lambda k: F.col("row").getField(k)
    seen = features(rows, of(text), of(source), of(lang), of("topic") if "topic" in docs.columns else None, of(doc_id))
    keys = [f"f_{d}" for d in DIMENSIONS]
    return join_sized(seen, plan(seen.drop("row"), targets, mix), keys).filter(F.col("f_draw") < F.col("f_probability")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    seen = cut(features(docs, F.col("text"), F.col("source"), F.col("lang"), None, F.col("doc_id")).drop("text"), "features")
    out = join_sized(seen, plan(seen), [f"f_{d}" for d in DIMENSIONS])
    return out.select(
        "doc_id", F.col("f_source").alias("source"), F.col("f_lang").alias("lang"), F.col("f_topic").alias("topic"), F.col("f_tokens").alias("n_tokens"),
        F.round("f_weight", 6).alias("weight"), F.round("f_probability", 6).alias("probability"), (F.col("f_draw") < F.col("f_probability")).alias("sampled"),
    )
