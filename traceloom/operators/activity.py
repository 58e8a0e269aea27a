"""Activity over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import day


def daily(rows: DataFrame, ts: str, value: Column) -> DataFrame:
    """date (UTC), source, value."""
    return rows.groupBy(day(F.col(ts)).alias("date"), "source").agg(F.sum(value).alias("value"))


def histogram(rows: DataFrame, ts: str, start: int, end: int, width: int, by: list[str] = ()) -> DataFrame:
    """bucket, value: rows in `width` equal parts of start..end; the end itself is in the last part."""
    span = max(end - start, 1)
    at = F.least(F.lit(width - 1), F.expr(f"({ts} - {start}L) * {width}L div {span}L")).cast("int")
    return rows.filter(F.col(ts).between(start, end)).groupBy(*by, at.alias("bucket")).agg(F.count("*").alias("value"))


def density(buckets: DataFrame, levels: int) -> DataFrame:
    """buckets with level: 0 where empty, else value * levels / most, rounded up."""
    most = buckets.agg(F.max("value")).first()[0] or 0
    return buckets.withColumn("level", F.when((F.col("value") <= 0) | F.lit(most <= 0), 0).otherwise(F.ceil(F.col("value") * levels / F.lit(max(most, 1)))).cast("int"))


def timeline_density(buckets: DataFrame, levels: int, value: str = "value") -> DataFrame:
    """As density(), but one single hit is the lowest level, however many there are."""
    most = buckets.agg(F.max(value)).first()[0] or 0
    level = F.lit(1) if most == 1 else F.ceil(F.col(value) * levels / F.lit(max(most, 1)))
    return buckets.withColumn("level", F.when((F.col(value) <= 0) | F.lit(levels <= 0), 0).otherwise(level).cast("int"))


def stack(buckets: DataFrame, levels: int, group: str = "source") -> DataFrame:
    """Each group's rows of its bucket's level, in proportion, so that they add up to the level."""
    w = Window.partitionBy("bucket").orderBy(F.desc("value"), group).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("bucket")
    b = buckets.withColumns({"_run": F.sum("value").over(w), "_all": F.sum("value").over(whole)})
    most = b.agg(F.max("_all")).first()[0] or 1
    b = b.withColumn("_level", F.ceil(F.col("_all") * levels / F.lit(most)))
    upto = lambda c: F.floor(c * F.col("_level") / F.col("_all"))
    return b.select("bucket", group, "value", (upto(F.col("_run")) - upto(F.col("_run") - F.col("value"))).cast("int").alias("cells"))


def totals(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups by their sum, largest first, then by name."""
    return rows.groupBy(group).agg(F.sum(value).alias("value")).orderBy(F.desc("value"), group)
