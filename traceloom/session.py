"""SparkSession for the engine's queries."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution; master and partitions are left to spark-submit unless given."""
    b = SparkSession.builder.appName("traceloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master or os.environ.get("SPARK_MASTER"):
        b = b.master(master or os.environ["SPARK_MASTER"])
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()
