"""Helpers shared by the training-data operators: table reads, the shared scratch folder, sized joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, scratch_path, settled, shared_dir

__all__ = ["BROADCAST_ROWS", "WORD", "bucketed", "checkpointed", "cut", "id_crc", "join_by_weight", "join_sized", "scratch_path", "settled", "shared_dir", "table"]

#: A run of characters that is not an ASCII blank; the word of most contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a narrow table (keys and a few numbers) that may be broadcast; about 10 MB.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; unlike cut() it keeps df's partitioning."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Writes df to the shared folder as a table in buckets of key, as many as there are shuffle partitions: joins on
    key then move only the other side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table_name)
    return spark.table(table_name)


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def join_sized(rows: DataFrame, side: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows join side (one row a key). A side of at most `most` rows is broadcast, a larger one shuffled, where
    adaptive execution splits a key that holds many rows."""
    small = side.limit(most + 1).count() <= most
    return rows.join(F.broadcast(side) if small else side, on, how)


def join_by_weight(rows: DataFrame, side: DataFrame, on: str, weight: str, largest: int = 10_000) -> DataFrame:
    """rows join side (one row a key; weight: how many of rows have the key). Keys with over 1/largest of the rows,
    `largest` at most, are broadcast, so that none of their rows is shuffled; the others are joined as usual."""
    total = side.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    heavy = F.col(weight) * largest > F.lit(total)
    marked = rows.join(F.broadcast(side.filter(heavy).select(on, F.lit(True).alias("_heavy"))), on, "left")
    few = marked.filter("_heavy").drop("_heavy").join(F.broadcast(side.filter(heavy)), on)
    many = marked.filter("_heavy is null").drop("_heavy").join(side.filter(~heavy), on)
    return few.union(many.select(few.columns)).drop(weight)
