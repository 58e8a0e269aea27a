"""Tables in generations: each write makes a new folder, then moves the CURRENT pointer; readers keep what they read.

Folders are reached through Spark's own file systems, so a store is any that Spark can write.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> list[str]:
        root = self._path(self.root)
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.getPath().getName().startswith("gen-"))

    def current(self) -> str | None:
        p = self._path(f"{self.root}/{POINTER}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        gen = self.current()
        return self.spark.read.parquet(f"{self.root}/{gen}") if gen else None

    def publish(self, df: DataFrame, partition_by: list[str] = ()) -> str:
        """Writes a generation, then points to it. A failed write leaves the pointer as it was."""
        gen = f"gen-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{self.root}/{gen}")
        new, old = self._path(f"{self.root}/.{POINTER}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{POINTER}")
        out = self._fs.create(new, True)
        out.write(bytearray(gen.encode()))
        out.close()
        if not self._fs.rename(new, old):  # some stores don't replace
            self._fs.delete(old, False)
            self._fs.rename(new, old)
        return gen

    def replace_files(self, new: DataFrame, paths: DataFrame) -> str:
        """new in place of all stored rows of the paths (source_path)."""
        stored = self.read()
        return self.publish(new if stored is None else stored.join(paths.select("source_path").distinct(), "source_path", "left_anti").select(new.columns).unionByName(new))

    def collect_garbage(self, keep: int = 1, dry_run: bool = False) -> list[str]:
        """Generations that are neither current nor among the `keep` before it."""
        gens, cur = self.generations(), self.current()
        older = [g for g in gens if cur and g < cur]
        gone = older[: max(len(older) - keep, 0)]
        if not dry_run:
            for g in gone:
                self._fs.delete(self._path(f"{self.root}/{g}"), True)
        return gone

    def compact(self, target_bytes: int = 256 * 1024 * 1024, at_least: int = 128) -> str | None:
        """Rewrites the current generation in files of about target_bytes if it has too many."""
        gen = self.current()
        files = [s for s in self._fs.listStatus(self._path(f"{self.root}/{gen}")) if s.getPath().getName().endswith(".parquet")] if gen else []
        if len(files) < at_least:
            return None
        n = max(1, -(-sum(s.getLen() for s in files) // target_bytes))
        return self.publish(self.read().coalesce(int(n)))


def write_json(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """JSON lines of all or some fields."""
    (df.select(*fields) if fields else df).write.mode("overwrite").json(path)


def as_json(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return df.select(F.to_json(F.struct(*(fields or df.columns))).alias("value"))


def append_trace(hits: DataFrame, path: str, query: str, at_ms: int) -> None:
    """One line a hit, without texts."""
    kept = [c for c in ("machine", "source", "session_id", "source_path", "doc_id", "rank", "score") if c in hits.columns]
    hits.select(F.lit(query).alias("query"), F.lit(at_ms).alias("at_ms"), *kept).write.mode("append").json(path)
