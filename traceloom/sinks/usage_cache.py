"""Results by file, kept until the file or a file that it depends on changes.

Three tables in segments: `files` (source_path, parser, size, modified, parent_id), `deps` (source_path, dep_path, size,
modified: the files of its parent's session as they were read), `rows` (the results, with source_path). A file's result
holds while its entry has the same parser version, size and time, and while the files that carry its parent's session
now are, one by one, those that it was computed from: an extended parent, a new copy of it and a lost one each bring its
forks back. A fork whose parent isn't there gets its rows, but no entry, so that it is computed again next time.

All comparisons are joins; the driver holds no list of files. `files` is written last: a refresh that breaks off leaves
entries that no longer hold, never results that are taken for current.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut
from .segments import Segments

FILES = "source_path string, parser int, size long, modified long, parent_id string"
DEPS = "source_path string, dep_path string, size long, modified long"


class UsageCache:
    def __init__(self, spark: SparkSession, root: str, parser: int = 1):
        self.spark, self.parser = spark, parser
        self.files, self.deps, self.rows = (Segments(spark, f"{root.rstrip('/')}/{t}") for t in ("files", "deps", "rows"))

    def _read(self, table: Segments, schema: str) -> DataFrame:
        df = table.read()
        return self.spark.createDataFrame([], schema) if df is None else df

    def stale(self, listing: DataFrame) -> DataFrame:
        """source_path, reason ('new', 'changed', 'parent' or 'gone') of what is to be computed anew, or dropped.
        listing: source_path, size, modified, session_id."""
        entries, deps = self._read(self.files, FILES), self._read(self.deps, DEPS)
        now = listing.select("source_path", F.col("size").alias("now_size"), F.col("modified").alias("now_modified"), F.lit(True).alias("listed"))
        both = entries.withColumn("known", F.lit(True)).join(now, "source_path", "full")
        same = (F.col("parser") == self.parser) & (F.col("size") == F.col("now_size")) & (F.col("modified") == F.col("now_modified"))
        own = both.select("source_path", F.when(F.col("listed").isNull(), "gone").when(F.col("known").isNull(), "new").when(~same, "changed").alias("reason"))
        candidates = entries.filter("parent_id is not null").select("source_path", F.col("parent_id").alias("session_id")).join(listing.select("session_id", F.col("source_path").alias("dep_path"), "size", "modified"), "session_id").drop("session_id")
        keys = ["source_path", "dep_path", "size", "modified"]
        held = deps.join(entries.select("source_path"), "source_path", "left_semi").select(keys)
        differ = held.select(*keys, F.lit(1).alias("side")).union(candidates.select(*keys, F.lit(-1).alias("side"))).groupBy(keys).agg(F.sum("side").alias("side")).filter("side <> 0").select("source_path").distinct()
        moved = own.filter("reason is null").join(differ, "source_path", "left_semi").select("source_path", F.lit("parent").alias("reason"))
        return own.filter("reason is not null").union(moved)

    def refresh(self, listing: DataFrame, parents: Callable[[DataFrame], DataFrame], compute: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """All files' rows, after computing what is stale. parents(paths): source_path, parent_id of files that have a
        parent; compute(paths, needed): the rows of paths, which may read `needed` (source_path), the files of their
        parents. Returns rows."""
        listing = cut(listing.select("source_path", F.col("size").cast("long").alias("size"), F.col("modified").cast("long").alias("modified"), "session_id"), "listing")
        stale = cut(self.stale(listing), "stale")
        if stale.isEmpty():
            return self.rows.read()
        redo = stale.filter("reason <> 'gone'").select("source_path")
        forks = cut(parents(redo).select("source_path", "parent_id"), "forks")
        found = cut(forks.join(listing.select(F.col("session_id").alias("parent_id"), F.col("source_path").alias("dep_path"), "size", "modified"), "parent_id").select("source_path", "dep_path", "size", "modified"), "found")
        rows = compute(redo, found.select(F.col("dep_path").alias("source_path")).distinct())
        self.rows.replace_files(rows, stale)
        self.deps.replace_files(found, stale)
        entries = listing.join(redo, "source_path", "left_semi").join(forks, "source_path", "left")
        whole = entries.join(found.select("source_path", F.lit(True).alias("resolved")).distinct(), "source_path", "left").filter("parent_id is null or resolved")
        self.files.replace_files(whole.select("source_path", F.lit(self.parser).alias("parser"), "size", "modified", "parent_id"), stale)
        for t in (self.files, self.deps, self.rows):
            t.compact()
        return self.rows.read()
