"""Growing files: each run reads the bytes that were added since the last one, and no others.

The state of a file is a row: how far it has been read, how many lines that was, and a hash of its beginning. A file that
has grown behind the same beginning is read on from there; one that shrank, or begins otherwise, is read anew and
replaces its rows; one that is gone takes its rows with it. A line without an end waits for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut
from ..sinks.segments import Segments
from ..sources import ranges

#: Bytes at a file's beginning that tell whether it is still the same file.
HEAD = 4096
STATE = "source_path string, size long, modified long, parser int, read long, lines long, head string"


def head_hashes(files: DataFrame) -> DataFrame:
    """files (source_path, upto) with head: the hash of the first `upto` bytes, HEAD at the most."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, upto in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                with store.open_input_file(name) as f:
                    out.append(hashlib.sha256(f.read(min(upto, HEAD))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["source_path", "head"])

    return files.select("source_path", F.col("upto").cast("long")).mapInArrow(read, "source_path string, head string")


class Tail:
    """Reads a folder's files into a table of lines (source_path, line_no, value) that follows them."""

    def __init__(self, spark: SparkSession, root: str, parser: int = 1):
        self.spark, self.parser = spark, parser
        self.state, self.lines = (Segments(spark, f"{root.rstrip('/')}/{t}") for t in ("state", "lines"))

    def _state(self) -> DataFrame:
        df = self.state.read()
        return self.spark.createDataFrame([], STATE) if df is None else df

    def plan(self, listing: DataFrame) -> DataFrame:
        """source_path, action ('skip', 'append', 'replace', 'remove'), start, end, seen (lines so far). Only files that
        have grown are opened, for their first bytes."""
        old = self._state().select("source_path", *(F.col(c).alias(f"_{c}") for c in ("size", "modified", "parser", "read", "lines", "head")))
        both = listing.join(old, "source_path", "full")
        known = F.col("_parser") == self.parser
        same = known & (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
        maybe = known & (F.col("size") > F.col("_size"))
        both = cut(both.withColumn("action", F.when(F.col("size").isNull(), "remove").when(F.col("_size").isNull(), "replace").when(same, "skip").when(maybe, "grown").otherwise("replace")), "both")
        now = head_hashes(both.filter("action = 'grown'").select("source_path", F.col("_read").alias("upto")))
        both = both.join(now, "source_path", "left")
        action = F.when(F.col("action") != "grown", F.col("action")).when(F.col("head") == F.col("_head"), "append").otherwise("replace")
        on = action == "append"
        return both.select("source_path", action.alias("action"), F.when(on, F.col("_read")).otherwise(0).alias("start"), F.col("size").alias("end"), F.when(on, F.col("_lines")).otherwise(0).alias("seen"), "size", "modified")

    def advance(self, listing: DataFrame) -> DataFrame:
        """Follows the files, and returns the new lines, with the action of their file."""
        plan = cut(self.plan(listing), "plan")
        todo = plan.filter("action in ('append', 'replace')")
        found = ranges.read(ranges.split(todo.select("source_path", "start", "end")), whole=True)
        found = cut(found.join(todo.select("source_path", "action", "seen"), "source_path"), "new-lines")
        new = cut(ranges.numbered(found, F.col("seen")).drop("seen"), "numbered")
        changed = plan.filter("action <> 'skip'")
        rows = new.select("source_path", "line_no", "value")
        gone = changed.filter("action <> 'append'").select("source_path")
        self.lines.replace_files(rows, gone)
        last = new.groupBy("source_path").agg(F.max("stop").alias("upto"), F.count("*").alias("more"))
        ends = todo.join(last, "source_path", "left").select("source_path", "size", "modified", F.coalesce("upto", "start").alias("read"), (F.col("seen") + F.coalesce("more", F.lit(0))).alias("lines"))
        heads = head_hashes(ends.select("source_path", F.col("read").alias("upto")))
        state = ends.join(heads, "source_path").select("source_path", "size", "modified", F.lit(self.parser).alias("parser"), "read", "lines", "head")
        self.state.replace_files(state, changed.select("source_path"))
        return new.select("source_path", "line_no", "value", "action")

    def read(self) -> DataFrame | None:
        return self.lines.read()
