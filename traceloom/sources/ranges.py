"""Files read by ranges of bytes: only what is asked for is opened.

A line belongs to the range in which it begins. Ranges are rows, so Spark deals them out, and a large file is many of
them. Workers open files through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file in one range, and bytes read at a time.
RANGE, BUFFER = 64 << 20, 1 << 20
LINES = "source_path string, start long, value string, stop long"


def listing(spark: SparkSession, roots: list[str] | str, glob: str = "*.jsonl") -> DataFrame:
    """source_path, size, modified (ms) of all files below the roots that hold anything; no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(roots)
    return df.select(F.col("path").alias("source_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))


def split(ranges: DataFrame, most: int = RANGE) -> DataFrame:
    """ranges (source_path, start, end) in pieces of at most `most` bytes."""
    starts = F.sequence("start", F.col("end") - 1, F.lit(most).cast("long"))
    cut = ranges.filter("end > start").withColumn("_at", F.explode(starts))
    return cut.select("source_path", F.col("_at").alias("start"), F.least(F.col("_at") + most, "end").alias("end"))


def lines_of(stream, start: int, end: int, most: int | None = None, whole: bool = False) -> Iterator[tuple[int, bytes, int]]:
    """(place of its first byte, line, place behind it and its end) of lines that begin in start..end; with `whole`, only
    lines that have an end."""
    held, at = b"", start
    if start:  # the line before may reach into the range
        stream.seek(start - 1)
        while True:
            part = stream.read(BUFFER)
            cut = part.find(b"\n")
            if cut >= 0:
                at = stream.tell() - len(part) + cut + 1
                held = part[cut + 1 :]
                break
            if not part:
                return
    n = 0
    while at < end and (most is None or n < most):
        cut = held.find(b"\n")
        if cut < 0:
            part = stream.read(BUFFER)
            if part:
                held += part
                continue
            if held and not whole:
                yield at, held, at + len(held)
            return
        yield at, held[:cut], at + cut + 1
        at, held, n = at + cut + 1, held[cut + 1 :], n + 1


def read(ranges: DataFrame, most: int | None = None, whole: bool = False) -> DataFrame:
    """source_path, start and stop (of the line), value of the lines of ranges (source_path, start, end); of each range the first
    `most`. Empty lines are kept; a carriage return before the line's end goes; what is no UTF-8 is replaced."""

    def open_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["source_path", "start", "value", "stop"])
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                with store.open_input_file(name) as f:
                    for at, line, stop in lines_of(f, start, end, most, whole):
                        out.append((path, at, line.removesuffix(b"\r").decode("utf-8", "replace"), stop))
                        size += len(line)
                        if size > 4 * BUFFER:
                            yield make()
                            out, size = [], 0
        yield make()

    return ranges.select("source_path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).mapInArrow(open_ranges, LINES)


def heads(files: DataFrame, most: int = 64) -> DataFrame:
    """The first lines of files (source_path), with line_no; the rest isn't read."""
    far = F.lit(1 << 62)
    df = read(files.select("source_path", F.lit(0).alias("start"), far.alias("end")), most)
    return numbered(df)


def numbered(lines: DataFrame, first: Column | None = None) -> DataFrame:
    """lines with line_no in place of start: from 0, or from `first`."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source_path").orderBy("start")) - 1
    return lines.withColumn("line_no", (n + first if first is not None else n).cast("long"))
