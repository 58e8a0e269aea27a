"""Transcript files as lines, and which files belong to what."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, roots: list[str] | str, glob: str = "*.jsonl") -> DataFrame:
    """value, source_path, line_no (from 0), size, modified (ms) of all files below the roots."""
    df = spark.read.text(roots, recursiveFileLookup=True, pathGlobFilter=glob).select(
        "value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_size").alias("size"),
        F.unix_millis("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"),
    )
    w = Window.partitionBy("source_path").orderBy("_block", "_id")
    return df.withColumn("line_no", F.row_number().over(w) - 1).drop("_block", "_id")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression; * and ? also match a slash."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def excluded(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out |= path.rlike(glob_pattern(g))
    return out


def parsed(df: DataFrame, schema: str, into: str = "_e") -> DataFrame:
    """df with the JSON of `value`, parsed once a row. It is a generator's output: Spark moves filters below a plain
    column's expression, and each of them would write and parse the text again."""
    return df.withColumn(into, F.explode(F.array(F.from_json("value", schema))))


def session_from_path(path: Column) -> Column:
    """The last UUID in the file's name, else its stem."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    ids = F.regexp_extract_all(name, F.lit(r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"), F.lit(1))
    return F.coalesce(F.try_element_at(ids, F.lit(-1)), name)


#: A part of the path that tells a source, in order; what has none is claude's.
PATHS = (("/.codex/", "codex"), ("/.pi/", "pi"), ("/.omp/", "omp"), ("/.openclaw/", "openclaw"), ("/opencode/", "opencode"), ("/.cursor/", "cursor"), ("/.copilot/", "copilot"), ("/.hermes/", "hermes"))


def classify(path: Column) -> Column:
    out = None
    for part, source in PATHS:
        out = F.when(path.contains(part), source) if out is None else out.when(path.contains(part), source)
    return out.otherwise("claude")


def purge(stored: DataFrame, present: DataFrame, globs: list[str] = ()) -> DataFrame:
    """Stored rows whose file is still there and not excluded. present: source_path."""
    return stored.join(present.select("source_path").distinct(), "source_path", "left_semi").filter(~excluded(F.col("source_path"), list(globs)))


def audit(lines: DataFrame, kind: str = "$.type", version: str = "$.version") -> DataFrame:
    """source_path, lines, malformed, types and versions (counts); no other value is read."""
    l = lines.withColumns({"_ok": F.expr("try_parse_json(value)").isNotNull(), "_type": F.get_json_object("value", kind), "_version": F.get_json_object("value", version)})
    count = lambda c: l.filter(F.col(c).isNotNull()).groupBy("source_path", c).count().groupBy("source_path").agg(F.map_from_entries(F.collect_list(F.struct(c, "count"))).alias(c[1:] + "s"))
    base = l.groupBy("source_path").agg(F.count("*").alias("lines"), F.count_if(~F.col("_ok")).alias("malformed"))
    return base.join(count("_type"), "source_path", "left").join(count("_version"), "source_path", "left")
