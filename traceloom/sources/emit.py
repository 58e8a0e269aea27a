"""From lines to records: what all dialects share.

A dialect gives, for each line, an array of emissions; they are numbered by line and place, which makes the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RECORDS, columns
from ..scratch import cut

EMISSION = ("role", "text", "tool_name", "tool_input", "tool_output", "event_id", "parent_event_id", "parent_tool_use_id")
NONE = "array<struct<" + ", ".join(f"{c}: string" for c in EMISSION) + ">>"


def emission(**values: Column) -> Column:
    return F.struct(*((values[c] if c in values else F.lit(None)).cast("string").alias(c) for c in EMISSION))


def one(condition: Column, value: Column) -> Column:
    """The emission in an array, or an empty array."""
    return F.when(condition, F.array(value)).otherwise(F.array().cast(NONE))


def text_of(parts: Column, between: str) -> Column:
    return F.trim(F.array_join(F.array_compact(parts), between))


def result_text(content: Column, blocks: Column) -> Column:
    """Text of a tool's result: its blocks' texts by line, else the content as it is."""
    joined = F.array_join(F.array_compact(F.transform(blocks, lambda b: b["text"])), "\n")
    return F.coalesce(F.nullif(joined, F.lit("")), content, F.lit(""))


def records(df: DataFrame, source: str) -> DataFrame:
    """df: emissions, ts, session_id, project, source_path, line_no and any link columns. Returns the record table
    without doc ids; results get the name of the call they answer, which each call gives once."""
    e = df.select("*", F.posexplode("emissions").alias("pos", "_emitted"))
    own = {c: F.col(f"_emitted.{c}") for c in EMISSION}
    for c in ("event_id", "parent_event_id", "parent_tool_use_id"):
        own[c] = F.coalesce(own[c], F.col(c)) if c in df.columns else own[c]
    e = e.withColumns({**own, "source": F.lit(source)})
    order = ["line_no", "pos"]
    e = e.withColumn("turn_id", F.row_number().over(Window.partitionBy("source_path").orderBy(*order)) - 1)
    call = F.when(F.col("role") == "tool_use", F.col("event_id")).when(F.col("role") == "tool_result", F.col("parent_tool_use_id"))
    e = e.withColumn("_call", call)
    w = Window.partitionBy("source_path", "_call").orderBy("turn_id")
    named = F.when((F.col("role") == "tool_result") & F.col("_call").isNotNull() & (F.lag("role").over(w) == "tool_use"), F.lag("tool_name").over(w))
    e = e.withColumn("tool_name", F.coalesce("tool_name", named))
    wanted = [c for c in columns(RECORDS) if c != "doc_id"]
    return e.select(*((F.col(c) if c in e.columns else F.lit(None).cast("string")).alias(c) for c in wanted))


def with_doc_ids(records: DataFrame, first: int = 0) -> DataFrame:
    """doc_id: dense within a file, files in order of their path. Counts are dealt in ranges of the path and added up in
    each; only one sum a range is gathered in one place."""
    sizes = records.groupBy("source_path").agg(F.count("*").alias("_n"))
    ranged = cut(sizes.repartitionByRange("source_path").withColumn("_part", F.spark_partition_id()), "sizes")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", before(Window.orderBy("_part")).alias("_start"))
    base = ranged.withColumn("_base", before(Window.partitionBy("_part").orderBy("source_path"))).join(F.broadcast(parts), "_part").select("source_path", (F.col("_start") + F.col("_base")).alias("_base"))  # a row a task
    return records.join(base, "source_path").withColumn("doc_id", F.col("_base") + F.col("turn_id") + first).drop("_base").select(*columns(RECORDS))
