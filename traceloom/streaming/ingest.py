"""What changed since the last run, and streams of records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "source_path string, size long, modified long, version long, prefix_hash long, lines long"


def plan(found: DataFrame, state: DataFrame) -> DataFrame:
    """source_path, action of each file: skip (same size, time and version), append (grown, with the same beginning),
    replace, or remove. found and state: source_path, size, modified, version, prefix_hash (and lines in state)."""
    s = state.select("source_path", *(F.col(c).alias(f"_{c}") for c in ("size", "modified", "version", "prefix_hash")))
    j = found.join(s, "source_path", "full")
    same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    grown = (F.col("size") > F.col("_size")) & (F.col("modified") >= F.col("_modified")) & (F.col("prefix_hash") == F.col("_prefix_hash"))
    action = (
        F.when(F.col("size").isNull(), "remove").when(F.col("_size").isNull(), "replace").when(F.col("version") != F.col("_version"), "replace")
        .when(same & (F.col("prefix_hash") == F.col("_prefix_hash")), "skip").when(grown, "append").otherwise("replace")
    )
    return j.select("source_path", action.alias("action"))


def describe(lines: DataFrame, version: int, head: int = 16) -> DataFrame:
    """The state of files as read: size, time, and a hash of their first lines."""
    first = F.when(F.col("line_no") < head, F.struct("line_no", "value"))
    return lines.groupBy("source_path").agg(
        F.max("size").alias("size"), F.max("modified").alias("modified"), F.lit(version).cast("long").alias("version"),
        F.xxhash64(F.to_json(F.array_sort(F.collect_list(first)))).alias("prefix_hash"), F.count("*").alias("lines"),
    )


def appended(lines: DataFrame, state: DataFrame, actions: DataFrame) -> DataFrame:
    """Lines to read: all of replaced files, and those behind what was read of files that have grown."""
    a = actions.filter(F.col("action").isin("append", "replace"))
    j = lines.join(a, "source_path").join(state.select("source_path", F.col("lines").alias("_read")), "source_path", "left")
    return j.filter((F.col("action") == "replace") | (F.col("line_no") >= F.coalesce("_read", F.lit(0)))).drop("_read")


def name_results(stream: DataFrame) -> DataFrame:
    """A stream of records (session_id, turn_id, role, call_id, tool_name) with results named after the call they
    answer; calls wait in the state, across batches and runs, until they are answered once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("turn_id", kind="stable")
        names = []
        for r in rows.itertuples():
            if r.role == "tool_use" and r.call_id:
                waiting[r.call_id] = r.tool_name
                names.append(r.tool_name)
            elif r.role == "tool_result" and r.call_id:
                names.append(waiting.pop(r.call_id, r.tool_name))
            else:
                names.append(r.tool_name)
        state.update((json.dumps(waiting),))
        yield rows.assign(tool_name=names)

    schema = "session_id string, turn_id long, role string, call_id string, tool_name string"
    return stream.select("session_id", "turn_id", "role", "call_id", "tool_name").groupBy("session_id").applyInPandasWithState(step, schema, "waiting string", "append", "NoTimeout")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Starts a query that hands each batch on: all that is there, or every so many seconds."""
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def daily_totals(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events by day and source from a stream; days older than `late` behind the newest event are closed."""
    at = F.timestamp_millis(F.col(ts))
    return stream.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", "1 day").alias("day"), "source").agg(F.count("*").alias("events"))
