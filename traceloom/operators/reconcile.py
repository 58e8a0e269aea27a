"""Rules by which copies of one request are told apart and dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(events: DataFrame, keys: list[str], order: list[Column | str], required: list[str] = ()) -> DataFrame:
    """The first row of each key; rows with a null among `required` are no copies and stay."""
    named = F.lit(True)
    for c in required or keys:
        named &= F.col(c).isNotNull()
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumns({"_named": named, "_n": n}).filter(~F.col("_named") | (F.col("_n") == 1)).drop("_named", "_n")


def best_claude(events: DataFrame) -> DataFrame:
    """Of copies by message and request: main chain before sidechain, main files before subagents', then the larger
    total, then the later row. Then sidechain copies go where a message has a main one."""
    total = F.col("uncached_input") + F.col("cache_read") + F.col("cache_write") + F.col("output")
    w = Window.partitionBy("message_id", "request_id").orderBy(F.col("sidechain"), F.col("source_path").contains("/subagents/"), total.desc(), F.desc("source_order"))
    known = F.col("message_id").isNotNull()
    one = events.withColumn("_n", F.row_number().over(w)).filter(~known | (F.col("_n") == 1)).drop("_n")
    main = F.max(~F.col("sidechain")).over(Window.partitionBy("message_id"))
    return one.withColumn("_main", main).filter(~known | ~F.col("sidechain") | ~F.col("_main")).drop("_main")


def first_codex(events: DataFrame) -> DataFrame:
    keys = ["session_id", "source_record_id", "raw_input", "cache_read", "output", "reasoning"]
    return first_of(events, keys, ["timestamp_ms", "source_path", "source_order"], ["session_id", "source_record_id"])


def first_cursor(events: DataFrame) -> DataFrame:
    return first_of(events, ["source_record_id", "raw_input", "output"], ["source_path", "source_order"], ["source_record_id"])


def first_by_record(events: DataFrame, priority: Column | None = None) -> DataFrame:
    """Copilot and OpenCode; files of a lower priority number come first (a database before loose files)."""
    return first_of(events, ["source_record_id"], [*([priority] if priority is not None else []), "source_path", "source_order"])


RULES = {"claude": best_claude, "codex": first_codex, "cursor": first_cursor, "copilot": first_by_record, "opencode": first_by_record}


def reconcile(by_source: dict[str, DataFrame]) -> DataFrame:
    """All sources' events, each by its rule, in one table."""
    parts = [RULES.get(s, lambda df: df)(df) for s, df in by_source.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
