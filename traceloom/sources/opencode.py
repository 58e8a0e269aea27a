"""Messages and parts in files of their own, or in a database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.usage import disjoint_buckets, total_tokens
from ..schema import USAGE_EVENTS, columns
from . import emit, lines

_MESSAGE = "id string, sessionID string, role string, time struct<created: double>, providerID string, modelID string, cost double, path struct<cwd: string>, tokens struct<input: long, output: long, reasoning: long, cache: struct<read: long, write: long>>"


def session_links(sessions: DataFrame) -> DataFrame:
    """session_id, parent_session_id, conversation_kind from session files (value: JSON)."""
    e = lines.parsed(sessions, "id string, parentID string", "e").filter("e.id is not null")
    return e.select(F.col("e.id").alias("session_id"), F.col("e.parentID").alias("parent_session_id"), F.when(F.col("e.parentID").isNotNull(), "fork").otherwise("main").alias("conversation_kind")).dropDuplicates(["session_id"])


def records(messages: DataFrame, parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """One record a message that has text: its parts' texts in the order of their files. All inputs: source_path, value."""
    m = lines.parsed(messages, _MESSAGE, "e").select("source_path", "e").filter("e.id is not null")
    p = lines.parsed(parts, "messageID string, type string, text string", "p").select(F.col("source_path").alias("part_path"), "p").filter("p.type = 'text' and p.text is not null")
    text = p.groupBy(F.col("p.messageID").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_path", F.col("p.text").alias("text")))), lambda x: x["text"]), "\n").alias("said"))  # within one message
    df = m.withColumn("id", F.col("e.id")).join(text, "id").withColumn("session_id", F.col("e.sessionID")).join(session_links(sessions), "session_id", "left")
    df = df.withColumns({
        "emissions": emit.one(F.trim("said") != "", emit.emission(role=F.col("e.role"), text=F.trim("said"))), "ts": F.coalesce(F.col("e.time.created").cast("long"), F.lit(0)),
        "project": F.coalesce(F.element_at(F.split("e.path.cwd", "/"), -1), F.lit("opencode")), "event_id": F.col("id"), "_file": F.col("source_path"),
        "source_path": F.col("session_id"), "line_no": F.struct(F.coalesce(F.col("e.time.created"), F.lit(0.0)), F.col("id")),
    })  # fmt: skip  # a session's messages are numbered together
    out = emit.records(df, "opencode")
    return out


def usage(rows: DataFrame) -> DataFrame:
    """rows: source_path, value (message JSON), priority (0: a database, 1: loose files). Reasoning counts as output."""
    df = lines.parsed(rows, _MESSAGE).filter("_e.role = 'assistant' and _e.tokens is not null")
    t = F.col("_e.tokens")
    n = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    buckets = disjoint_buckets(n(t["input"]), n(t["cache"]["read"]), n(t["cache"]["write"]), n(t["output"]) + n(t["reasoning"]))
    df = df.withColumns({
        **buckets, "source": F.lit("opencode"), "source_record_id": F.col("_e.id"), "session_id": F.col("_e.sessionID"), "request_id": F.lit(None).cast("string"), "message_id": F.col("_e.id"),
        "project": F.col("_e.path.cwd"), "provider": F.col("_e.providerID"), "model": F.col("_e.modelID"), "timestamp_ms": F.coalesce(F.col("_e.time.created").cast("long"), F.lit(0)),
        "cache_write_1h": F.lit(0).cast("long"), "reasoning": n(t["reasoning"]), "source_cost_usd": F.when(F.col("_e.cost") > 0, F.col("_e.cost")), "cost_authoritative": F.lit(False),
        "conservative_undercount": F.lit(False), "cache_chain_excluded": F.lit(False), "sidechain": F.lit(False), "dedupe_confidence": F.lit("exact"), "source_order": F.col("priority").cast("long"),
    })
    return df.filter(total_tokens() > 0).select(*columns(USAGE_EVENTS))
