"""Transcripts by message with the file's own time, and usage from editor databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import fnv1a
from ..functions.times import parse_source_ts
from ..operators.usage import disjoint_buckets, total_tokens
from ..schema import USAGE_EVENTS, columns
from . import emit
from .walk import token_counts

_BLOCK = "struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string>"
SUBAGENT_BASE, SUBAGENT_TURNS, SUBAGENT_BUCKETS = 1_000_000_000, 50_000, 65_536


def turn_base(path: Column) -> Column:
    """Where a subagent's turns begin: far above its parent's, by a stable hash of its file."""
    bucket = fnv1a(path) % SUBAGENT_BUCKETS
    return F.when(path.contains("/subagents/"), F.lit(SUBAGENT_BASE) + bucket * SUBAGENT_TURNS).otherwise(F.lit(0))


def records(files: DataFrame) -> DataFrame:
    """files: lines.read()."""
    df = files.withColumns({"_e": F.from_json("value", "role string, message struct<content: string>"), "_blocks": F.from_json("value", f"message struct<content: array<{_BLOCK}>>")["message"]["content"]})
    x, b = F.col("_e"), F.coalesce("_blocks", F.array().cast(f"array<{_BLOCK}>"))
    df = df.filter(x["role"].isin("user", "assistant"))
    texts = F.when(F.col("_blocks").isNotNull(), F.transform(F.filter(b, lambda k: k["type"] == "text"), lambda k: k["text"])).otherwise(F.array(x["message"]["content"]))
    said = emit.text_of(texts, "\n")
    use = F.transform(F.filter(b, lambda k: k["type"] == "tool_use"), lambda k: emit.emission(role=F.lit("tool_use"), text=F.coalesce(k["input"], F.lit("")), tool_name=k["name"], tool_input=k["input"], event_id=k["id"]))
    result = F.transform(F.filter(b, lambda k: k["type"] == "tool_result"), lambda k: emit.emission(role=F.lit("tool_result"), text=F.coalesce(k["content"], F.lit("")), tool_name=k["name"], tool_output=k["content"], parent_tool_use_id=k["tool_use_id"]))
    parent = F.regexp_extract("source_path", r"/agent-transcripts/([^/]+)/subagents/", 1)
    stem = F.regexp_extract("source_path", r"([^/]+)\.jsonl$", 1)
    df = df.withColumns({
        "emissions": F.concat(emit.one(said != "", emit.emission(role=x["role"], text=said)), use, result), "ts": F.col("modified"), "session_id": stem,
        "project": F.coalesce(F.nullif(F.regexp_extract("source_path", r"/projects/([^/]+)/", 1), F.lit("")), F.lit("cursor")), "parent_session_id": F.nullif(parent, F.lit("")),
        "conversation_kind": F.when(parent != "", "subagent").otherwise("main"),
    })
    out = emit.records(df, "cursor").withColumn("turn_id", F.col("turn_id") + turn_base(F.col("source_path")))
    return out.withColumn("event_id", F.coalesce("event_id", F.concat("session_id", F.lit(":"), F.col("turn_id").cast("string"))))


def usage(rows: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """rows: source_path, line_no, value (JSON of a database row with key and value). projects: session_id, project."""
    kv = F.from_json("value", "key string, value string")
    e = rows.withColumn("_kv", kv).select("source_path", "line_no", F.col("_kv.key").alias("key"), F.posexplode(token_counts(F.col("_kv.value"))).alias("pos", "t"))
    session = F.coalesce("t.session", F.nullif(F.regexp_extract("key", r"^(?:bubbleId|composerData):([^:]+)", 1), F.lit("")))
    zero = F.lit(0).cast("long")
    df = e.withColumns({
        **disjoint_buckets(F.col("t.input"), F.col("t.cached"), F.col("t.written"), F.col("t.output")), "source": F.lit("cursor"), "source_record_id": F.col("t.id"), "session_id": session, "request_id": F.lit(None).cast("string"),
        "message_id": F.col("t.id"), "project": F.lit(None).cast("string"), "provider": F.lit(None).cast("string"), "model": F.col("t.model"), "timestamp_ms": parse_source_ts(F.col("t.ts")), "cache_write_1h": zero, "reasoning": F.col("t.reasoning"),
        "source_cost_usd": F.lit(None).cast("double"), "cost_authoritative": F.lit(False), "conservative_undercount": F.lit(False), "cache_chain_excluded": F.lit(False), "sidechain": F.lit(False),
        "dedupe_confidence": F.when(F.col("t.id").isNotNull(), "strong").otherwise("heuristic"), "source_order": F.col("line_no") * 1000 + F.col("pos"),
    }).filter(total_tokens() > 0).select(*columns(USAGE_EVENTS))
    if projects is None:
        return df
    p = projects.groupBy("session_id").agg(F.min("project").alias("_project"))
    return df.join(p, "session_id", "left").withColumn("project", F.coalesce("_project", "project")).select(*columns(USAGE_EVENTS))
