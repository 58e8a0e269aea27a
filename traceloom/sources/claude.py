"""Transcripts of the first dialect: records and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projects import decode_slug
from ..functions.times import parse_source_ts
from ..operators.usage import disjoint_buckets, total_tokens
from ..schema import USAGE_EVENTS, columns
from . import emit, lines

_BLOCK = "struct<type: string, text: string, thinking: string, id: string, name: string, input: string, tool_use_id: string, content: string>"
_ENTRY = (
    "type string, uuid string, parentUuid string, logicalParentUuid string, sessionId string, session_id string, cwd string, isSidechain boolean, timestamp string, "
    "requestId string, request_id string, costUSD double, parentToolUseID string, sourceToolUseID string, sourceToolAssistantUUID string, "
)
_USAGE = (
    "struct<input_tokens: long, inputTokens: long, cache_read_input_tokens: long, cacheReadInputTokens: long, cache_creation_input_tokens: long, "
    "cacheCreationInputTokens: long, output_tokens: long, outputTokens: long, cache_creation: struct<ephemeral_1h_input_tokens: long>>"
)


def kept(path: Column, include_agents: bool = False) -> Column:
    """Which files are read: agents' ones only if wanted."""
    agent = F.element_at(F.split(path, "/"), -1).startswith("agent-") | path.contains("/subagents/")
    return F.lit(True) if include_agents else ~agent


def project_of(path: Column) -> Column:
    return decode_slug(F.regexp_extract(path, r"/projects/([^/]+)/", 1))


def records(files: DataFrame, include_reasoning: bool = False) -> DataFrame:
    """files: lines.read(). A line's tool calls (and thoughts, if wanted) come first, then tool results, then its text."""
    e = F.from_json("value", _ENTRY + "message struct<content: string>")
    blocks = F.from_json("value", f"message struct<content: array<{_BLOCK}>>")["message"]["content"]
    df = files.withColumns({"_e": e, "_blocks": blocks}).filter(F.col("_e.type").isin("user", "assistant") & F.col("_e.message").isNotNull())
    x, b = F.col("_e"), F.coalesce(F.col("_blocks"), F.array().cast(f"array<{_BLOCK}>"))
    uuid = x["uuid"]

    def of_block(block: Column, i: Column) -> Column:
        use = emit.emission(role=F.lit("tool_use"), text=F.coalesce(block["input"], F.lit("")), tool_name=block["name"], tool_input=block["input"], event_id=block["id"], parent_event_id=F.when(block["id"].isNotNull(), uuid))
        thought = emit.emission(role=F.lit("reasoning"), text=F.trim(block["thinking"]), event_id=F.concat(uuid, F.lit(":reasoning:"), i.cast("string")))
        wanted = F.lit(include_reasoning) & (block["type"] == "thinking") & (F.trim(block["thinking"]) != "")
        return F.when(block["type"] == "tool_use", use).when(wanted, thought)

    def of_result(block: Column) -> Column:
        parts = F.from_json(block["content"], "array<struct<type: string, text: string>>")
        call = block["tool_use_id"]
        return emit.emission(role=F.lit("tool_result"), text=emit.result_text(block["content"], parts), tool_output=block["content"], event_id=F.concat(uuid, F.lit(":tool_result:"), call), parent_event_id=call, parent_tool_use_id=call)

    results = F.transform(F.filter(b, lambda k: (k["type"] == "tool_result") & (x["type"] == "user")), of_result)
    texts = F.when(F.col("_blocks").isNotNull(), F.transform(F.filter(b, lambda k: k["type"] == "text"), lambda k: k["text"])).otherwise(F.array(x["message"]["content"]))
    said = emit.text_of(texts, " ")
    own = emit.one(said != "", emit.emission(role=x["type"], text=said))
    side = F.coalesce(x["isSidechain"], F.lit(False))
    agent = ~kept(F.col("source_path"))
    kind = F.when(agent, "subagent").when(side, "sidechain").otherwise("main")
    df = df.withColumns({
        "emissions": F.concat(F.array_compact(F.transform(b, of_block)), results, own), "ts": parse_source_ts(x["timestamp"]), "session_id": lines.session_from_path(F.col("source_path")),
        "project": project_of(F.col("source_path")), "event_id": uuid, "parent_event_id": x["parentUuid"], "logical_parent_event_id": x["logicalParentUuid"],
        "parent_session_id": F.when(agent, x["sessionId"]), "thread_source": F.when(kind != "main", kind), "conversation_kind": kind, "parent_tool_use_id": x["parentToolUseID"],
        "source_tool_use_id": x["sourceToolUseID"], "source_tool_assistant_uuid": x["sourceToolAssistantUUID"],
    })
    return emit.records(df, "claude")


def usage(files: DataFrame) -> DataFrame:
    """Usage events; lines without the word usage are not parsed."""
    df = lines.parsed(files.filter(F.col("value").contains('"usage"')), _ENTRY + f"message struct<id: string, model: string, usage: {_USAGE}>").filter((F.col("_e.type") == "assistant") & F.col("_e.message.usage").isNotNull())
    x, m = F.col("_e"), F.col("_e.message")
    n = lambda *names: F.greatest(F.coalesce(*(m["usage"][k] for k in names), F.lit(0)), F.lit(0)).cast("long")
    s = lambda *names: F.nullif(F.coalesce(*(x[k] for k in names)), F.lit(""))
    write = n("cache_creation_input_tokens", "cacheCreationInputTokens")
    buckets = disjoint_buckets(n("input_tokens", "inputTokens"), n("cache_read_input_tokens", "cacheReadInputTokens"), write, n("output_tokens", "outputTokens"))
    message, request = F.nullif(m["id"], F.lit("")), s("requestId", "request_id")
    df = df.withColumns({
        **buckets, "source": F.lit("claude"), "source_record_id": F.concat(F.lit("line:"), F.col("line_no").cast("string")), "session_id": F.coalesce(s("sessionId", "session_id"), lines.session_from_path(F.col("source_path"))),
        "request_id": request, "message_id": message, "project": x["cwd"], "provider": F.lit("anthropic"), "model": F.nullif(m["model"], F.lit("")), "timestamp_ms": parse_source_ts(x["timestamp"]),
        "cache_write_1h": F.least(F.coalesce(m["usage"]["cache_creation"]["ephemeral_1h_input_tokens"], F.lit(0)), write), "reasoning": F.lit(0).cast("long"), "source_cost_usd": x["costUSD"],
        "cost_authoritative": F.lit(False), "conservative_undercount": F.lit(False), "cache_chain_excluded": F.lit(False), "sidechain": F.coalesce(x["isSidechain"], F.lit(False)),
        "dedupe_confidence": F.when(message.isNotNull() & request.isNotNull(), "exact").otherwise("heuristic"), "source_order": F.col("line_no").cast("long"),
    })
    return df.filter(total_tokens() > 0).select(*columns(USAGE_EVENTS))
