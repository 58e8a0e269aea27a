"""Session events, and usage from telemetry spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..functions.times import parse_source_ts
from ..operators.usage import codex_buckets, total_tokens
from ..schema import USAGE_EVENTS, columns
from . import emit, lines
from .walk import token_counts

_DATA = "struct<sessionId: string, context: struct<cwd: string>, cwd: string, content: string, text: string, summary: string, toolName: string, name: string, arguments: string, input: string, toolCallId: string, callId: string, result: string, output: string, parentSessionId: string>"


def records(files: DataFrame) -> DataFrame:
    df = lines.parsed(files, f"type string, id string, parentId string, timestamp string, data {_DATA}").filter(F.col("_e.type").isNotNull())
    x, d = F.col("_e"), F.col("_e.data")
    w = Window.partitionBy("source_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_session": F.last(F.when(x["type"].startswith("session."), d["sessionId"]), ignorenulls=True).over(w), "_cwd": F.last(F.when(x["type"].startswith("session."), F.coalesce(d["context"]["cwd"], d["cwd"])), ignorenulls=True).over(w)})
    kind = x["type"]
    said = F.trim(F.coalesce(d["content"], d["text"], d["summary"], F.lit("")))
    call = F.coalesce(d["toolCallId"], d["callId"])
    name, given = F.coalesce(d["toolName"], d["name"]), F.coalesce(d["arguments"], d["input"])
    out = F.coalesce(d["result"], d["output"], F.lit(""))
    shown = F.coalesce(F.get_json_object(out, "$.content"), F.get_json_object(out, "$.text"), out)
    message = emit.one(kind.isin("user.message", "assistant.message") & (said != ""), emit.emission(role=F.regexp_extract(kind, r"^(\w+)\.", 1), text=said))
    use = emit.one(kind == "tool.execution_start", emit.emission(role=F.lit("tool_use"), text=F.coalesce(given, F.lit("")), tool_name=name, tool_input=given, event_id=call, parent_event_id=x["id"]))
    result = emit.one((kind == "tool.execution_complete") & (F.trim(shown) != ""), emit.emission(role=F.lit("tool_result"), text=shown, tool_name=name, tool_output=out, parent_event_id=call, parent_tool_use_id=call))
    done = emit.one((kind == "session.task_complete") & (said != ""), emit.emission(role=F.lit("assistant"), text=said))
    session = F.coalesce("_session", F.nullif(F.regexp_extract("source_path", r"/session-state/([^/]+)/", 1), F.lit("")), lines.session_from_path(F.col("source_path")))
    fork = d["parentSessionId"].isNotNull() & (d["parentSessionId"] != session)
    df = df.withColumns({
        "emissions": F.concat(message, use, result, done), "ts": parse_source_ts(x["timestamp"]), "session_id": session, "project": F.coalesce(F.nullif(file_name(F.col("_cwd")), F.lit("")), F.lit("copilot")),
        "event_id": x["id"], "parent_event_id": x["parentId"], "parent_session_id": F.when(fork, d["parentSessionId"]), "conversation_kind": F.when(fork, "fork").otherwise("main"),
    })
    out = emit.records(df, "copilot")
    return out.withColumn("event_id", F.coalesce("event_id", F.concat("session_id", F.lit(":"), F.col("turn_id").cast("string"))))


def usage(files: DataFrame) -> DataFrame:
    """Spans with token counts: known by trace and span, else by their place and counts."""
    e = files.filter(F.col("value").contains("gen_ai") | F.col("value").contains("okens")).select("source_path", "line_no", F.posexplode(token_counts("value")).alias("pos", "t"))
    span = F.concat_ws(":", "t.trace", "t.id")
    rid = F.coalesce(F.nullif(span, F.lit("")), F.concat_ws(":", "source_path", F.col("line_no").cast("string"), F.col("t.input").cast("string"), F.col("t.output").cast("string")))
    nanos = F.col("t.ts").rlike("^[0-9]{16,}$")
    zero = F.lit(0).cast("long")
    df = e.withColumns({
        **codex_buckets(F.col("t.input"), F.col("t.cached"), F.col("t.output")), "source": F.lit("copilot"), "source_record_id": rid, "session_id": F.col("t.session"), "request_id": F.lit(None).cast("string"), "message_id": F.col("t.id"),
        "project": F.lit(None).cast("string"), "provider": F.lit("github-copilot"), "model": F.col("t.model"), "timestamp_ms": F.when(nanos, F.floor(F.col("t.ts").try_cast("decimal(30,0)") / 1_000_000).cast("long")).otherwise(parse_source_ts(F.col("t.ts"))),
        "cache_write_1h": zero, "reasoning": F.col("t.reasoning"), "source_cost_usd": F.lit(None).cast("double"), "cost_authoritative": F.lit(False), "conservative_undercount": F.lit(False), "cache_chain_excluded": F.lit(False),
        "sidechain": F.lit(False), "dedupe_confidence": F.when(span != "", "exact").otherwise("heuristic"), "source_order": F.col("line_no") * 1000 + F.col("pos"),
    })
    return df.filter(total_tokens() > 0).select(*columns(USAGE_EVENTS))
