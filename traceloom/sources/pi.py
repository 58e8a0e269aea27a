"""The third dialect and its relatives, which differ in name and in the models they hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..functions.times import parse_source_ts
from ..operators.usage import disjoint_buckets, total_tokens
from ..schema import USAGE_EVENTS, columns
from . import emit, lines

#: Stand-ins that are no models.
EXCLUDED_MODELS = {"openclaw": ("delivery-mirror",)}
_BLOCK = "struct<type: string, text: string, thinking: string, id: string, name: string, arguments: string>"
_USAGE = "struct<input: long, output: long, cacheRead: long, cacheWrite: long, cost: struct<total: double>>"
_ENTRY = (
    "type string, id string, parentId string, fromId string, timestamp string, cwd string, summary string, customType string, content string, modelId string, provider string, "
    "message struct<role: string, timestamp: string, content: string, toolCallId: string, toolName: string, isError: boolean, command: string, output: string, excludeFromContext: boolean, "
    f"model: string, provider: string, usage: {_USAGE}>"
)


def _read(files: DataFrame) -> DataFrame:
    w = Window.partitionBy("source_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = files.withColumns({"_e": F.from_json("value", _ENTRY), "_blocks": F.from_json("value", f"message struct<content: array<{_BLOCK}>>")["message"]["content"]}).filter(F.col("_e").isNotNull())
    head = F.when(F.col("_e.type") == "session", F.struct("_e.id", "_e.cwd", "_e.timestamp"))
    change = F.when(F.col("_e.type") == "model_change", F.struct("_e.modelId", "_e.provider"))
    return df.withColumns({"_head": F.last(head, ignorenulls=True).over(w), "_change": F.last(change, ignorenulls=True).over(w)})


def _first_ts(*texts: Column) -> Column:
    return F.coalesce(*(F.nullif(parse_source_ts(t), F.lit(0)) for t in texts), F.lit(0))


def records(files: DataFrame, source: str = "pi", include_reasoning: bool = False) -> DataFrame:
    df = _read(files)
    x, m, b = F.col("_e"), F.col("_e.message"), F.coalesce("_blocks", F.array().cast(f"array<{_BLOCK}>"))
    role = m["role"]
    texts = F.when(F.col("_blocks").isNotNull(), F.transform(F.filter(b, lambda k: k["type"] == "text"), lambda k: k["text"])).otherwise(F.array(m["content"]))
    said = emit.text_of(texts, "\n")
    failed = F.coalesce(m["isError"], F.lit(False)) & ~F.lower(said).startswith("error")

    def of_block(k: Column, i: Column) -> Column:
        use = emit.emission(role=F.lit("tool_use"), text=F.coalesce(k["arguments"], F.lit("")), tool_name=k["name"], tool_input=k["arguments"], event_id=k["id"], parent_event_id=x["id"])
        thought = emit.emission(role=F.lit("reasoning"), text=F.trim(k["thinking"]), event_id=F.concat(x["id"], F.lit(":reasoning:"), i.cast("string")))
        return F.when(k["type"] == "toolCall", use).when(F.lit(include_reasoning) & (k["type"] == "thinking") & (F.trim(k["thinking"]) != ""), thought)

    own = emit.one(role.isin("user", "assistant") & (said != ""), emit.emission(role=role, text=said))
    shown = F.when(failed, F.concat(F.lit("Error: "), said)).otherwise(said)
    result = emit.one((role == "toolResult") & (said != ""), emit.emission(role=F.lit("tool_result"), text=shown, tool_name=m["toolName"], tool_output=m["content"], parent_tool_use_id=m["toolCallId"]))
    ran = F.trim(F.concat_ws("\n", F.concat(F.lit("$ "), m["command"]), m["output"]))
    bash = emit.one((role == "bashExecution") & ~F.coalesce(m["excludeFromContext"], F.lit(False)) & (ran != ""), emit.emission(role=F.lit("tool_result"), text=ran, tool_name=F.lit("bash"), tool_input=m["command"], tool_output=m["output"]))
    summed = emit.one(x["type"].isin("branch_summary", "compaction") & (F.trim(x["summary"]) != ""), emit.emission(role=F.lit("system"), text=F.trim(x["summary"])))
    custom = emit.one((x["type"] == "custom_message") & (F.trim(x["content"]) != ""), emit.emission(role=F.lit("system"), text=F.trim(x["content"]), tool_name=x["customType"]))
    head = F.col("_head")
    df = df.withColumns({
        "emissions": F.concat(F.array_compact(F.transform(b, of_block)), own, result, bash, summed, custom), "ts": _first_ts(x["timestamp"], m["timestamp"], head["timestamp"]),
        "session_id": F.coalesce(head["id"], lines.session_from_path(F.col("source_path"))), "project": F.coalesce(F.nullif(file_name(head["cwd"]), F.lit("")), F.lit(source)),
        "event_id": x["id"], "parent_event_id": x["parentId"], "logical_parent_event_id": x["fromId"],
        "conversation_kind": F.when(x["type"] == "branch_summary", "branch").when(x["type"] == "compaction", "compaction").otherwise("main"),
    })
    return emit.records(df, source)


def usage(files: DataFrame, source: str = "pi") -> DataFrame:
    df = _read(files.filter(F.col("value").contains('"usage"') | F.col("value").contains('"session"') | F.col("value").contains("model_change")))
    x, m, head, change = F.col("_e"), F.col("_e.message"), F.col("_head"), F.col("_change")
    n = lambda k: F.greatest(F.coalesce(m["usage"][k], F.lit(0)), F.lit(0)).cast("long")
    model = F.coalesce(F.nullif(m["model"], F.lit("")), F.nullif(change["modelId"], F.lit("")))
    hidden = EXCLUDED_MODELS.get(source, ())
    df = df.filter(m["usage"].isNotNull()).withColumns({
        **disjoint_buckets(n("input"), n("cacheRead"), n("cacheWrite"), n("output")), "source": F.lit(source), "source_record_id": x["id"], "session_id": F.coalesce(head["id"], lines.session_from_path(F.col("source_path"))),
        "request_id": F.lit(None).cast("string"), "message_id": x["id"], "project": head["cwd"], "provider": F.coalesce(F.nullif(m["provider"], F.lit("")), F.nullif(change["provider"], F.lit(""))),
        "model": F.when(~model.isin(*hidden), model) if hidden else model, "timestamp_ms": _first_ts(x["timestamp"], m["timestamp"], head["timestamp"]), "cache_write_1h": F.lit(0).cast("long"), "reasoning": F.lit(0).cast("long"),
        "source_cost_usd": m["usage"]["cost"]["total"], "cost_authoritative": F.lit(False), "conservative_undercount": F.lit(False), "cache_chain_excluded": F.lit(False), "sidechain": F.lit(False),
        "dedupe_confidence": F.lit("exact"), "source_order": F.col("line_no").cast("long"),
    })
    return df.filter(total_tokens() > 0).select(*columns(USAGE_EVENTS))
