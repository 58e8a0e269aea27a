"""Rollouts and prompt history of the second dialect: records and usage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..functions.times import parse_source_ts
from ..operators.usage import codex_buckets, total_tokens
from ..schema import RECORDS, USAGE_EVENTS, columns
from ..scratch import cut
from ..sinks.usage_cache import UsageCache
from ..streaming import counters
from . import emit, lines

_META = "id: string, cwd: string, forked_from_id: string, thread_source: string, source: string"
_ITEM = "type: string, role: string, content: string, name: string, call_id: string, arguments: string, input: string, output: string, action: string, query: string, text: string, model: string, turn_id: string"
_TOKENS = "struct<input_tokens: long, cached_input_tokens: long, output_tokens: long, reasoning_output_tokens: long>"
#: How texts begin that the tool itself puts into a transcript.
INSTRUCTIONS = ("<user_instructions>", "<environment_context>", "# AGENTS.md instructions", "<permissions instructions>")


def _sticky(df: DataFrame, value, into: str) -> DataFrame:
    w = Window.partitionBy("source_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(w))


def records(files: DataFrame, include_reasoning: bool = False) -> DataFrame:
    """Messages, calls and results; a file's session head holds for the lines after it."""
    df = files.withColumn("_e", F.from_json("value", f"timestamp string, type string, payload struct<{_META}, {_ITEM}>"))
    df = df.withColumn("_blocks", F.from_json("value", "payload struct<content: array<struct<type: string, text: string>>>")["payload"]["content"])
    x, p = F.col("_e"), F.col("_e.payload")
    df = _sticky(df, F.when(x["type"] == "session_meta", p), "_meta")
    meta, kind = F.col("_meta"), p["type"]
    item = x["type"] == "response_item"
    texts = F.when(F.col("_blocks").isNotNull(), F.transform("_blocks", lambda b: b["text"])).otherwise(F.array(p["content"]))
    said = emit.text_of(texts, "\n")
    ours = F.lit(False)
    for start in INSTRUCTIONS:
        ours |= said.startswith(start)
    message = emit.one(item & (kind == "message") & (said != "") & ~ours, emit.emission(role=p["role"], text=said, event_id=p["id"]))
    called = F.coalesce(p["arguments"], p["input"], p["action"], p["query"])
    name = F.coalesce(p["name"], F.when(kind == "web_search_call", "web_search").when(kind == "tool_search_call", "tool_search"))
    call = emit.one(item & kind.endswith("_call"), emit.emission(role=F.lit("tool_use"), text=F.coalesce(called, F.lit("")), tool_name=name, tool_input=called, event_id=F.coalesce(p["call_id"], p["id"])))
    out = F.coalesce(p["output"], F.lit(""))
    parts = F.from_json(out, "array<struct<type: string, text: string>>")
    result = emit.one(item & kind.endswith("_output") & (F.trim(out) != ""), emit.emission(
        role=F.lit("tool_result"), text=emit.result_text(out, parts), tool_name=F.when(kind == "tool_search_output", "tool_search"), tool_output=out, event_id=p["id"], parent_event_id=p["call_id"], parent_tool_use_id=p["call_id"],
    ))
    thought = emit.one(F.lit(include_reasoning) & (x["type"] == "event_msg") & (kind == "agent_reasoning") & (F.trim(p["text"]) != ""), emit.emission(role=F.lit("reasoning"), text=F.trim(p["text"]), event_id=p["id"]))
    fork = meta["forked_from_id"].isNotNull()
    spawned = meta["source"].contains("subagent")
    df = df.filter(x.isNotNull()).withColumns({
        "emissions": F.concat(message, call, result, thought), "ts": parse_source_ts(x["timestamp"]), "session_id": F.coalesce(meta["id"], lines.session_from_path(F.col("source_path"))),
        "project": F.coalesce(F.nullif(file_name(meta["cwd"]), F.lit("")), F.lit("codex")), "parent_session_id": meta["forked_from_id"], "thread_source": meta["thread_source"],
        "conversation_kind": F.when(F.coalesce(spawned, F.lit(False)), "subagent").when(fork, "fork").otherwise("main"),
    })
    return emit.records(df, "codex")


def history(prompts: DataFrame, rolled: DataFrame) -> DataFrame:
    """The user's prompts (JSON lines session_id, text, ts in seconds) of sessions that have no rollout."""
    df = prompts.withColumn("_e", F.from_json("value", "session_id string, text string, ts long")).filter(F.trim("_e.text") != "")
    df = df.select("source_path", "line_no", F.col("_e.session_id").alias("session_id"), F.col("_e.text").alias("_text"), (F.col("_e.ts") * 1000).alias("ts"))
    df = df.join(rolled.select("session_id").distinct(), "session_id", "left_anti")
    out = emit.records(df.withColumns({"emissions": F.array(emit.emission(role=F.lit("user"), text=F.col("_text"))), "project": F.lit("codex"), "conversation_kind": F.lit("main")}), "codex")
    return out.select(*(c for c in columns(RECORDS) if c != "doc_id"))


_PARENT = "payload struct<type: string, id: string, cwd: string, model: string, turn_id: string, forked_from_id: string, parent_session_id: string, source: string"


def _parent(p):
    return F.coalesce(p["forked_from_id"], p["parent_session_id"], F.get_json_object(p["source"], "$.subagent.thread_spawn.parent_thread_id"))


def parents(files: DataFrame) -> DataFrame:
    """source_path, parent_id of files that are forks: what their last head says."""
    df = lines.parsed(files.filter(F.col("value").contains('"session_meta"')), f"type string, {_PARENT}>")
    named = df.filter("_e.type = 'session_meta'").select("source_path", "line_no", _parent(F.col("_e.payload")).alias("parent_id")).filter("parent_id is not null")
    return named.groupBy("source_path").agg(F.max_by("parent_id", "line_no").alias("parent_id"))


def cached_usage(listing: DataFrame, read: Callable[[DataFrame], DataFrame], root: str) -> DataFrame:
    """usage() of all files of listing (source_path, size, modified), computed only for those that are new or changed
    and for forks of those. read(paths) gives the lines of files (source_path)."""
    spark = listing.sparkSession

    def compute(paths: DataFrame, needed: DataFrame) -> DataFrame:
        return usage(read(paths.union(needed).distinct())).join(paths, "source_path", "left_semi").select(*columns(USAGE_EVENTS))

    sized = listing.withColumn("session_id", lines.session_from_path(F.col("source_path")))
    return UsageCache(spark, root).refresh(sized, lambda paths: parents(read(paths)), compute)


def usage(files: DataFrame) -> DataFrame:
    """Requests from the running totals and last requests of a file, with the model, turn and folder last named before
    them. A fork starts from its parent's totals up to the time of the fork; where the parent isn't there, from its own
    first total, and its requests are marked as an undercount.

    The totals are written to the shared folder, as forks, parents and requests are all read from them."""
    wanted = [F.col("value").contains(f'"{k}"') for k in ("token_count", "session_meta", "turn_context", "task_started")]
    df = files.filter(reduce(or_, wanted))
    df = df.withColumn("_e", F.from_json("value", f"timestamp string, type string, {_PARENT}, info: struct<total_token_usage: {_TOKENS}, last_token_usage: {_TOKENS}>>"))
    p, ts = F.col("_e.payload"), parse_source_ts(F.col("_e.timestamp"))
    head = F.col("_e.type") == "session_meta"
    parent = _parent(p)
    for value, into in (
        (F.when(head, F.nullif(p["cwd"], F.lit(""))), "_cwd"), (F.when(F.col("_e.type") == "turn_context", F.nullif(p["model"], F.lit(""))), "_model"), (F.when(p["type"] == "task_started", p["turn_id"]), "_turn"),
        (F.when(head, p["id"]), "_session"), (F.when(head, parent), "parent_id"), (F.when(head & parent.isNotNull(), ts), "fork_ts"),
    ):
        df = _sticky(df, value, into)
    keys = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens"}
    total, last = p["info"]["total_token_usage"], p["info"]["last_token_usage"]
    seen = df.filter((p["type"] == "token_count") & (total.isNotNull() | last.isNotNull())).select(
        "source_path", F.col("line_no").cast("long").alias("source_order"), F.coalesce(ts, F.lit(0).cast("long")).alias("ts"), "_cwd", "_model", "_turn", "_session", "parent_id", "fork_ts",
        *(F.when(x.isNotNull(), F.coalesce(x[k], F.lit(0))).cast("long").alias(f"{start}{f}") for start, x in (("", total), ("last_", last)) for f, k in keys.items()),
    )
    nth = F.count_if(reduce(or_, (F.col(f) > 0 for f in keys))).over(Window.partitionBy("source_path").orderBy("source_order").rowsBetween(Window.unboundedPreceding, 0))
    seen = cut(seen.withColumn("_nth", nth), "totals")
    if seen.filter("parent_id is not null").isEmpty():
        dealt = seen.withColumn("_open", F.lit(False))
    else:
        sums = seen.select(lines.session_from_path(F.col("source_path")).alias("session_id"), "ts", *keys).filter(reduce(or_, (F.col(f) > 0 for f in keys)))
        forks = seen.filter("parent_id is not null").select(F.col("source_path").alias("source_order"), "parent_id", "fork_ts").distinct()
        base = counters.inherited(forks, sums, list(keys)).select(F.col("source_order").alias("source_path"), *(F.col(f).alias(f"base_{f}") for f in keys))
        again = counters.replays(seen.filter("parent_id is not null"), sums).withColumn("replayed", F.lit(True))
        fork, found = F.col("parent_id").isNotNull(), F.col("base_input").isNotNull()
        dealt = seen.join(base, "source_path", "left").join(again, ["source_path", "source_order"], "left")
        dealt = dealt.withColumn("inherited", fork & ((F.col("ts") <= F.col("fork_ts")) | (~found & (F.col("_nth") == 1) & (F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0)) > 0)))).withColumn("_open", fork & ~found)
    d = counters.deltas(dealt, ["_cwd", "_model", "_turn", "_session", "_open"]).withColumnRenamed("output", "out")
    nth = F.row_number().over(Window.partitionBy("source_path").orderBy("source_order")) - 1
    df = d.withColumns({
        **codex_buckets(F.col("input"), F.col("cached"), F.col("out")), "source": F.lit("codex"), "source_record_id": F.concat(F.lit("event:"), nth.cast("string")), "session_id": F.coalesce("_session", lines.session_from_path(F.col("source_path"))),
        "request_id": F.col("_turn"), "message_id": F.lit(None).cast("string"), "project": F.col("_cwd"), "provider": F.lit("openai"), "model": F.col("_model"), "timestamp_ms": F.col("ts"),
        "cache_write_1h": F.lit(0).cast("long"), "source_cost_usd": F.lit(None).cast("double"), "cost_authoritative": F.lit(False), "conservative_undercount": F.col("mixed") | F.col("_open"),
        "cache_chain_excluded": F.lit(False), "sidechain": F.lit(False), "dedupe_confidence": F.lit("strong"),
    })
    return df.filter(total_tokens() > 0).select(*columns(USAGE_EVENTS))
