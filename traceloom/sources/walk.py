"""Token counts anywhere in nested JSON: dialects that have no fixed place for them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the counts and of what stands beside them.
INPUT = ("inputTokens", "input_tokens", "promptTokens", "gen_ai.usage.input_tokens")
OUTPUT = ("outputTokens", "output_tokens", "completionTokens", "gen_ai.usage.output_tokens")
READ = ("cacheReadTokens", "cache_read_tokens", "gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_read_input_tokens")
WRITE = ("cacheWriteTokens", "cache_write_tokens", "gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_creation_input_tokens")
REASONING = ("reasoningTokens", "reasoning_tokens", "gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens")
MODEL = ("model", "modelName", "gen_ai.response.model", "gen_ai.request.model")
IDS = ("usageUuid", "requestId", "bubbleId", "id", "spanId")
FOUND = "array<struct<id: string, trace: string, session: string, model: string, input: long, output: long, cached: long, written: long, reasoning: long, ts: string>>"


def _pick(node: dict, names: tuple[str, ...], kind: type):
    for n in names:
        v = node.get(n)
        if isinstance(v, kind) and not isinstance(v, bool) and v != "":
            return v
    return None


def counts(node, above: dict | None = None) -> list[dict]:
    """Nodes with token counts, outermost first; a usage node below one that was counted is not counted again."""
    out: list[dict] = []
    if isinstance(node, list):
        for x in node:
            out += counts(x, above)
    elif isinstance(node, dict):
        flat = node
        if isinstance(node.get("attributes"), dict):
            flat = {**node["attributes"], **node}
        own = flat.get("usage") if isinstance(flat.get("usage"), dict) else flat.get("tokenCount") if isinstance(flat.get("tokenCount"), dict) else flat
        i, o = _pick(own, INPUT, (int, float)), _pick(own, OUTPUT, (int, float))
        here = {**(above or {}), **{k: v for k, v in flat.items() if not isinstance(v, (dict, list))}}
        counted = (i or 0) + (o or 0) > 0
        if counted:
            n = lambda names: int(_pick(own, names, (int, float)) or 0)
            out.append({
                "id": _pick(flat, IDS, str), "trace": flat.get("traceId") if isinstance(flat.get("traceId"), str) else None, "session": _pick(here, ("composerId", "conversationId", "gen_ai.conversation.id", "sessionId"), str),
                "model": _pick(here, MODEL, str), "input": int(i or 0), "output": int(o or 0), "cached": n(READ), "written": n(WRITE), "reasoning": n(REASONING),
                "ts": str(_pick(here, ("createdAt", "timestamp", "startTimeUnixNano"), (str, int, float)) or ""),
            })
        for k, v in node.items():
            if isinstance(v, (dict, list)) and not (counted and k in ("usage", "tokenCount", "attributes")):
                out += counts(v, here)
    return out


def parse(text: str | None) -> list[dict]:
    try:
        return counts(json.loads(text or ""))
    except (ValueError, RecursionError):
        return []


def token_counts(text: Column | str) -> Column:
    @F.pandas_udf(FOUND)
    def found(s: pd.Series) -> pd.Series:
        return s.map(parse)

    return found(text)
