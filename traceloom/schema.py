"""Schemas of the normalised tables."""

from __future__ import annotations

LINKS = (
    "event_id", "parent_event_id", "logical_parent_event_id", "parent_session_id", "thread_source", "conversation_kind",
    "parent_tool_use_id", "source_tool_use_id", "source_tool_assistant_uuid",
)

RECORDS = (
    "source string, doc_id long, ts long, project string, session_id string, turn_id long, role string, text string, "
    "tool_name string, tool_input string, tool_output string, " + ", ".join(f"{c} string" for c in LINKS) + ", source_path string"
)

USAGE_EVENTS = (
    "source string, source_path string, source_record_id string, session_id string, request_id string, message_id string, "
    "project string, provider string, model string, timestamp_ms long, raw_input long, uncached_input long, cache_read long, "
    "cache_write long, cache_write_1h long, output long, reasoning long, source_cost_usd double, cost_authoritative boolean, "
    "conservative_undercount boolean, cache_chain_excluded boolean, sidechain boolean, dedupe_confidence string, source_order long"
)

QRELS = (
    "id string, query string, queries array<string>, cwd string, relevant array<struct<machine: string, source: string, "
    "session_id: string, source_path: string, doc_id: long, record_id: string, relevance: double>>"
)

VECTORS = "doc_id long, embedding array<float>"


def columns(ddl: str) -> list[str]:
    """Column names of a flat schema string."""
    return [c.strip().split(" ")[0] for c in ddl.split(",")]
