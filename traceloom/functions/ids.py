"""Record identity and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _framed(data: Column) -> Column:
    """Length as 8 bytes, little-endian, then the bytes."""
    size = F.reverse(F.regexp_extract_all(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0"), F.lit("(..)"), F.lit(1)))
    return F.concat(F.unhex(F.array_join(size, "")), data)


def _field(label: str, value: Column) -> Column:
    return F.concat(_framed(F.lit(label).cast("binary")), _framed(F.coalesce(value.cast("string"), F.lit("")).cast("binary")))


def canonical_record_id() -> Column:
    """Identity of a record over its columns: rid1_ and the SHA-256 of labelled, length-prefixed fields.

    A record with an event id of its source (or, for a tool call, the tool's id) is known by it within its session;
    any other by session, file and turn.
    """
    c, none = F.col, F.lit(b"")
    event, tool = c("event_id").isNotNull(), (c("role") == "tool_use") & c("source_tool_use_id").isNotNull()
    native = F.concat(
        _field("session", F.when(c("session_id") == "", c("source_path")).otherwise(c("session_id"))),
        F.when(event, _field("event", c("event_id"))).otherwise(none),
        F.when(~event & tool, _field("source-tool-use", c("source_tool_use_id"))).otherwise(none),
    )
    by_place = F.concat(_field("session", c("session_id")), _field("source-path", c("source_path")), _field("turn", c("turn_id")))
    whole = F.concat(
        _field("version", F.lit("rid1")), _field("source", c("source")), F.when(event | F.coalesce(tool, F.lit(False)), native).otherwise(by_place),
        _field("role", c("role")), _field("tool", c("tool_name")),
    )
    return F.concat(F.lit("rid1_"), F.sha2(whole, 256))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    data = F.hex(F.coalesce(text, F.lit("")).cast("binary"))
    codes = F.transform(F.filter(F.regexp_extract_all(data, F.lit("(..)"), F.lit(1)), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
