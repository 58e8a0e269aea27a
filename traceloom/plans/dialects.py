"""Every dialect read from the driver's tables: conversations and events are written as its files would hold them, line
by line, and go through the library's parsers. The SQL says what must come out, from the tables alone.

An assistant's turn whose number leaves 1 when divided by 4 also calls a tool; a user's turn that leaves 2 answers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import claude, codex, copilot, cursor, hermes, opencode, pi
from .views import BASE_MS, USAGE_SQL, table, usage_events

MODIFIED = 1_700_000_000_000
SHOWN = ("session_id", "turn_id", "role", "text", "tool_name", "event_id", "parent_event_id", "ts", "project", "conversation_kind")

_CONV = f"""c AS (SELECT conv_id, turn, role, text, 'm' || conv_id || '-' || turn AS id, CASE WHEN turn > 0 THEN 'm' || conv_id || '-' || (turn - 1) END AS before, 'proj' || (conv_id % 7) AS project,
                 {BASE_MS} + conv_id * 1000 + turn * 60000 AS ts, role = 'assistant' AND turn % 4 = 1 AS calls, role = 'user' AND turn % 4 = 2 AS answers FROM conversations),
d AS (SELECT c.*, 'c' || c.conv_id || '-' || c.turn AS call, 'c' || c.conv_id || '-' || (c.turn - 1) AS asked, CASE WHEN p.calls THEN 'grep' END AS asked_name, '{{"q":' || c.turn || '}}' AS given, 'found ' || c.turn AS found
      FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)"""


def _records_sql(session: str, emissions: list[tuple], project: str = "project", kind: str = "'main'", ts: str = "ts") -> str:
    """emissions, in the order of a line: condition, role, text, tool name, event id, parent's event id."""
    every = " UNION ALL ".join(
        f"SELECT conv_id, turn, {k} AS pos, {session} AS session_id, {role} AS role, {text} AS text, {name} AS tool_name, {event} AS event_id, {parent} AS parent_event_id, {ts} AS ts, {project} AS project, {kind} AS conversation_kind FROM d WHERE {on}"
        for k, (on, role, text, name, event, parent) in enumerate(emissions)
    )
    numbered = f"SELECT * REPLACE (coalesce(event_id, session_id || ':' || turn_id) AS event_id) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS turn_id FROM ({every}))"
    return f"WITH {_CONV} SELECT {', '.join(SHOWN)} FROM ({numbered})"


def _turns(spark, sf_dir) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    at = lambda start, turn: F.concat(F.lit(start), c.cast("string"), F.lit("-"), turn.cast("string"))
    ms = F.lit(BASE_MS) + c * 1000 + t * 60_000
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", at("m", t).alias("id"), F.when(t > 0, at("m", t - 1)).alias("before"), F.concat(F.lit("proj"), (c % 7).cast("string")).alias("project"),
        ms.alias("ts"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), ((F.col("role") == "assistant") & (t % 4 == 1)).alias("calls"), ((F.col("role") == "user") & (t % 4 == 2)).alias("answers"),
        at("c", t).alias("call"), at("c", t - 1).alias("asked"), F.struct(t.alias("q")).alias("given"), F.concat(F.lit("found "), t.cast("string")).alias("found"), F.concat(F.lit("conv-"), c.cast("string")).alias("name"),
    )


def _json(**values) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in values.items())))


def _obj(**values) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()))


def _lines(df: DataFrame, path: Column, *values: Column, head: Column | None = None) -> DataFrame:
    """Each turn's lines, in order; a null one isn't there. head is the first line of each file."""
    n = len(values)
    rows = df.withColumn("source_path", path).select("source_path", "turn", F.posexplode(F.array(*values)).alias("k", "value")).select("value", "source_path", (F.col("turn") * n + F.col("k") + 1).cast("int").alias("line_no")).filter("value is not null")
    if head is not None:
        rows = rows.union(df.select(head.alias("value"), path.alias("source_path"), F.lit(0).alias("line_no")).distinct())
    return rows.withColumns({"size": F.lit(1).cast("long"), "modified": F.lit(MODIFIED).cast("long")})


def _shown(records: DataFrame) -> DataFrame:
    event = F.coalesce("event_id", F.concat("session_id", F.lit(":"), F.col("turn_id").cast("string")))
    return records.withColumn("event_id", event).select(*(F.col(c).cast("long").alias(c) if c == "turn_id" else F.col(c) for c in SHOWN))


def _path(start: str, *parts) -> Column:
    return F.concat(F.lit(start), *(F.lit(p) if p[:1] in "/." else F.col(p) for p in parts))


# --- records --------------------------------------------------------------------------------------------------------


def dialect_claude(spark, sf_dir):
    text = lambda: _obj(type="text", text=F.col("text"))
    none = F.lit(None).cast("string")
    block = lambda **v: _obj(**{k: v.get(k, none) for k in ("type", "text", "id", "name", "tool_use_id", "content")}, input=v.get("input", F.lit(None).cast("struct<q: int>")))
    content = F.when(F.col("calls"), F.array(block(type="text", text=F.col("text")), block(type="tool_use", id=F.col("call"), name="grep", input=F.col("given").cast("struct<q: int>")))).when(
        F.col("answers"), F.array(block(type="tool_result", tool_use_id=F.col("asked"), content=F.col("found")), block(type="text", text=F.col("text")))
    )
    line = lambda body: _json(type=F.col("role"), uuid=F.col("id"), parentUuid=F.col("before"), sessionId=F.col("name"), isSidechain=F.col("conv_id") % 5 == 0, timestamp=F.col("time"), message=_obj(role=F.col("role"), content=body))
    plain = ~(F.col("calls") | F.col("answers"))
    value = F.when(plain, line(F.col("text"))).otherwise(line(content))
    return _shown(claude.records(_lines(_turns(spark, sf_dir), _path("/home/kim/.claude/projects/-home-kim-", "project", "/", "name", ".jsonl"), value)))


_CALL = ("calls", "'tool_use'", "given", "'grep'", "call")
CLAUDE_SQL = _records_sql(
    "'conv-' || conv_id",
    [(*_CALL, "id"), ("answers", "'tool_result'", "found", "asked_name", "id || ':tool_result:' || asked", "asked"), ("role IN ('user', 'assistant')", "role", "trim(text)", "NULL", "id", "before")],
    "'kim-' || project", "CASE WHEN conv_id % 5 = 0 THEN 'sidechain' ELSE 'main' END",
)


def dialect_codex(spark, sf_dir):
    item = lambda **v: _json(type="response_item", timestamp=F.col("time"), payload=_obj(**v))
    said = item(type="message", role=F.col("role"), id=F.col("id"), content=F.array(_obj(type="output_text", text=F.col("text"))))
    call = F.when(F.col("calls"), item(type="function_call", name="grep", call_id=F.col("call"), arguments=F.to_json("given")))
    answer = F.when(F.col("answers"), item(type="function_call_output", call_id=F.col("asked"), output=F.col("found")))
    fork = F.when(F.col("conv_id") % 6 == 5, F.concat(F.lit("conv-"), (F.col("conv_id") - 1).cast("string")))
    head = _json(type="session_meta", payload=_obj(id=F.col("name"), cwd=F.concat(F.lit("/w/"), "project"), forked_from_id=fork))
    return _shown(codex.records(_lines(_turns(spark, sf_dir), _path("/home/kim/.codex/sessions/rollout-", "name", ".jsonl"), said, call, answer, head=head)))


CODEX_SQL = _records_sql(
    "'conv-' || conv_id",
    [("true", "role", "trim(text)", "NULL", "id", "NULL"), (*_CALL, "NULL"), ("answers", "'tool_result'", "found", "asked_name", "NULL", "asked")],
    kind="CASE WHEN conv_id % 6 = 5 THEN 'fork' ELSE 'main' END",
)


def _pi(spark, sf_dir, source):
    none = F.lit(None).cast("string")
    block = lambda **v: _obj(**{k: v.get(k, none) for k in ("type", "text", "id", "name")}, arguments=v.get("arguments", F.lit(None).cast("struct<q: int>")))
    entry = lambda **v: _json(type="message", id=F.col("id"), parentId=F.col("before"), timestamp=F.col("time"), message=_obj(**v))
    text = block(type="text", text=F.col("text"))
    content = F.when(F.col("calls"), F.array(text, block(type="toolCall", id=F.col("call"), name="grep", arguments=F.col("given").cast("struct<q: int>")))).otherwise(F.array(text))
    said = F.when(F.col("role") == "system", _json(type="compaction", id=F.col("id"), parentId=F.col("before"), timestamp=F.col("time"), summary=F.col("text"))).otherwise(entry(role=F.col("role"), content=content))
    answer = F.when(F.col("answers"), entry(role="toolResult", toolCallId=F.col("asked"), toolName="grep", isError=F.lit(True), content=F.array(_obj(type="text", text=F.col("found")))))
    head = _json(type="session", id=F.col("name"), cwd=F.concat(F.lit("/w/"), "project"), timestamp="2020-01-01T00:00:00Z")
    return _shown(pi.records(_lines(_turns(spark, sf_dir), _path(f"/home/kim/.{source}/sessions/", "name", ".jsonl"), said, answer, head=head), source))


def dialect_pi(spark, sf_dir):
    return _pi(spark, sf_dir, "pi")


def dialect_omp(spark, sf_dir):
    return _pi(spark, sf_dir, "omp")


def dialect_openclaw(spark, sf_dir):
    return _pi(spark, sf_dir, "openclaw")


PI_SQL = _records_sql(
    "'conv-' || conv_id",
    [(*_CALL, "id"), ("true", "role", "trim(text)", "NULL", "id", "before"), ("answers", "'tool_result'", "'Error: ' || found", "'grep'", "id", "before")],
    kind="CASE WHEN role = 'system' THEN 'compaction' ELSE 'main' END",
)


def dialect_opencode(spark, sf_dir):
    t = _turns(spark, sf_dir)
    files = lambda df, path, value: df.select(path.alias("source_path"), value.alias("value"))
    messages = files(t, _path("/data/message/", "name", "/", "id", ".json"), _json(id=F.col("id"), sessionID=F.col("name"), role=F.col("role"), time=_obj(created=F.col("ts")), path=_obj(cwd=F.concat(F.lit("/w/"), "project"))))
    halves = F.array(F.col("text").substr(F.lit(1), F.lit(20)), F.when(F.length("text") > 20, F.expr("substring(text, 21)")))
    cut = t.select("id", F.posexplode(halves).alias("k", "half")).filter("half is not null")
    parts = files(cut, F.concat(F.lit("/data/part/"), "id", F.lit("/prt-"), F.col("k").cast("string"), F.lit(".json")), _json(messageID=F.col("id"), type="text", text=F.col("half")))
    fork = F.when(F.col("conv_id") % 6 == 5, F.concat(F.lit("conv-"), (F.col("conv_id") - 1).cast("string")))
    sessions = files(t.select("name", "conv_id").distinct(), _path("/data/session/", "name", ".json"), _json(id=F.col("name"), parentID=fork))
    return _shown(opencode.records(messages, parts, sessions))


OPENCODE_SQL = _records_sql(
    "'conv-' || conv_id", [("true", "role", "trim(substr(text, 1, 20) || CASE WHEN length(text) > 20 THEN chr(10) || substr(text, 21) ELSE '' END)", "NULL", "id", "NULL")],
    kind="CASE WHEN conv_id % 6 = 5 THEN 'fork' ELSE 'main' END",
)


def dialect_cursor(spark, sf_dir):
    none = F.lit(None).cast("string")
    block = lambda **v: _obj(**{k: v.get(k, none) for k in ("type", "text", "id", "name", "tool_use_id", "content")}, input=v.get("input", F.lit(None).cast("struct<q: int>")))
    text = block(type="text", text=F.col("text"))
    content = F.when(F.col("calls"), F.array(text, block(type="tool_use", id=F.col("call"), name="grep", input=F.col("given").cast("struct<q: int>")))).when(F.col("answers"), F.array(text, block(type="tool_result", tool_use_id=F.col("asked"), content=F.col("found")))).otherwise(F.array(text))
    value = _json(role=F.col("role"), message=_obj(content=content))
    return _shown(cursor.records(_lines(_turns(spark, sf_dir), _path("/home/kim/.cursor/projects/", "project", "/agent-transcripts/", "name", ".jsonl"), value)))


CURSOR_SQL = _records_sql(
    "'conv-' || conv_id",
    [("role IN ('user', 'assistant')", "role", "trim(text)", "NULL", "NULL", "NULL"), (*_CALL, "NULL"), ("answers", "'tool_result'", "found", "asked_name", "NULL", "NULL")],
    ts=f"CAST({MODIFIED} AS BIGINT)",
)


def dialect_copilot(spark, sf_dir):
    event = lambda kind, **v: _json(type=kind, id=F.col("id"), parentId=F.col("before"), timestamp=F.col("time"), data=_obj(**v))
    said = event(F.concat("role", F.lit(".message")), content=F.col("text"))
    call = F.when(F.col("calls"), event("tool.execution_start", toolCallId=F.col("call"), toolName="grep", arguments=F.col("given")))
    answer = F.when(F.col("answers"), event("tool.execution_complete", toolCallId=F.col("asked"), result=_obj(content=F.col("found"))))
    head = _json(type="session.start", data=_obj(sessionId=F.col("name"), context=_obj(cwd=F.concat(F.lit("/w/"), "project"))))
    return _shown(copilot.records(_lines(_turns(spark, sf_dir), _path("/home/kim/.copilot/session-state/", "name", "/events.jsonl"), said, call, answer, head=head)))


COPILOT_SQL = _records_sql(
    "'conv-' || conv_id",
    [("role IN ('user', 'assistant')", "role", "trim(text)", "NULL", "id", "before"), (*_CALL, "id"), ("answers", "'tool_result'", "found", "asked_name", "id", "asked")],
)

# --- usage ----------------------------------------------------------------------------------------------------------

COUNTED = ("session_id", "message_id", "model", "timestamp_ms", "raw_input", "uncached_input", "cache_read", "cache_write", "cache_write_1h", "output", "reasoning", "source_cost_usd", "sidechain")
_EVENTS = f"WITH e AS ({USAGE_SQL})"


def _events(spark, sf_dir) -> DataFrame:
    e = usage_events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("source_path").orderBy("source_order"))
    time = F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return e.withColumns({"turn": n.cast("int"), "time": time, "name": F.regexp_extract("source_path", r"(\d+)\.jsonl$", 1)})


def _counted(df: DataFrame) -> DataFrame:
    return df.select(*COUNTED)


def _usage_sql(total: str = "uncached_input + cache_read + cache_write + output", **other: str) -> str:
    own = {"session_id": "session_id", "message_id": "message_id", "model": "model", "sidechain": "false", "reasoning": "CAST(0 AS BIGINT)", "cache_write_1h": "CAST(0 AS BIGINT)", **other}
    shown = ", ".join(f"{own.get(c, c)} AS {c}" for c in COUNTED)
    return f"{_EVENTS} SELECT * FROM (SELECT {shown} FROM e) WHERE {total} > 0"


def usage_claude(spark, sf_dir):
    created = _obj(ephemeral_1h_input_tokens=F.col("cache_write_1h"))
    use = _obj(input_tokens=F.col("raw_input"), cacheReadInputTokens=F.col("cache_read"), cache_creation_input_tokens=F.col("cache_write"), outputTokens=F.col("output"), cache_creation=created)
    value = _json(type="assistant", sessionId=F.col("session_id"), requestId=F.col("request_id"), timestamp=F.col("time"), costUSD=F.col("source_cost_usd"), isSidechain=F.col("sidechain"), message=_obj(id=F.col("message_id"), model=F.col("model"), usage=use))
    return _counted(claude.usage(_lines(_events(spark, sf_dir), _path("/home/kim/.claude/projects/-w/", "name", ".jsonl"), value)))


CLAUDE_USAGE_SQL = _usage_sql(sidechain="sidechain", cache_write_1h="least(cache_write_1h, cache_write)")


def usage_codex(spark, sf_dir):
    """Running totals of each file; what comes out are the requests they are made of."""
    w = Window.partitionBy("source_path").orderBy("source_order").rowsBetween(Window.unboundedPreceding, 0)
    read = F.least("cache_read", "raw_input")
    sums = _obj(input_tokens=F.sum("raw_input").over(w), cached_input_tokens=F.sum(read).over(w), output_tokens=F.sum("output").over(w), reasoning_output_tokens=F.sum("reasoning").over(w))
    df = _events(spark, sf_dir).withColumn("sums", sums)
    named = _json(type="turn_context", payload=_obj(model=F.col("model")))
    value = _json(type="event_msg", timestamp=F.col("time"), payload=_obj(type="token_count", info=_obj(total_token_usage=F.col("sums"))))
    return _counted(codex.usage(_lines(df, _path("/home/kim/.codex/sessions/", "name", ".jsonl"), named, value)))


_NULLS = {"message_id": "CAST(NULL AS VARCHAR)", "source_cost_usd": "CAST(NULL AS DOUBLE)"}
CODEX_USAGE_SQL = _usage_sql(
    **_NULLS, session_id="regexp_extract(source_path, '([0-9]+)\\.jsonl$', 1)", cache_read="least(cache_read, raw_input)", uncached_input="raw_input - least(cache_read, raw_input)", cache_write="CAST(0 AS BIGINT)", reasoning="reasoning",
)


def usage_pi(spark, sf_dir):
    use = _obj(input=F.col("raw_input"), output=F.col("output"), cacheRead=F.col("cache_read"), cacheWrite=F.col("cache_write"), cost=_obj(total=F.col("source_cost_usd")))
    change = _json(type="model_change", modelId=F.col("model"), provider=F.col("provider"))  # the message names no model
    value = _json(type="message", id=F.col("message_id"), timestamp=F.col("time"), message=_obj(role="assistant", usage=use))
    head = _json(type="session", id=F.col("session_id"), cwd="/w")
    return _counted(pi.usage(_lines(_events(spark, sf_dir), _path("/home/kim/.pi/sessions/", "name", ".jsonl"), change, value, head=head)))


PI_USAGE_SQL = _usage_sql()


def usage_opencode(spark, sf_dir):
    tokens = _obj(input=F.col("raw_input"), output=F.col("output"), reasoning=F.col("reasoning"), cache=_obj(read=F.col("cache_read"), write=F.col("cache_write")))
    value = _json(id=F.concat(F.lit("msg"), F.col("source_order").cast("string")), sessionID=F.col("session_id"), role="assistant", time=_obj(created=F.col("timestamp_ms")), modelID=F.col("model"), cost=F.col("source_cost_usd"), tokens=tokens)
    rows = _events(spark, sf_dir).select("source_path", value.alias("value"), F.lit(1).alias("priority"))
    return _counted(opencode.usage(rows))


OPENCODE_USAGE_SQL = _usage_sql(message_id="'msg' || source_order", output="output + reasoning", reasoning="reasoning", source_cost_usd="CASE WHEN source_cost_usd > 0 THEN source_cost_usd END")


def usage_cursor(spark, sf_dir):
    """Database rows by key, with counts at some depth below the value."""
    node = _obj(bubbleId=F.concat(F.lit("b"), F.col("source_order").cast("string")), modelName=F.col("model"), createdAt=F.col("timestamp_ms"), tokenCount=_obj(inputTokens=F.col("raw_input"), outputTokens=F.col("output"), cacheReadTokens=F.col("cache_read"), cacheWriteTokens=F.col("cache_write"), reasoningTokens=F.col("reasoning")))
    kept = F.to_json(_obj(conversation=F.array(node)))
    value = _json(key=F.concat(F.lit("composerData:"), "session_id"), value=kept)
    return _counted(cursor.usage(_lines(_events(spark, sf_dir), _path("/home/kim/", "name", ".vscdb"), value)))


CURSOR_USAGE_SQL = _usage_sql(message_id="'b' || source_order", reasoning="reasoning", source_cost_usd=_NULLS["source_cost_usd"]).replace(" FROM e)", " FROM e WHERE raw_input + output > 0)")


def usage_copilot(spark, sf_dir):
    """Spans whose attributes hold the counts."""
    own = {"gen_ai.usage.input_tokens": "raw_input", "gen_ai.usage.output_tokens": "output", "gen_ai.usage.cache_read.input_tokens": "cache_read", "gen_ai.usage.reasoning_tokens": "reasoning", "gen_ai.response.model": "model", "gen_ai.conversation.id": "session_id"}
    span = F.concat(F.lit("s"), F.col("source_order").cast("string"))
    value = _json(traceId="t", spanId=span, startTimeUnixNano=F.concat(F.col("timestamp_ms").cast("string"), F.lit("000000")), attributes=F.struct(*(F.col(c).alias(k) for k, c in own.items())))
    return _counted(copilot.usage(_lines(_events(spark, sf_dir), _path("/home/kim/otel/", "name", ".jsonl"), value)))


COPILOT_USAGE_SQL = _usage_sql(
    message_id="'s' || source_order", cache_read="least(cache_read, raw_input)", uncached_input="raw_input - least(cache_read, raw_input)", cache_write="CAST(0 AS BIGINT)", reasoning="reasoning", source_cost_usd=_NULLS["source_cost_usd"],
).replace(" FROM e)", " FROM e WHERE raw_input + output > 0)")


def usage_hermes(spark, sf_dir):
    """A session's total and sums by model that take from it in order; the total holds half of what the models claim."""
    e = _events(spark, sf_dir)
    counts = {"input_tokens": "raw_input", "cache_read_tokens": "cache_read", "cache_write_tokens": "cache_write", "output_tokens": "output", "reasoning_tokens": "reasoning"}
    by_model = e.groupBy("session_id", "model").agg(*(F.sum(c).alias(k) for k, c in counts.items()), F.max("timestamp_ms").alias("ts"))
    total = e.groupBy("session_id").agg(*(F.expr(f"sum({c}) div 2").alias(k) for k, c in counts.items()), F.max("timestamp_ms").alias("ts"))
    path = F.lit("/home/kim/.hermes/state.db").alias("source_path")
    sessions = total.select(path, F.lit(0).alias("line_no"), F.lit("sessions").alias("table"), _json(id=F.col("session_id"), model="gpt-5", ended_at=F.col("ts").cast("string"), cwd="/w", **{k: F.col(k) for k in counts}).alias("value"))
    models = by_model.select(path, F.lit(1).alias("line_no"), F.lit("session_model_usage").alias("table"), _json(session_id=F.col("session_id"), model=F.col("model"), last_seen=F.col("ts").cast("string"), **{k: F.col(k) for k in counts}).alias("value"))
    return _counted(hermes.usage(sessions.union(models)))


_H = {"raw_input": "raw_input", "cache_read": "cache_read", "cache_write": "cache_write", "output": "output", "reasoning": "reasoning"}
HERMES_USAGE_SQL = f"""{_EVENTS},
m AS (SELECT session_id, model, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _H)}, max(timestamp_ms) AS ts FROM e GROUP BY session_id, model),
t AS (SELECT session_id, {", ".join(f"CAST(sum({c}) AS BIGINT) // 2 AS t_{c}" for c in _H)}, max(timestamp_ms) AS s_ts FROM e GROUP BY session_id),
r AS (SELECT m.*, t.*, {", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS r_{c}" for c in _H)} FROM m JOIN t ON m.session_id = t.session_id WINDOW w AS (PARTITION BY m.session_id ORDER BY model)),
x AS (SELECT session_id, model, greatest(ts, s_ts) AS timestamp_ms, {", ".join(f"least(t_{c}, r_{c}) - least(t_{c}, r_{c} - {c}) AS {c}" for c in _H)} FROM r)
SELECT session_id, CAST(NULL AS VARCHAR) AS message_id, model, timestamp_ms, raw_input, raw_input AS uncached_input, cache_read, cache_write, CAST(0 AS BIGINT) AS cache_write_1h, output, reasoning, CAST(NULL AS DOUBLE) AS source_cost_usd, false AS sidechain
FROM x WHERE raw_input + cache_read + cache_write + output > 0"""

REGISTERED = {
    dialect_claude: CLAUDE_SQL, dialect_codex: CODEX_SQL, dialect_pi: PI_SQL, dialect_omp: PI_SQL, dialect_openclaw: PI_SQL, dialect_opencode: OPENCODE_SQL, dialect_cursor: CURSOR_SQL, dialect_copilot: COPILOT_SQL,
    usage_claude: CLAUDE_USAGE_SQL, usage_codex: CODEX_USAGE_SQL, usage_pi: PI_USAGE_SQL, usage_opencode: OPENCODE_USAGE_SQL, usage_cursor: CURSOR_USAGE_SQL, usage_copilot: COPILOT_USAGE_SQL, usage_hermes: HERMES_USAGE_SQL,
}
