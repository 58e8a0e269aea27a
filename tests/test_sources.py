import json
import sqlite3

from pyspark.sql import functions as F

from traceloom.sources import claude, codex, copilot, cursor, emit, hermes, lines, opencode, pi, sqlite, walk

J = json.dumps


def write(folder, name, rows):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(r if isinstance(r, str) else J(r) for r in rows) + "\n")
    return str(folder)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("source_path", "turn_id").collect()]


def test_claude_records_and_usage(spark, tmp_path):
    t = "2024-01-02T03:04:05Z"
    root = write(tmp_path, "projects/-home-ann-src-app/s1.jsonl", [
        {"type": "user", "uuid": "u1", "timestamp": t, "message": {"role": "user", "content": "please list"}},
        {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "timestamp": t, "requestId": "q", "message": {"id": "m", "model": "claude-sonnet-4-5", "content": [
            {"type": "text", "text": "sure,"}, {"type": "thinking", "thinking": " hm "}, {"type": "tool_use", "id": "t1", "name": "ls", "input": {"b": 1, "a": [2]}}, {"type": "text", "text": "done"}],
            "usage": {"input_tokens": 10, "cache_read_input_tokens": 80, "cache_creation_input_tokens": 20, "output_tokens": 5, "cache_creation": {"ephemeral_1h_input_tokens": 50}}}},
        {"type": "user", "uuid": "u3", "timestamp": t, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}},
        {"type": "user", "uuid": "u4", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "again"}]}},
        {"type": "summary", "summary": "no record"}, "not-json",
    ])
    files = lines.read(spark, root)
    r = claude.records(files)
    assert rows(r, "turn_id", "role", "text", "tool_name", "event_id") == [
        (0, "user", "please list", None, "u1"), (1, "tool_use", '{"b":1,"a":[2]}', "ls", "t1"), (2, "assistant", "sure, done", None, "u2"), (3, "tool_result", "x\ny", "ls", "u3:tool_result:t1"), (4, "tool_result", "again", None, "u4:tool_result:t1"),
    ]
    assert {x.project for x in r.collect()} == {"app"} and r.first().ts == 1704164645000
    assert ("reasoning", "hm") in rows(claude.records(files, True), "role", "text")
    u = claude.usage(files).collect()
    assert [(x.uncached_input, x.cache_read, x.cache_write, x.cache_write_1h, x.output, x.dedupe_confidence, x.source_record_id) for x in u] == [(10, 80, 20, 20, 5, "exact", "line:1")]
    assert [x.doc_id for x in emit.with_doc_ids(r, 7).orderBy("doc_id").collect()] == [7, 8, 9, 10, 11]
    a = {x.source_path.rsplit("/", 1)[1]: x for x in lines.audit(files).collect()}["s1.jsonl"]
    assert a.malformed == 1 and a.types == {"user": 3, "assistant": 1, "summary": 1}


def codex_line(at, kind, **payload):
    return {"timestamp": f"2025-03-01T10:00:{at:02d}Z", "type": kind, "payload": payload}


def codex_tokens(at, total=None, last=None):
    four = lambda x: dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"), x))
    info = {k: four(v) for k, v in (("total_token_usage", total), ("last_token_usage", last)) if v}
    return codex_line(at, "event_msg", type="token_count", info=info)


def test_codex_records_and_history(spark, tmp_path):
    root = write(tmp_path, "fork.jsonl", [
        codex_line(1, "session_meta", id="child", cwd="/srv/lab/orbit", forked_from_id="root-session"),
        codex_line(2, "turn_context", model="gpt-5-mini"),
        codex_line(3, "response_item", type="message", role="user", content=[{"type": "input_text", "text": "<permissions instructions> none"}]),
        codex_line(4, "response_item", type="function_call", name="grep", call_id="k7", arguments="{\"q\": 2}"),
        codex_line(5, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "found"}, {"type": "output_text", "text": "two"}]),
        "{broken", codex_line(6, "response_item", type="function_call_output", call_id="k7", output="line 9"),
    ])
    r = codex.records(lines.read(spark, root))
    assert rows(r, "role", "text", "tool_name", "session_id", "conversation_kind", "project") == [("tool_use", '{"q": 2}', "grep", "child", "fork", "orbit"), ("assistant", "found\ntwo", None, "child", "fork", "orbit"), ("tool_result", "line 9", "grep", "child", "fork", "orbit")]
    hist = lines.read(spark, write(tmp_path / "h", "history.jsonl", [{"session_id": "other", "text": "later", "ts": 9}, {"session_id": "child", "text": "never", "ts": 3}]))
    assert rows(codex.history(hist, r), "session_id", "text", "ts") == [("other", "later", 9000)]


def test_codex_usage_of_forks(spark, tmp_path):
    got = lambda root: [(x.source_path.rsplit("/", 1)[1], x.uncached_input, x.cache_read, x.output, x.model, x.request_id, x.source_record_id, x.conservative_undercount) for x in codex.usage(lines.read(spark, root)).orderBy("source_path", "source_order").collect()]
    old, new = "11111111-2222-3333-4444-555555555555", "99999999-8888-7777-6666-555555555555"
    parent = [codex_line(1, "session_meta", id=old, cwd="/w/a"), codex_line(1, "turn_context", model="gpt-5"), codex_line(2, "event_msg", type="task_started", turn_id="t1"), codex_tokens(3, (40, 10, 4, 0)), codex_tokens(20, (90, 10, 9, 0))]
    child = [codex_line(10, "session_meta", id=new, cwd="/w/a", forked_from_id=old), codex_tokens(12, (40, 10, 4, 0)), codex_tokens(13, (55, 20, 6, 0)), codex_tokens(14, (80, 20, 9, 0), (25, 0, 3, 0))]
    root = write(tmp_path, f"rollout-{old}.jsonl", parent)
    write(tmp_path, f"rollout-{new}.jsonl", child)
    own = [(f"rollout-{old}.jsonl", 30, 10, 4, "gpt-5", "t1", "event:0", False), (f"rollout-{old}.jsonl", 50, 0, 5, "gpt-5", "t1", "event:1", False)]
    # the parent's 40, 10 and 4 up to the fork are neither billed again nor part of what the fork adds
    assert got(root) == [*own, (f"rollout-{new}.jsonl", 5, 10, 2, None, None, "event:0", False), (f"rollout-{new}.jsonl", 25, 0, 3, None, None, "event:1", False)]
    # without the parent the fork's first total is its ground
    alone = write(tmp_path / "alone", f"rollout-{new}.jsonl", child)
    assert got(alone) == [(f"rollout-{new}.jsonl", 5, 10, 2, None, None, "event:0", True), (f"rollout-{new}.jsonl", 25, 0, 3, None, None, "event:1", True)]


def test_pi_family(spark, tmp_path):
    root = write(tmp_path, "p.jsonl", [
        {"type": "session", "id": "S", "cwd": "/w/app", "timestamp": "2024-01-01T00:00:00Z"}, {"type": "model_change", "modelId": "mm", "provider": "pp"},
        {"type": "message", "id": "1", "message": {"role": "user", "content": "hi"}},
        {"type": "message", "id": "2", "parentId": "1", "message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}, {"type": "toolCall", "id": "c", "name": "ls", "arguments": {"p": 1}}], "usage": {"input": 5, "output": 2, "cacheRead": 3, "cacheWrite": 1, "cost": {"total": 0.5}}}},
        {"type": "message", "id": "3", "message": {"role": "toolResult", "toolCallId": "c", "isError": True, "content": [{"type": "text", "text": "boom"}]}},
        {"type": "message", "id": "4", "message": {"role": "assistant", "model": "delivery-mirror", "content": [], "usage": {"input": 1, "output": 1}}}, "not-json",
    ])
    files = lines.read(spark, root)
    assert rows(pi.records(files), "role", "text", "tool_name", "event_id", "ts") == [("user", "hi", None, "1", 1704067200000), ("tool_use", '{"p":1}', "ls", "c", 1704067200000), ("assistant", "yo", None, "2", 1704067200000), ("tool_result", "Error: boom", "ls", "3", 1704067200000)]
    u = pi.usage(files, "openclaw").orderBy("source_order").collect()
    assert [(x.uncached_input, x.cache_read, x.cache_write, x.output, x.model, x.provider, x.source_cost_usd) for x in u] == [(5, 3, 1, 2, "mm", "pp", 0.5), (1, 0, 0, 1, None, "pp", None)]


def test_opencode_cursor_copilot(spark, tmp_path):
    df = lambda xs: spark.createDataFrame([(p, J(v)) for p, v in xs], "source_path string, value string")
    message = {"id": "m1", "sessionID": "s", "role": "assistant", "time": {"created": 5}, "modelID": "x", "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 0}}}
    parts = df([("p2", {"messageID": "m1", "type": "text", "text": "b"}), ("p1", {"messageID": "m1", "type": "text", "text": "a"}), ("p3", {"messageID": "m1", "type": "tool"})])
    r = opencode.records(df([("f", message)]), parts, df([("x", {"id": "s", "parentID": "q"})]))
    assert rows(r, "text", "conversation_kind", "parent_session_id") == [("a\nb", "fork", "q")]
    u = opencode.usage(df([("f", message)]).selectExpr("*", "1 as priority")).first()
    assert (u.output, u.reasoning, u.cache_read) == (5, 3, 4)
    assert [(c["id"], c["input"], c["output"], c["session"]) for c in walk.parse(J({"composerId": "C", "x": [{"bubbleId": "b", "tokenCount": {"inputTokens": 3, "outputTokens": 4}}]}))] == [("b", 3, 4, "C")]
    db = tmp_path / "state.vscdb"
    with sqlite3.connect(db) as c:
        c.execute("create table cursorDiskKV(key text, value blob)")
        c.execute("insert into cursorDiskKV values (?, ?)", ("bubbleId:S:1", J({"bubbleId": "b", "tokenCount": {"inputTokens": 3, "outputTokens": 4}}).encode()))
    got = cursor.usage(sqlite.rows(spark, str(db), ["cursorDiskKV", "ItemTable"]), spark.createDataFrame([("S", "app")], "session_id string, project string")).collect()
    assert [(x.session_id, x.raw_input, x.output, x.project) for x in got] == [("S", 3, 4, "app")]
    files = lines.read(spark, write(tmp_path / "c", "projects/app/agent-transcripts/S/subagents/A.jsonl", [{"role": "user", "message": {"content": "q"}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "a"}]}}]))
    r = cursor.records(files).orderBy("turn_id").collect()
    assert [x.text for x in r] == ["q", "a"] and r[0].turn_id >= 10**9 and r[1].turn_id == r[0].turn_id + 1 and r[0].parent_session_id == "S" and r[0].ts > 10**12
    files = lines.read(spark, write(tmp_path / "k", "events.jsonl", [
        {"type": "session.start", "data": {"sessionId": "K", "context": {"cwd": "/w/app"}}}, {"type": "user.message", "id": "1", "data": {"content": "hi"}},
        {"type": "tool.execution_start", "id": "2", "data": {"toolCallId": "c", "toolName": "ls", "arguments": {"a": 1}}}, {"type": "tool.execution_complete", "id": "3", "data": {"toolCallId": "c", "result": {"content": "out"}}},
        {"traceId": "T", "spanId": "P", "startTimeUnixNano": "1704067200000000000", "attributes": {"gen_ai.usage.input_tokens": 9, "gen_ai.usage.output_tokens": 2, "gen_ai.response.model": "m"}},
    ]))
    assert rows(copilot.records(files), "role", "text", "tool_name", "session_id", "project") == [("user", "hi", None, "K", "app"), ("tool_use", '{"a":1}', "ls", "K", "app"), ("tool_result", "out", "ls", "K", "app")]
    u = copilot.usage(files).first()
    assert (u.source_record_id, u.raw_input, u.model, u.timestamp_ms) == ("T:P", 9, "m", 1704067200000)


def test_hermes_rows_take_from_the_session_until_it_is_used_up(spark, tmp_path):
    db = tmp_path / "h.db"
    with sqlite3.connect(db) as c:
        c.execute("create table sessions(id text, model text, input_tokens int, output_tokens int, started_at real)")
        c.execute("create table session_model_usage(session_id text, model text, input_tokens int, output_tokens int)")
        c.execute("insert into sessions values ('s', 'big', 100, 10, 1704067200)")
        c.executemany("insert into session_model_usage values ('s', ?, ?, ?)", [("a", 70, 4), ("b", 50, 4)])
    u = hermes.usage(sqlite.rows(spark, str(db), ["sessions", "session_model_usage"])).collect()
    assert sorted((x.model, x.raw_input, x.output) for x in u) == [("a", 70, 4), ("b", 30, 4), ("big", 0, 2)]
    assert all(x.cache_chain_excluded and x.timestamp_ms == 1704067200000 for x in u)


def test_a_message_is_parsed_once(spark):
    rows = spark.range(3).select(F.lit("/m.json").alias("source_path"), F.lit(1).alias("priority"), F.lit(0).alias("line_no"), F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("assistant").alias("role"), F.struct(F.col("id").alias("input")).alias("tokens"))).alias("value"))
    for used in (opencode.usage(rows), claude.usage(rows)):
        plan = used._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and plan.count("to_json(") <= 2  # claude's filter looks for a word before
    assert sorted(r.raw_input for r in opencode.usage(rows).collect()) == [1, 2]


def test_codex_totals_are_made_once(spark, tmp_path):
    total = lambda n: {"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": 1, "output_tokens": n, "reasoning_output_tokens": 0}}}}
    for k in range(3):
        write(tmp_path, f"{k}.jsonl", [{"type": "turn_context", "payload": {"model": f"m{k}"}}, total(10 + k), total(10 + k), {"type": "turn_context", "payload": {"model": "n"}}, total(25)])
    used = codex.usage(lines.read(spark, str(tmp_path)))
    assert used._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 1
    got = sorted((r.session_id, r.source_order, r.raw_input, r.output, r.model, r.conservative_undercount) for r in used.collect())
    assert got == [(str(k), at, n, n, m, False) for k in range(3) for at, n, m in ((1, 10 + k, f"m{k}"), (4, 15 - k, "n"))]
