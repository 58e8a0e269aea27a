import json

from pyspark.sql import functions as F

from traceloom.operators import federation, repositories, transfer, vectors
from traceloom.sources import probes

LINES = "source_path string, line_no long, value string"


def lines(spark, files):
    return spark.createDataFrame([(p, k, v if isinstance(v, str) else json.dumps(v)) for p, x in files.items() for k, v in enumerate(x)], LINES)


def test_probes_read_the_head(spark):
    files = {
        "/p/-w-app/a.jsonl": [{"type": "summary"}, "broken", {"cwd": "/w/one"}, {"sessionId": "s1"}, {"cwd": "/w/two", "sessionId": "s2"}, {"cwd": "/w/three", "sessionId": "s3", "isSidechain": True}],
        "/p/-w-app/b.jsonl": [{"sessionId": "s4", "isSidechain": True}],
        "/p/-w-app/subagents/agent-c.jsonl": [{"sessionId": "parent", "cwd": "/w/x"}],
        "/p/-w-app/d.jsonl": ["{}"] * 70 + [{"cwd": "/late", "sessionId": "late"}],
        "/p/-w-app/e.jsonl": ["nothing"],
    }
    got = {r.source_path.rsplit("/", 1)[1]: tuple(r)[1:] for r in probes.probe_claude(lines(spark, files)).collect()}
    assert got["a.jsonl"] == ("s2", None, "/w/two", "two", "main") and got["b.jsonl"][0::4] == ("s4", "sidechain") and got["b.jsonl"][2] is None
    assert got["agent-c.jsonl"] == ("parent", "parent", "/w/x", "x", "subagent") and got["d.jsonl"][:3] == ("d", None, None) and got["e.jsonl"][0] == "e"
    meta = lambda **p: {"type": "session_meta", "payload": p}
    files = {"/c/a.jsonl": [meta(id="i", cwd="/w/app", forked_from_id="q")], "/c/b.jsonl": [{"type": "x"}], "/c/d.jsonl": [meta(id="j", source='{"subagent": 1}')]}
    got = {r.source_path[3]: tuple(r)[1:] for r in probes.probe_codex(lines(spark, files)).collect()}
    assert got == {"a": ("i", "q", "/w/app", "app", "fork"), "b": ("b", None, None, "codex", "main"), "d": ("j", None, None, "codex", "subagent")}


def test_session_folders_by_priority(spark):
    files = {
        "/1": [{"cwd": "/first"}, {"cwd": "/other", "sessionId": "x"}, {"cwd": "/own", "session_id": "s"}],
        "/2": [{"cwd": "/first"}, {"type": "session_meta", "cwd": "/no", "payload": {"cwd": "/head"}}],
        "/3": [{"cwd": "/first"}, {"type": "session", "cwd": "/pi"}], "/4": [{"cwd": "/first"}, {"type": "session", "cwd": "/not"}], "/5": ["x"], "/six/events.jsonl": [{"cwd": "/first"}],
    }
    sessions = spark.createDataFrame([("claude", "s", "/1"), ("codex", "s", "/2"), ("pi", "s", "/3"), ("claude", "s", "/4"), ("claude", "s", "/5"), ("copilot", "s", "/six/events.jsonl")], "source string, session_id string, source_path string")
    yaml = {"/six/workspace.yaml": ["# cwd: /no", "  cwd: /nested", "git_root: '/root'", 'cwd: "/side car"', "empty:", "other: a:b"], "/seven/workspace.yaml": ["gitRoot: /only"]}
    side = probes.sidecar_folders(lines(spark, yaml))
    assert {tuple(r) for r in side.collect()} == {("/six", "/side car"), ("/seven", "/only")}
    got = {r.source_path: r.cwd for r in probes.session_folders(sessions, lines(spark, files), side).collect()}
    assert got == {"/1": "/own", "/2": "/head", "/3": "/pi", "/4": "/first", "/5": None, "/six/events.jsonl": "/side car"}


def test_which_files_are_discovered(spark):
    files = {"/r/p/a.jsonl": (True, True), "/r/a.jsonl": (True, True), "/r/p/deep/journal.jsonl": (False, False), "/r/p/agent-a.jsonl": (False, True), "/r/p/s/subagents/agent-b.jsonl": (False, True), "/r/p/s/subagents/c.jsonl": (False, False), "/r/p/a.txt": (False, False), "/q/p/a.jsonl": (False, False)}
    df = spark.createDataFrame([(p,) for p in files], "p string")
    got = {r[0]: (r[1], r[2]) for r in df.select("p", probes.discovered(F.col("p"), "/r/"), probes.discovered(F.col("p"), "/r", True)).collect()}
    assert got == files


def test_nearest_repository_by_brute_force(spark):
    repos = [("/w/app", "/w/app/.git"), ("/w/app/vendor/lib", "/elsewhere/lib.git"), ("/", None), ("rel/x", "rel/x/.git"), ("/w/b/", None)]
    paths = ["/w/app", "/w/app/src/deep", "/w/app/vendor/lib/a", "/w/application", "/other", "rel/x/y", "rel/z", None, "", "/w/b/c/", "/h/p/.claude/worktrees/t", "rel/q/.claude/worktrees/a/.claude/worktrees/b"]
    got = {r.cwd: tuple(r)[1:] for r in repositories.nearest(spark.createDataFrame([(p,) for p in paths], "cwd string"), spark.createDataFrame([r for r in repos if r[0] != "/"], "root string, common_dir string")).collect()}

    def plain(p):
        inside = [(len(r.rstrip("/")), r.rstrip("/"), c) for r, c in repos if r != "/" and (p.rstrip("/") + "/").startswith(r.rstrip("/") + "/")] if p else []
        root, common = max(inside)[1:] if inside else (None, None)
        name = common.removesuffix("/.git").rsplit("/", 1)[-1] if common else root.rsplit("/", 1)[-1] if root else None
        return root, common, name, "ok" if name else "not-git"

    for p in paths:
        if p and "worktrees" in p:
            assert got[p][::3] == (None, "path-fallback")
        else:
            assert got[p] == plain(p)
    assert got["/h/p/.claude/worktrees/t"][2] == "p" and got["rel/q/.claude/worktrees/a/.claude/worktrees/b"][2] == "a"


def test_a_broken_source_costs_only_its_own_rows(spark):
    good = lambda n: lambda: spark.range(n).select(F.col("id").alias("ts"), F.lit("s").alias("session_id"), F.lit("x").alias("source"))

    def broken():
        return good(5)().withColumn("ts", F.when(F.col("ts") == 4, F.raise_error(F.lit("row 4")).cast("long")).otherwise(F.col("ts")))

    def missing():
        raise FileNotFoundError("no folder")

    got = federation.gather({"a": good(3), "b": broken, "c": missing, "d": good(2)}, "machine")
    assert got.answered == ["a", "d"] and got.rows.count() == 5 and [w[0] for w in got.warnings] == ["b", "c"] and "no folder" in got.warnings[1][1]
    last = federation.latest({"a": good(3), "b": broken, "d": good(9)}, 4, ["session_id"])
    assert [(r.machine, r.ts) for r in last.rows.collect()] == [("d", 8), ("d", 7), ("d", 6), ("d", 5)] and len(last.warnings) == 1
    keys = spark.createDataFrame([("a", "x", "s"), ("d", "x", "other")], "machine string, source string, session_id string")
    counts = federation.activity({m: (lambda n=n: good(n)().withColumn("n", F.lit(1)).withColumn("day", F.lit("1"))) for m, n in (("a", 3), ("d", 2))}, keys, "day", "n")
    assert [tuple(r) for r in counts.rows.collect()] == [("1", "x", 3)]
    d = spark.createDataFrame([("a", 1, {"x": 2}), ("b", None, {"x": 3, "y": 1}), ("c", 4, None)], "source string, malformed_json_lines long, unknown_top_level_types map<string, long>")
    assert [tuple(r) for r in federation.merge_diagnostics(d).collect()] == [(5, {"x": 5, "y": 1})]
    assert federation.merge_diagnostics(d, ["source"]).filter("source = 'c'").first().unknown_top_level_types == {}
    assert federation.machines([" a ", "a", "local"], ["a", "b"]) == ["a", "local"] and federation.machines([], ["b"]) == ["local", "b"] and federation.views(" q ", ["", "q", "r "]) == ["q", "r"]


def test_a_page_of_different_sessions_fetches_until_it_is_full(spark):
    rows = spark.createDataFrame([(k, "s0" if k < 20 else f"s{k}") for k in range(30)], "rank int, session_id string")
    asked = []
    page = federation.distinct_page(lambda n: (asked.append(n), rows.orderBy("rank").limit(n))[1], 3, ["rank"])
    assert [r.session_id for r in page.orderBy("rank").collect()] == ["s0", "s20", "s21"] and asked == [3, 6, 12, 24]
    assert federation.distinct_page(lambda n: rows.filter("rank < 5").limit(n), 3, ["rank"]).count() == 1


def test_wrapped_texts_and_titles(spark):
    t = {
        ("user", "  Continue \n"): "[User requested continuation]", ("user", "<TASK-notification><Summary> a\n b </summary><summary>c</summary>"): "[Task notification] a b", ("user", "<task-notification>"): "[Task notification]",
        ("user", "<command-name>/run</command-name> <command-message>go</command-message>"): "[Local command] /run: go", ("user", "<command-name>/x</command-name>"): "[Local command] /x", ("user", "<command-name>open"): "[Local command]",
        ("user", "<local-command-stdout>out<b>x</b></local-command-stdout>"): "[Local command stdout] out<b>x</b>", ("user", "plain <summary>"): "plain <summary>", ("user", " "): None, ("user", None): None,
        ("assistant", "Oh: operation  aborted."): "[Assistant error] Operation aborted", ("assistant", "continue"): "continue", ("tool_result", "operation aborted"): "operation aborted",
    }
    df = spark.createDataFrame(list(t), "role string, text string")
    assert {(r.role, r.text): r.c for r in df.select("role", "text", transfer.compact_text(F.col("role"), F.col("text")).alias("c")).collect()} == t
    titles = spark.createDataFrame([("  one \ntwo",), ("x" * 121,), (None,), ("",)], "t string").select(transfer.title_of(F.col("t"))).collect()
    assert [r[0] for r in titles] == ["one", "x" * 120 + "...", "", ""]


def test_the_life_of_a_vector_table(spark, tmp_path):
    v = vectors.VectorStore(spark, f"file://{tmp_path}/v")
    rows = lambda *x: spark.createDataFrame([(i, [float(i), 1.0]) for i in x], "doc_id long, embedding array<float>")
    asked = []
    embed = lambda model, q: (asked.append(model), [1.0, 1.0])[1]
    lexical = lambda q: rows(99).select("doc_id")
    find = lambda: [r.doc_id for r in v.search("q", 1, embed, lexical, "configured").collect()]
    assert v.query_model("configured") is None and find() == [99] and asked == []
    assert v.add(rows(1, 2), "m1", 2) and not v.add(rows(2, 3).withColumn("embedding", F.expr("array(0f, 0f)")), "m1", 2)
    assert sorted((r.doc_id, list(r.embedding)) for r in v.read().collect()) == [(1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [0.0, 0.0])]
    assert find() == [1] and asked == ["m1"]
    assert v.add(rows(7), "m2", 2) and [r.doc_id for r in v.read().collect()] == [7] and v.query_model("configured") == "m2"
