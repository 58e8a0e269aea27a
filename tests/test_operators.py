import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from traceloom.functions import bytes_, ids, projects, spans, text, times
from traceloom.operators import context, evaluate, fusion, reconcile, records, search, sessions, transfer, usage, vectors
from traceloom.schema import RECORDS, USAGE_EVENTS, columns
from traceloom.streaming import counters


def record_rows(spark, rows):
    names = columns(RECORDS)
    base = {"source": "claude", "project": "p", "session_id": "s", "role": "user", "text": "t", "source_path": "/f", "ts": 0, "turn_id": 0}
    return spark.createDataFrame([tuple({**base, "doc_id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], RECORDS)


def events(spark, rows):
    base = {"source": "claude", "source_path": "/f", "session_id": "s", "provider": "anthropic", "model": "claude-sonnet-4-5", "timestamp_ms": 0, "raw_input": 0, "uncached_input": 0, "cache_read": 0, "cache_write": 0,
            "cache_write_1h": 0, "output": 0, "reasoning": 0, "cost_authoritative": False, "conservative_undercount": False, "cache_chain_excluded": False, "sidechain": False, "dedupe_confidence": "exact"}
    return spark.createDataFrame([tuple({**base, "source_order": i, **r}.get(n) for n in columns(USAGE_EVENTS)) for i, r in enumerate(rows)], USAGE_EVENTS)


def test_canonical_ids_frame_their_fields(spark):
    def want(*fields):
        h = hashlib.sha256()
        for label, v in fields:
            for x in (label.encode(), v.encode()):
                h.update(len(x).to_bytes(8, "little") + x)
        return "rid1_" + h.hexdigest()

    r = record_rows(spark, [{"event_id": "é1"}, {"turn_id": 4}, {"role": "tool_use", "source_tool_use_id": "t", "session_id": "", "tool_name": "ls"}])
    got = [x[0] for x in r.orderBy("doc_id").select(ids.canonical_record_id()).collect()]
    v = ("version", "rid1"), ("source", "claude")
    assert got[0] == want(*v, ("session", "s"), ("event", "é1"), ("role", "user"), ("tool", ""))
    assert got[1] == want(*v, ("session", "s"), ("source-path", "/f"), ("turn", "4"), ("role", "user"), ("tool", ""))
    assert got[2] == want(*v, ("session", "/f"), ("source-tool-use", "t"), ("role", "tool_use"), ("tool", "ls"))


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(times.parse_user_ts(lit("10000000000"))) == 10_000_000_000_000 and one(times.parse_user_ts(lit("10000000001"))) == 10_000_000_001
    assert one(times.parse_source_ts(lit("10000000000"))) == 10_000_000_000 and one(times.parse_source_ts(lit("-5"))) == 0 and one(times.parse_source_ts(lit("x"))) == 0
    assert one(times.parse_user_ts(lit("2024-01-02"))) == 1704153600000 and one(times.parse_source_ts(lit("2024-01-02T00:00:00+01:00"))) == 1704150000000
    assert one(text.summarize(lit("a  b\n" * 9), 10)) == "a b a b..." and one(text.query_terms(lit("(Foo) foo, é x"))) == ["foo", "é"]
    assert one(ids.fnv1a(lit("a"))) == 0xE40C292C and one(ids.fnv1a(lit(""))) == 2166136261
    assert one(projects.project_key(lit("git@h:o/App.git"))) == "app" and one(projects.decode_slug(lit("-Users-ann-src-my-app"))) == "my-app"
    assert one(text.resume_command("cd {cwd}; run {session_id}", lit("a'b"), lit("/w"))) == "cd '/w'; run 'a'\\''b'"
    assert one(times.age(lit(1000), 1000 + 3 * 86_400_000)) == "3d"


def test_byte_caps_never_split_a_character():
    for n in (40, 63, 64, 65, 200):
        t = "é🙂x" * 200
        cut = bytes_.truncate_middle(t, n)
        assert len(cut.encode()) <= max(n, 40) and "omitted" in cut
        assert len(bytes_.truncate_head(t, n).encode()) <= n
    assert bytes_.truncate_middle("short", 100) == "short"
    assert [(s["start"], s["end"]) for s in spans.find_spans("é Foo foo", ["foo"])] == [(3, 6), (7, 10)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(docs, "A!", "doc_id").collect()}
    idf, mean = math.log(1 + 2.5 / 1.5), 5 / 3
    assert got.keys() == {1} and math.isclose(got[1], idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)))
    assert search.bm25(docs, "", "doc_id").count() == 3


def test_recency_vectors_and_fusion(spark):
    now = 100 * 86_400_000
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    s = lambda score, ts: one(search.recency(F.lit(score), F.lit(ts), now))
    assert math.isclose(s(2.0, now - 30 * 86_400_000), 3.0) and s(2.0, 0) == 2.0 and math.isclose(s(2.0, now + 5), 4.0) and s(-1.0, now) == -1.0
    v = spark.createDataFrame([(i, [math.sin(k + i) for k in range(8)]) for i in range(9)], "doc_id long, embedding array<float>")
    assert vectors.nearest(v, [math.sin(k + 3) for k in range(8)], 1).first().doc_id == 3
    assert vectors.add_vectors(v, v.limit(2).union(v.limit(1)), 8).count() == 9
    lists = spark.createDataFrame([(0, 0, 1, 5.0, "a"), (0, 1, 2, 4.0, "b"), (1, 0, 1, 7.0, "c"), (1, 1, 1, 1.0, "d")], "view int, rank int, doc_id long, score double, payload string")
    got = {r.doc_id: r for r in fusion.fuse_views(lists, ["doc_id"], ["payload"], 1).collect()}
    assert math.isclose(got[1].score, 1 / 2 + 1 / 2 + 1 / 3) and got[1].payload == "c"
    lists = spark.createDataFrame([(0, 0, 1, float("inf"), "a"), (1, 0, 1, -2.0, "b"), (2, 0, 1, float("nan"), "c")], lists.schema)
    got = fusion.fuse_views(lists, ["doc_id"], ["payload"], 0).first()  # k may be 0
    assert got.score == 3.0 and got.payload == "b"
    assert fusion.fuse(lists, ["doc_id"], -1).first().score == 3 / 61


def test_session_roll_up_equals_a_fold(spark):
    r = random.Random(2)
    rows = [{"ts": r.randrange(20), "project": r.choice(["", "a", "b", "c"]), "session_id": r.choice("xyz")} for _ in range(120)]
    want = {}
    for x in rows:
        w = want.setdefault(x["session_id"], [x["ts"], x["ts"], 0, x["project"]])
        if x["ts"] >= w[1] and x["project"]:
            w[3] = x["project"]
        w[0], w[1], w[2] = min(w[0], x["ts"]), max(w[1], x["ts"]), w[2] + 1
    got = {s.session_id: [s.started_at, s.last_at, s.message_count, s.project] for s in sessions.roll_up(record_rows(spark, rows)).collect()}
    assert got == want


def test_context_and_its_limits(spark):
    r = record_rows(spark, [{"turn_id": i} for i in range(9)])
    got = context.around(r, F.col("doc_id") == 4, 2, 1).orderBy("distance").collect()
    assert [(x.doc_id, x.distance, x.relation) for x in got] == [(2, -2, "before"), (3, -1, "before"), (4, 0, "anchor"), (5, 1, "after")]
    with pytest.raises(ValueError, match="ambiguous"):
        context.single_anchor(r, F.col("doc_id") > 6)
    with pytest.raises(ValueError):
        context.around(r, F.lit(True), 1001, 0)
    e = record_rows(spark, [{"event_id": "a"}, {"event_id": "b", "parent_event_id": "a"}, {"parent_tool_use_id": "b"}, {"event_id": "z", "parent_session_id": "a"}])
    assert {x.doc_id for x in context.closure(context.identifiers(e), e.filter("doc_id = 0"), "doc_id").collect()} == {0, 1, 2}


def fold_waste(rows):
    """The chain rule, row after row."""
    state, out = {}, []
    for r in sorted(rows, key=lambda r: (r["timestamp_ms"], r["source_path"], r["source_order"])):
        if r["sidechain"] or r["session_id"] is None:
            continue
        key = (r["session_id"], r["source_path"])
        if r["cache_chain_excluded"] or r["conservative_undercount"]:
            state.pop(key, None)
            continue
        prompt = r["uncached_input"] + r["cache_read"] + r["cache_write"]
        if not prompt:
            continue
        last, used = state.get(key, (None, False))
        if last and (r["cache_read"] > 0 or used) and prompt * 2 >= last[0]:
            missed = max(min(last[0], prompt) - r["cache_read"], 0)
            if missed > 1024:
                out.append((r["source_order"], missed, r["model"] != last[1], r["model"] == last[1] and r["timestamp_ms"] - last[2] >= 300_000))
        state[key] = ((prompt, r["model"], r["timestamp_ms"]), used or r["cache_read"] + r["cache_write"] > 0)
    return out


def test_cache_waste_equals_a_fold(spark):
    r = random.Random(5)
    rows = [{"source_order": i, "timestamp_ms": r.randrange(4_000_000), "session_id": r.choice(["a", "b", None]), "source_path": r.choice(["/1", "/2"]), "uncached_input": r.choice([0, 500, 4000]), "cache_read": r.choice([0, 0, 3000]),
             "cache_write": r.choice([0, 2000]), "model": r.choice(["m", "n"]), "sidechain": r.random() < 0.1, "cache_chain_excluded": r.random() < 0.05, "conservative_undercount": r.random() < 0.05} for i in range(500)]
    got = usage.cache_misses(events(spark, rows)).collect()
    assert sorted((x.source_order, x.missed_tokens, x.model_switch, x.idle) for x in got) == sorted(fold_waste(rows))


def test_costs(spark):
    e = events(spark, [
        {"uncached_input": 100, "cache_read": 80, "cache_write": 50, "cache_write_1h": 20, "output": 10, "model": "Claude-Sonnet-4-5-20250929"}, {"uncached_input": 1, "model": "gpt-5.4-mini", "provider": "openai"},
        {"uncached_input": 1, "model": "gpt-5.4-mini", "provider": "anthropic"}, {"uncached_input": 1, "source_cost_usd": 0.5}, {"uncached_input": 1, "cost_authoritative": True}, {"uncached_input": 1, "model": "claude-sonnet-4-5-x"},
    ])
    got = [r.cost_nanos for r in usage.with_cost(usage.priced(e)).orderBy("source_order").collect()]
    assert got == [(100 * 3000 + 80 * 300 + 30 * 3750 + 20 * 6000 + 10 * 15000), 750, None, 500_000_000, None, None]


def test_capping_residuals_and_copies(spark):
    rows = spark.createDataFrame([("k", 1, 70), ("k", 2, 50), ("k", 3, 9)], "k string, n int, v long")
    totals = spark.createDataFrame([("k", 100), ("q", 5)], "k string, t long")
    assert [r.capped for r in usage.cap_to_total(rows.join(totals, "k"), ["k"], ["n"], "v", "t").orderBy("n").collect()] == [70, 30, 0]
    assert [tuple(r) for r in usage.residuals(totals, rows, ["k"], "v", "t").collect()] == [("q", 5)]
    e = events(spark, [
        {"message_id": "m", "request_id": "r", "output": 1, "sidechain": True}, {"message_id": "m", "request_id": "r", "output": 5}, {"message_id": "m", "request_id": "r", "output": 9}, {"message_id": "m", "request_id": "z", "sidechain": True}, {}, {},
    ])
    assert sorted(r.source_order for r in reconcile.best_claude(e).collect()) == [2, 4, 5]
    assert reconcile.first_by_record(events(spark, [{"source_record_id": "a"}, {"source_record_id": "a"}, {}, {}])).count() == 3


def bills(lines, ground=None):
    four = lambda i: i if i is None or isinstance(i, tuple) else (i, 0, 0, 0)
    return [b[0] for b, _ in counters.fold([(four(t), four(r), *(more or (False, False))) for t, r, *more in lines], four(ground))]


def test_counter_rules_by_case():
    assert bills([(None, 7), (None, 5), (12, None), (20, None)]) == [7, 5, 0, 8]  # requests alone, then their total
    assert bills([(100, None), (150, None)]) == [100, 50]  # one stream, totals alone
    assert bills([(100, None), (100, None), (130, 30)]) == [100, 0, 30]  # a replay; a request and its total agree
    assert bills([(500, 40), (560, 50)]) == [40, 50]  # totals that began elsewhere: the request's own numbers hold
    assert bills([(100, 100), (150, 20)]) == [100, 20] and bills([(100, 100), (150, 80)]) == [100, 50]  # the smaller of the two
    assert bills([(100, None), (150, None), (120, None), (160, None)]) == [100, 50, 0, 10]  # below the highest: another stream
    assert bills([(100, None), (60, 60), (130, 90)]) == [100, 0, 30]  # several streams: no more than lifts what is paid
    assert bills([(320, None), (350, None)], 300) == [20, 30] and bills([(320, None), (350, 60)], 300) == [20, 60]  # a fork's ground
    assert bills([(95, None, False, True), (95, None), (70, None, True, False), (99, None)], 90) == [0, 0, 0, 4]  # met, replayed
    assert bills([(k, None) for k in range(1, 70)] + [(1, None), (68, None)]) == [1] * 69 + [0, 0]  # an old total is billed by no rule twice
    assert [m for _, m in counters.fold([((9, 0, 0, 0), None, False, False), ((9, 1, 0, 0), None, False, False), ((8, 2, 0, 0), None, False, False)])] == [False, False, True]


def test_counters_by_a_plain_reading_of_the_rules():
    """Nothing is kept between lines: each line looks back at all lines before it."""
    r = random.Random(3)

    def plain(lines, ground):
        billed, noted, out = [], [], []
        for k, (total, request, replayed, inherited) in enumerate(lines):
            sums = [tuple(sum(b[i] for b in billed[: j + 1]) for i in range(4)) for j in range(k)]
            paid = sums[-1] if sums else (0,) * 4
            tops = [ground or (0,) * 4, *(t for _, t in noted), *(s for s, (t, q, _, own) in zip(sums, lines, strict=False) if t is None and q is not None and not own)]
            top = tuple(max(x[i] for x in tops) for i in range(4))
            seen = [t for n, (_, t) in enumerate(noted) if not n or noted[n - 1][1] != t][-64:]
            bill = (0,) * 4
            if total is None and not inherited:
                bill = request or bill
            elif total is not None and inherited:
                noted.append((None, total))
            elif total is not None and not replayed and total not in seen:
                below = lambda t, j: any(a < b for a, b in zip(t, j, strict=True))
                mixed = any(own for own, _ in noted) or below(total, top)
                lifted = tuple(max(0, t - (max(p, h) if t >= h else p)) for t, p, h in zip(total, paid, top, strict=True))
                grown = tuple(max(0, t - h) for t, h in zip(total, top, strict=True))
                trusted = all(sums[j] == lines[j][0] for j in range(k) if billed[j] is not None and (lines[j][0], j) in own_totals)
                bill = lifted if request is None else tuple(map(min, request, lifted)) if mixed else grown if trusted and not below(request, grown) else request
                noted.append((mixed, total))
                own_totals.add((total, k))
            billed.append(bill)
            out.append(bill)
        return out

    for _ in range(1500):
        size = r.choice([2, 4, 30])
        four = lambda: (lambda x: x if any(x) else None)(tuple(r.randrange(size) for _ in range(4)))  # noqa: B023, E731
        own_totals: set = set()
        now, lines = (0,) * 4, []
        for _ in range(r.randrange(1, 12)):
            now = tuple(a + r.randrange(size) for a in now) if r.random() < 0.6 else now
            lines.append((r.choice([None, now, now, now, four()]) if any(now) else None, r.choice([None, four()]), r.random() < 0.1, r.random() < 0.08))
        ground = r.choice([None, four()])
        assert [b for b, _ in counters.fold(lines, ground)] == plain(lines, ground)


def test_files_are_folded_apart(spark):
    rows = [("a", 2, 1, 150), ("a", 1, 1, 100), ("b", 1, 1, 70), ("a", 3, 1, 120), ("a", 4, 1, 160), ("b", 2, 1, 70)]
    t = spark.createDataFrame([(*x, 0, 0, 0) for x in rows], "source_path string, source_order long, ts long, input long, cached long, output long, reasoning long").repartition(3)
    assert sorted((r.source_path, r.source_order, r.input, r.mixed) for r in counters.deltas(t).collect()) == [("a", 1, 100, False), ("a", 2, 50, False), ("a", 4, 10, True), ("b", 1, 70, False)]
    assert counters.deltas(t.limit(0)).count() == 0


def test_project_names(spark):
    from pyspark.sql.functions import col

    slugs = {"-Users-kim-Work": ("-Users-kim-Work", "~/Work"), "-Users-kim-src-code-app": ("app", "code-app"), "-home-kim-app": ("kim-app", "~/app"), "-home-kim-dev-my-app": ("my-app", "my-app"), "plain-name": ("plain-name", "plain-name"), "-Users-kim-tools-src-x": ("tools-x", "tools-src-x"), "-c--Users-kim-code-z": ("z", "z"), "-Users-kim": ("kim", "-Users-kim"), "": ("", "")}
    got = spark.createDataFrame([(k,) for k in slugs], "s string").select("s", projects.decode_slug(col("s")).alias("d"), projects.display_project(col("s")).alias("p")).collect()
    assert {r.s: (r.d, r.p) for r in got} == slugs


def test_pairs_by_a_plain_reading():
    def plain(m, least):
        out, i = [], 0
        while i < len(m):
            n = 1
            while i + 2 * n + 2 <= len(m) and m[i + 2 * n : i + 2 * n + 2] == m[i : i + 2]:
                n += 1
            out += [(*x, n) for x in m[i : i + 2]] if n >= least else [(*m[i], 1)]
            i += 2 * n if n >= least else 1
        return out

    r = random.Random(5)
    for _ in range(3000):
        m = [(r.choice("uv"), r.choice("ab")) for _ in range(r.randrange(30))]
        for least in (2, 3):
            assert list(transfer.compact_pairs(m, least)) == plain(m, least)


def test_sessions_are_compacted_apart(spark):
    rows = [{"turn_id": i, "session_id": s, "role": "user" if i % 2 else "tool_use", "text": "ab"[i % 2]} for s in ("s", "t") for i in range(8)]
    got = transfer.compact(record_rows(spark, rows)).orderBy("session_id", "at").collect()
    assert [(x.session_id, x.at, x.text, x.times) for x in got] == [(s, k, t, 4) for s in ("s", "t") for k, t in ((0, "a"), (1, "b"))]
    assert transfer.compact(record_rows(spark, rows).limit(0)).count() == 0


def test_measures(spark):
    res = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "b"), ("q", 4, "c")], "query_id string, rank int, item string")
    rel = spark.createDataFrame([("q", "b", 2.0), ("q", "c", 1.0), ("q", "x", 1.0), ("none", "y", 1.0)], "query_id string, item string, relevance double")
    got = {r.query_id: r for r in evaluate.measures(res, rel, ["item"], 4).collect()}
    dcg, ideal = 3 / math.log2(3) + 1 / math.log2(5), 3 + 1 / math.log2(3) + 1 / math.log2(4)
    assert math.isclose(got["q"].recall, 2 / 3) and got["q"].reciprocal_rank == 0.5 and math.isclose(got["q"].ndcg, dcg / ideal) and got["none"].recall == 0


def test_transfer_and_paging(spark):
    assert list(transfer.compact_pairs([("u", "a"), ("t", "b")] * 3 + [("u", "c")])) == [("u", "a", 3), ("t", "b", 3), ("u", "c", 1)]
    r = record_rows(spark, [{"turn_id": i, "role": "user" if i % 3 == 0 else "assistant", "text": "same" if i in (4, 5) else f"t{i}"} for i in range(10)])
    assert [x.turn_id for x in context.last_user_turns(r, 2).orderBy("turn_id").collect()] == [6, 7, 8, 9]
    assert transfer.drop_repeats(r).count() == 9
    page = records.session_page(r, "s", 8, 5).collect()
    assert [(x.turn_id, x.total, x.next_offset) for x in page] == [(8, 10, None), (9, 10, None)]
    assert records.in_scope(r, r.limit(0)).count() == 0
    assert records.top_per_session(r.withColumn("score", F.col("turn_id")), 2).count() == 2


def test_parts_grow_in_number_and_not_in_rows(spark):
    few, many = (usage.dealt(spark.range(n), ["id"], most=100) for n in (50, 5000))
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 50
    assert many.count() == 5000 and max(map(len, many.rdd.glom().collect())) < 200
