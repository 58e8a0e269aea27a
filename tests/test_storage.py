import json

from pyspark.sql import functions as F

from traceloom.sinks.snapshots import Store, append_trace, as_json
from traceloom.sources import evalset, lines
from traceloom.streaming import ingest


def test_generations(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    assert s.read() is None
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_path string, n int")
    first = s.publish(df)
    old = s.read()
    s.replace_files(df.filter("source_path = 'a'").withColumn("n", F.lit(9)), df.filter("source_path = 'a'"))
    assert sorted(map(tuple, s.read().collect())) == [("a", 9), ("b", 2)] and old.count() == 2
    s.publish(s.read().repartition(4))
    assert s.collect_garbage(1, dry_run=True) == [first] == s.collect_garbage(1) and len(s.generations()) == 2
    assert s.compact(at_least=2) == s.current() and s.read().count() == 2
    append_trace(df.withColumn("text", F.lit("secret")), f"{tmp_path}/trace", "q", 5)
    assert "text" not in spark.read.json(f"{tmp_path}/trace").columns
    assert json.loads(as_json(df, ["n"]).orderBy("value").first().value) == {"n": 1}


def test_incremental_plan(spark, tmp_path):
    for n, t in (("a", "1\n2\n"), ("b", "1\n"), ("c", "x\n"), ("d", "gone\n")):
        (tmp_path / f"{n}.jsonl").write_text(t)
    state = spark.createDataFrame(ingest.describe(lines.read(spark, str(tmp_path)), 1).collect(), ingest.STATE)
    (tmp_path / "a.jsonl").write_text("1\n2\n3\n4\n")
    (tmp_path / "c.jsonl").write_text("y\n")
    (tmp_path / "d.jsonl").unlink()
    (tmp_path / "e.jsonl").write_text("new\n")
    now = lines.read(spark, str(tmp_path))
    found = ingest.describe(now, 1).drop("lines").withColumn("prefix_hash", F.when(F.col("source_path").endswith("a.jsonl"), F.lit(None)).otherwise(F.col("prefix_hash")))
    head = state.select("source_path", F.col("prefix_hash").alias("_p"))  # the first lines of a grown file, as they were
    found = found.join(head, "source_path", "left").withColumn("prefix_hash", F.coalesce("prefix_hash", "_p")).drop("_p")
    actions = ingest.plan(found, state)
    got = {r.source_path.rsplit("/", 1)[1][0]: r.action for r in actions.collect()}
    assert got == {"a": "append", "b": "skip", "c": "replace", "d": "remove", "e": "replace"}
    assert sorted(r.value for r in ingest.appended(now, state, actions).collect()) == ["3", "4", "new", "y"]


def test_streamed_results_find_their_calls_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "session_id string, turn_id long, role string, call_id string, tool_name string"
    for k, rows in enumerate(([("s", 0, "tool_use", "c", "ls")], [("s", 1, "tool_result", "c", None), ("s", 2, "tool_result", "c", None)])):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(["session_id", "turn_id", "role", "call_id", "tool_name"], r))) for r in rows))
        got = []
        stream = ingest.name_results(spark.readStream.schema(schema).json(str(src)))
        q = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r.turn_id, r.tool_name) for r in sorted(got, key=lambda r: r.turn_id)] == [(1, "ls"), (2, None)]


def test_evaluation_cases_and_requests(spark, tmp_path):
    p = tmp_path / "cases.jsonl"
    p.write_text(json.dumps({"id": "1", "query": " a ", "relevant": [{"doc_id": 3}]}) + "\n")
    cases = evalset.dataset(spark, str(p))
    assert cases.first().views == ["a"] and evalset.qrels(cases).first().relevance == 1.0
    p.write_text(json.dumps({"query": "a", "queries": ["b"], "relevant": [{"doc_id": 3}]}) + "\n")
    try:
        evalset.dataset(spark, str(p))
        raise AssertionError
    except ValueError:
        pass
    p.write_text(json.dumps({"session_id": "s", "limit": 2, "offset": 1}) + "\n")
    r = spark.createDataFrame([("s", "/f", i, 0, i) for i in range(5)], "session_id string, source_path string, turn_id long, ts long, doc_id long")
    assert sorted(x.turn_id for x in evalset.hydrate(r, evalset.requests(spark, str(p))).collect()) == [1, 2]
