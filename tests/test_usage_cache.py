import json
import uuid

from pyspark.sql import functions as F

from traceloom.sinks.usage_cache import UsageCache
from traceloom.sources import codex

LINES = "value string, source_path string, size long, modified long, line_no int"


def line(at, kind, **payload):
    return json.dumps({"timestamp": f"2025-03-01T00:00:{at:02d}Z", "type": kind, "payload": payload})


def tokens(at, n):
    four = {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": n, "reasoning_output_tokens": 0}
    return line(at, "event_msg", type="token_count", info={"total_token_usage": four})


class Folder:
    """Files by session: path -> (modified, lines)."""

    def __init__(self, spark):
        self.spark, self.files, self.clock, self.read_paths = spark, {}, 0, []

    def put(self, path, lines):
        self.clock += 1
        self.files[path] = (self.clock, lines)

    def listing(self):
        return self.spark.createDataFrame([(p, sum(map(len, x)), t) for p, (t, x) in self.files.items()], "source_path string, size long, modified long")

    def lines(self, paths=None):
        rows = [(v, p, 0, t, k) for p, (t, x) in self.files.items() for k, v in enumerate(x)]
        df = self.spark.createDataFrame(rows, LINES)
        return df if paths is None else df.join(paths, "source_path", "left_semi")


def ids(n):
    return str(uuid.UUID(int=n))


def test_a_parent_s_change_recomputes_exactly_its_forks(spark, tmp_path, monkeypatch):
    f, done = Folder(spark), []
    plain = codex.usage

    def seen(files):
        done.append(sorted(r.source_path for r in files.select("source_path").distinct().collect()))
        return plain(files)

    monkeypatch.setattr(codex, "usage", seen)
    path = lambda n, copy="": f"/s{copy}/rollout-{ids(n)}.jsonl"
    head = lambda at, n, parent=None: line(at, "session_meta", id=ids(n), cwd="/w", **({"forked_from_id": ids(parent)} if parent else {}))
    f.put(path(1), [head(1, 1), tokens(2, 40)])
    f.put(path(2), [head(5, 2, 1), tokens(6, 40), tokens(7, 55)])
    f.put(path(3), [head(5, 3, 2), tokens(6, 70)])
    f.put(path(4), [head(5, 4), tokens(6, 5)])
    f.put(path(5), [head(5, 5, 9), tokens(6, 5), tokens(7, 9)])  # its parent isn't there

    def step(*computed, needed=()):
        done.clear()
        got = codex.cached_usage(f.listing(), f.lines, f"file://{tmp_path}/cache")
        assert done == ([sorted({*computed, *needed})] if computed else [])
        key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
        assert key(got) == key(plain(f.lines()))

    step(*f.files)
    f.put(path(9), [head(1, 9), tokens(2, 5)])
    step(path(9), path(5))  # 5 was open
    f.put(path(1), [*f.files[path(1)][1], tokens(4, 50)])
    step(path(1), path(2))  # not 3, which depends on 2 alone
    f.put(path(1, "copy"), [head(1, 1), tokens(3, 52)])  # another file of the parent's session
    step(path(1, "copy"), path(2), needed=[path(1)])
    del f.files[path(1, "copy")], f.files[path(4)]
    step(path(2), needed=[path(1)])


def test_reasons_and_parser_versions(spark, tmp_path):
    listing = lambda rows: spark.createDataFrame(rows, "source_path string, size long, modified long, session_id string")
    none = lambda paths: paths.select("source_path", F.lit(None).cast("string").alias("parent_id")).limit(0)
    compute = lambda paths, needed: paths.withColumn("n", F.lit(1))
    root = f"file://{tmp_path}/c"
    cache = UsageCache(spark, root)
    assert cache.refresh(listing([("a", 1, 1, "s"), ("b", 1, 1, None)]), none, compute).count() == 2
    reasons = lambda c, rows: {r.source_path: r.reason for r in c.stale(listing(rows)).collect()}
    assert reasons(cache, [("a", 1, 2, "s"), ("c", 1, 1, "s")]) == {"a": "changed", "b": "gone", "c": "new"}
    assert reasons(UsageCache(spark, root, parser=2), [("a", 1, 1, "s"), ("b", 1, 1, None)]) == {"a": "changed", "b": "changed"}
    assert cache.refresh(listing([]), none, compute).count() == 0
