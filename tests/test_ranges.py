import os
import random

from traceloom.sources import ranges
from traceloom.streaming.tail import Tail


def write(path, text, mode="w"):
    with open(path, mode, newline="") as f:
        f.write(text)


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_ranges_part_a_file_without_losing_or_repeating_a_line(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    texts = {n: "\n".join("é" * r.randrange(9) + "x" * r.choice([0, 1, 7, 300]) for _ in range(60)) + r.choice(["", "\n"]) for n in "abc"}
    texts |= {"empty": "", "one": "\n", "cr": "a\r\nb\r\n\r\nc"}
    for n, t in texts.items():
        write(tmp_path / f"{n}.jsonl", t)
    files = ranges.listing(spark, str(tmp_path))
    want = {f"file:{tmp_path}/{n}.jsonl": [x.removesuffix("\r") for x in (t[:-1] if t.endswith("\n") else t).split("\n")] if t else [] for n, t in texts.items()}
    assert {r.source_path: r.size for r in files.collect()} == {p: os.path.getsize(p[5:]) for p in want if "empty" not in p}
    whole = files.selectExpr("source_path", "0L as start", "size as end")
    for most in (1, 17, 5000):
        back = {p: [v for _, v in sorted(x)] for p, x in _by_path(ranges.read(ranges.split(whole, most))).items()}
        assert back == {p: x for p, x in want.items() if x}
    assert {p: len(x) for p, x in _by_path(ranges.heads(files, 5), "line_no").items()} == {p: min(5, len(x)) for p, x in want.items() if x}
    assert got(ranges.read(whole.filter("source_path like '%cr.jsonl'"), whole=True), "value") == [("",), ("a",), ("b",)]  # c has no end yet


def _by_path(df, at="start"):
    out = {}
    for r in df.collect():
        out.setdefault(r.source_path, []).append((r[at], r.value))
    return out


def test_a_tail_reads_only_what_was_added(spark, tmp_path, monkeypatch):
    folder, t = tmp_path / "in", Tail(spark, f"file://{tmp_path}/t")
    folder.mkdir()
    name = lambda p: p.rsplit("/", 1)[1][0]
    step = lambda: sorted((name(r.source_path), r.line_no, r.value, r.action) for r in t.advance(ranges.listing(spark, str(folder))).collect())
    table = lambda: sorted((name(r.source_path), r.line_no, r.value) for r in t.read().collect())
    write(folder / "a.jsonl", "1\n2\n3")
    write(folder / "b.jsonl", "x\ny\n")
    write(folder / "c.jsonl", "q\n")
    assert step() == [("a", 0, "1", "replace"), ("a", 1, "2", "replace"), ("b", 0, "x", "replace"), ("b", 1, "y", "replace"), ("c", 0, "q", "replace")]
    assert step() == []
    write(folder / "a.jsonl", "3\n4\n", "a")  # the unfinished line goes on
    write(folder / "b.jsonl", "other\ny\nz\n")  # grown, but not the same beginning
    os.remove(folder / "c.jsonl")
    read = []
    plain = ranges.read
    monkeypatch.setattr(ranges, "read", lambda df, **k: (read.extend((name(r.source_path), r.start, r.end) for r in df.collect()), plain(df, **k))[1])
    assert step() == [("a", 2, "33", "append"), ("a", 3, "4", "append"), ("b", 0, "other", "replace"), ("b", 1, "y", "replace"), ("b", 2, "z", "replace")]
    assert sorted(read) == [("a", 4, 9), ("b", 0, 10)]
    assert table() == [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "33"), ("a", 3, "4"), ("b", 0, "other"), ("b", 1, "y"), ("b", 2, "z")]
    write(folder / "a.jsonl", "1\n")  # shrunk
    assert step() == [("a", 0, "1", "replace")] and table()[0] == ("a", 0, "1") and len(table()) == 4
