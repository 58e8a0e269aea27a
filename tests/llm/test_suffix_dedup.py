import hashlib
import random
from collections import Counter

import numpy as np

from traceloom.llm import suffix_dedup as d
from traceloom.llm import suffixes as s

W = 400


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + W] for b in data for i in range(len(b) - W + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - W + 1):
            if seen[b[i : i + W]] > 1:
                gone[i : i + W] = b"\1" * W
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(140), text(600)
    out = [None, "", "a" * 399, "a" * 400, "b" * 401, "c" * 3000, passage[:420], "ab" * 400, long, long, long[:1500] + "X" + long[1500:], long[700:2000]]
    for k in range(25):
        out.append(text(r.randrange(1, 60)) + passage + text(r.randrange(1, 60)))
    return out + [text(200) for _ in range(10)] + [passage + text(3) + passage, "🙂" * 300, "x" + "🙂" * 120]


def test_suffix_array_equals_sorting():
    r = random.Random(1)
    for _ in range(1500):
        k = r.choice([1, 2, 3, 8])
        a = [r.randrange(k) for _ in range(r.randrange(0, 40))]
        assert s.suffix_array(a) == sorted(range(len(a)), key=lambda i: a[i:])


def test_repeated_windows_equal_brute_force():
    r = random.Random(2)
    for _ in range(40):
        alpha = r.choice([b"a", b"ab", b"abcdefghijk \n", bytes(range(256))])
        pool = [bytes(r.choice(alpha) for _ in range(r.randrange(300, 900))) for _ in range(3)]
        got = [b"".join(r.choice(pool)[r.randrange(50) :] for _ in range(r.randrange(1, 4))) for _ in range(6)]
        got = sorted({t for t in got if len(t) >= W})
        times = [r.choice([1, 1, 2]) for _ in got]
        seen = Counter()
        for t, m in zip(got, times):
            for i in range(len(t) - W + 1):
                seen[t[i : i + W]] += m
        for t, (a, b) in zip(got, s.repeated(got, times, W) if got else []):
            hit = np.zeros(len(t) - W + 1, bool)
            for x, y in zip(a, b):
                hit[x:y] = True
            assert hit.tolist() == [seen[t[i : i + W]] > 1 for i in range(len(t) - W + 1)]


def test_no_hash_decides_what_is_equal(monkeypatch):
    """With one hash for all bytes borders stand everywhere, and the result is the same."""
    r = random.Random(5)
    passage = bytes(r.choice(b"abc ") for _ in range(450))
    own = lambda n, end: bytes(r.choice(b"abc ") for _ in range(n)) + end
    got = [own(499, b"%d" % k) + passage + b"%d" % k + own(r.randrange(90), b"") for k in range(4)]
    got += [passage[:399] + b"x" * 80, passage[:400], bytes(900), bytes(450) + b"y"]
    plain = [tuple(map(np.ndarray.tolist, x)) for x in s.repeated(got, [1] * len(got), W)]
    monkeypatch.setattr(s, "mix", lambda h: np.zeros(len(h), np.uint64))
    assert [tuple(map(np.ndarray.tolist, x)) for x in s.repeated(got, [1] * len(got), W)] == plain
    assert plain[0] == ([500], [551]) and plain[5] == ([0], [1]) and plain[6] == ([0], [501]) and plain[7] == ([0], [51])


def test_documents_equal_brute_force(spark):
    t = texts()
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    want = brute(t)
    for crowd in (d.CROWD, 3, 1):  # without and with crowded keys, down to windows
        got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in d.dedup(docs, "text", crowd=crowd).collect()}
        assert [got[i] for i in range(len(t))] == want


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, digest int, key string, data int, runs string, row int, kept int"
    assert d.dedup(spark.createDataFrame([], schema), "text").count() == 0
    rows = [(1, "a" * 450, 1, "k", 2, "r", 3, 4), (None, "b" * 500 + "c", 5, None, None, None, None, None), (1, "a" * 450, 6, "k", 2, "r", 3, 4)]
    got = sorted((r.row.digest, r.row.key, r.row.row, r.row.kept, r.n_bytes, r.n_removed, bytes(r.kept)) for r in d.dedup(spark.createDataFrame(rows, schema), "text").collect())
    assert got == [(1, "k", 3, 4, 450, 450, b""), (5, None, None, None, 501, 500, b"c"), (6, "k", 3, 4, 450, 450, b"")]
