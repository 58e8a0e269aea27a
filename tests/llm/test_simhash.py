import random

import numpy as np
import xxhash

from traceloom.llm import simhash as s


def brute_fp(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and bin(fps[x] ^ fps[y]).count("1") <= 3:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    r = random.Random(5)
    base = ["w%d" % r.randrange(10**6) for _ in range(300)]
    out = [None, "", " \n", "A", "a", "One two", "one TWO three", " ".join(base), " ".join(base).upper()]
    for k in range(40):
        c = list(base)
        c[r.randrange(300)] = "x%d" % k
        out.append(" ".join(c))
    return out + [" ".join("v%d" % r.randrange(10**6) for _ in range(50)) for _ in range(30)]


def test_fingerprints_and_components_equal_brute_force(spark):
    t = texts()
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in s.near_duplicates(docs, "doc_id", "text").collect()}
    fps = {i: brute_fp(x) for i, x in enumerate(t)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    want = brute_components(fps)
    assert {i: r.component_id for i, r in got.items()} == want
    kept = {r.doc_id for r in s.keep_one(docs).collect()}
    assert kept == set(want.values())


def test_chains_and_crowds_lose_no_link():
    r = np.random.default_rng(3)
    center = r.integers(0, 2**63, 1, dtype=np.uint64)[0]
    fps = {int(center)}
    for _ in range(400):
        x = int(center)
        for b in r.integers(0, 64, r.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    want = brute_components(dict(enumerate(fps.tolist())))
    keys = []
    for k in range(64):
        seg, p = divmod(k, 32)
        v = (fps >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF) & np.uint64(0xFFFFFFFF ^ (1 << p))
        keys.append((np.uint64(k) << np.uint64(32)) + v)
    key = np.concatenate(keys).view(np.int64)
    rep = np.tile(fps, 64)
    o = np.argsort(key, kind="stable")
    for crowd in (4096, 16):
        a, b = s.link_runs(key[o], rep[o], 3, crowd)
        node, root = s.contract(a, b)
        got = dict(zip(node.tolist(), root.tolist(), strict=True))
        of = {f: got.get(f, f) for f in fps.tolist()}
        assert len(set(of.values())) == len(set(want.values()))
        for i, f in enumerate(fps.tolist()):
            assert of[f] == of[int(fps[want[i]])]


def test_repeated_rows_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 9), (1, "a b c d", 9), (2, "A b c d", 8), (None, "zz", 7), (None, None, 6)], "doc_id long, text string, fp int")
    got = s.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a b c d", 9), (None, "zz", 7), (None, None, 6)], key=str)
    assert s.keep_one(docs.limit(0)).count() == 0
