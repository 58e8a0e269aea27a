import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import jaccard as j


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} or ({b" ".join(w)} if w else set())


def brute(rows):
    """Rows that stay: of each component the smallest id."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(x)] = find(y)
    return sorted(min(rows[k] for k in range(len(rows)) if find(k) == c) for c in {find(k) for k in range(len(rows))})


def rows():
    r = random.Random(8)
    base = [["w%d" % r.randrange(3000) for _ in range(r.randrange(5, 200))] for _ in range(25)]
    note = ["n%d" % k for k in range(40)]  # stands in many texts
    out = [" ".join(b + note * r.randrange(2)) for b in base]
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(r.randrange(0, 2 + len(b) // 30)):
                c[r.randrange(len(c))] = "x%d" % r.randrange(10**6)
            out.append(" ".join(c))
    return list(enumerate([*out, None, "", " \n", "A b", "a  B", "a"]))


@pytest.mark.parametrize("crowd", [256, 2])
def test_every_pair_is_found(spark, monkeypatch, crowd):
    monkeypatch.setattr(j, "SAMPLE", 2)
    t = rows()
    docs = spark.createDataFrame(t, "doc_id long, text string").repartition(3)
    want = [i for i, _ in brute([(i, x or "") for i, x in t])]
    assert len(want) < len(t) - 30
    assert sorted(x.doc_id for x in j.keep_one(docs, crowd=crowd).collect()) == want


def test_the_stage_finds_copies_beyond_three_bits(spark):
    import corpus_pipeline
    from traceloom.llm import simhash

    r = random.Random(3)
    base = ["w%d" % r.randrange(10**6) for _ in range(150)]
    out = [" ".join(base)]
    for k in range(12):
        c = list(base)
        c[20 + 9 * k] = c[25 + 9 * k] = "x%d" % k
        out.append(" ".join(c))
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    assert simhash.keep_one(docs).count() > 1
    assert [x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]


def test_an_id_on_two_texts_keeps_both_components(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "p q r s"), (2, "p q r s"), (3, "a b c d"), (1, "a b c d"), (None, "zz"), (None, "ZZ")], "doc_id long, text string")
    got = sorted(map(tuple, j.keep_one(docs).collect()), key=str)
    assert got[:2] == [(1, "a b c d"), (1, "p q r s")] and len(got) == 3 and got[2][0] is None
    assert j.keep_one(docs.limit(0)).count() == 0


def test_sketches_differ_in_no_more_shares_than_sets_in_shingles(spark):
    r = np.random.default_rng(4)
    rows = []
    for n, m, shared in ((50, 60, 40), (2040, 2060, 2000), (4090, 4100, 4000), (5000, 5200, 4900), (9000, 9000, 9000), (3000, 3000, 0)):
        x = np.unique(r.integers(0, 2**63, 3 * n + m, dtype=np.uint64))
        r.shuffle(x)
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:shared], x[n : n + m - shared]]))
        rows.append((j.sketch(a).tolist(), j.sketch(b).tolist(), n + m - 2 * shared))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, d int").select(j.differing(F.col("a"), F.col("b")), "d", F.size("a"), F.size("b")).collect()
    assert all(0.7 * d <= x <= d for x, d, *_ in got[:5]) and got[5][0] > 1000
    assert [x[2:] for x in got[:4]] == [(32, 32), (32, 64), (64, 128), (128, 128)]


def test_a_group_is_linked_by_few_comparisons(spark, monkeypatch):
    compared = []
    plain = j.near_pairs
    monkeypatch.setattr(j, "near_pairs", lambda pairs, sets: (compared.append(pairs.count()), plain(pairs, sets))[1])
    r = random.Random(2)
    base = ["w%d" % r.randrange(10**6) for _ in range(120)]
    out = [" ".join(base[:k] + ["x%d" % k] + base[k + 1 :]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    assert [x.doc_id for x in j.keep_one(docs).collect()] == [0] and sum(compared) < 100


def test_the_stage_links_by_fingerprints_first(spark):
    """Within three bits by three-word shingles with repeats, but far apart as sets of five-word shingles."""
    import corpus_pipeline
    from traceloom.llm import simhash

    words = [f"w{k}" for k in range(11)] * 40
    other = [*words[:40], "else", *words[41:]]
    texts = [" ".join(words), " ".join(other), "one two three four five six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b, c = (int(x.fingerprint, 16) for x in simhash.near_duplicates(docs, "doc_id", "text").orderBy("doc_id").collect())
    assert (a ^ b).bit_count() <= 3 < (a ^ c).bit_count() and len(j.keep_one(docs).collect()) == 3
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


def test_a_pair_that_fingerprints_connect_is_not_compared(spark, monkeypatch):
    compared = []
    plain = j.near_pairs
    monkeypatch.setattr(j, "near_pairs", lambda pairs, sets: (compared.append(pairs.count()), plain(pairs, sets))[1])
    r = random.Random(5)
    words = ["w%d" % r.randrange(10**6) for _ in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.doc_id for x in j.keep_one(docs, bits=3).collect()] == [0] and sum(compared) == 0
    assert [x.doc_id for x in j.keep_one(docs).collect()] == [0] and sum(compared) == 1


def test_tables_on_the_way_go(spark, tmp_path, monkeypatch):
    import os

    from traceloom import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    out = scratch.settled(spark, lambda: scratch.cut(spark.range(3), "way").filter("id > 0"), "end")
    assert [d.split("-")[0] for d in os.listdir(tmp_path)] == ["end"] and out.count() == 2


def test_sets_of_a_crowd_without_a_partner_do_not_move(spark, monkeypatch):
    """Texts that share a passage and nothing else, and two that are similar: two sets are brought together under the key."""
    moved = []
    plain = j.crowd_links
    monkeypatch.setattr(j, "crowd_links", lambda members: (moved.append(members.select("sid").distinct().count()), plain(members))[1])
    monkeypatch.setattr(j, "prefix", lambda s, common: s)  # the passage is a key of all
    r = random.Random(6)
    note = ["n%d" % k for k in range(6)]
    out = [" ".join([*note, *("w%d" % r.randrange(10**6) for _ in range(100 + 40 * (k % 8)))]) for k in range(40)]
    out.append(out[0] + " more")
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    assert sorted(x.doc_id for x in j.keep_one(docs, crowd=8).collect()) == list(range(40)) and moved == [2]


def test_sketches_of_a_crowd_rule_out_no_similar_set():
    r = np.random.default_rng(5)
    sets = []
    for n in (40, 255, 256, 300, 511, 513, 1030, 2500):
        x = np.unique(r.integers(0, 2**63, 3 * n, dtype=np.uint64))
        r.shuffle(x)
        sets += [np.sort(x[:n]), np.sort(x[: n - n // 5]), np.sort(x[2 * n :])]
    size = np.array([len(s) for s in sets])
    like = np.array([any(k != m and j.similar(len(np.intersect1d(a, b)), len(a), len(b)) for m, b in enumerate(sets)) for k, a in enumerate(sets)])
    got = j.may_match([j.sketch(s, j.LOOK).view(np.uint64) for s in sets], size)
    assert like.sum() >= 16 and got[like].all() and not got[2::3].any()
