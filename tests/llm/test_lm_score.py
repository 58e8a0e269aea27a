import math
import random
import zlib
from collections import Counter

import numpy as np

from traceloom.llm import lm_score as m


def rows():
    r = random.Random(6)
    vocab = ["w%d" % k for k in range(400)]
    text = lambda: " ".join(vocab[min(int(r.expovariate(0.02)), 399)] for _ in range(r.randrange(1, 80)))
    return [(i, text()) for i in range(200)] + [(900, None), (901, ""), (902, "NEVER seen É"), (None, "w1 w2"), (3, "w1 w1"), (3, "w1 w1")]


def split(t):
    return [*(t or "").encode().lower().split(), b""]


def wanted(out):
    """Per row: id, tokens, known tokens, base score, score, of a plain dictionary model with quantised counts."""
    train = [t for i, t in out if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for t in train for w in split(t))
    two = Counter(p for t in train for p in zip([b"", *split(t)], split(t)))
    n, v = sum(one.values()), len(one)
    rough = lambda c: 2 ** ((math.floor(4 * math.log2(c) + 1e-9) + 0.5) / 4) if c else 0.0

    def p(h, w):
        alone = (rough(one[w]) + 1) / (n + v + 1)
        return 0.3 * min(rough(two[h, w]) / rough(one[h]), 1) + 0.7 * alone if one[h] else alone

    base = lambda t: sum(math.log10((one[w] + 1) / (n + v + 1)) for w in split(t))
    return n, sorted((str(i), len(split(t)), sum(one[w] > 0 for w in split(t)), round(base(t), 6), round(sum(math.log10(p(h, w)) for h, w in zip([b"", *split(t)], split(t))), 6)) for i, t in out)


def held():
    return m.F.pmod(m.id_crc(m.F.col("doc_id")), m.F.lit(7)) == 2


def test_scores_equal_brute_force(spark, monkeypatch):
    out = rows()
    n, want = wanted(out)
    docs = spark.createDataFrame(out, "doc_id long, text string").repartition(3)
    for chunk, shard in ((m.CHUNK, m.SHARD), (200, 500)):  # one shard; many chunks and shards
        monkeypatch.setattr(m, "CHUNK", chunk)
        monkeypatch.setattr(m, "SHARD", shard)
        got = m.score(docs, "text", ~held(), bits_each=64).collect()  # no probe is answered wrongly
        assert {r.train_tokens for r in got} == {n}
        assert sorted((str(r.row.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_false_probes_move_scores_little(spark):
    out = rows()
    docs = spark.createDataFrame(out, "doc_id long, text string").repartition(3)
    want = {x[0]: x[1:] for x in wanted(out)[1]}
    gap = [abs(r.score - want[str(r.row.doc_id)][3]) / r.n_tokens for r in m.score(docs, "text", ~held()).collect() if r.row.doc_id not in (3,)]
    assert np.mean(gap) < 0.01


def test_levels_are_within_a_quarter_of_a_doubling():
    r = np.random.default_rng(4)
    grams, counts = r.integers(0, 2**63, 20_000, dtype=np.uint64), r.integers(1, 5000, 20_000)
    f = m.Filter.build(grams, counts)
    ratio = m.expected(f.levels(grams)) / counts
    assert (ratio > 0.91).all() and np.mean(ratio < 1.1) > 0.97  # a false probe can only raise a level
    assert (f.levels(r.integers(0, 2**63, 20_000, dtype=np.uint64)) > 0).mean() < 0.03


def test_words_are_those_of_the_contract():
    texts = [None, "", " a  B\tc\x0b\x0cd\r\n", "É\u00a0x\u3000y \x1c \x00 a"]
    code, count, words = m.coded(m.pa.array(texts, m.pa.string()))
    got = [words[c] for c in code]
    assert got == [m.xxhash.xxh64_intdigest(w) for t in texts for w in split(t)] and count.tolist() == [len(split(t)) for t in texts]
    many = [t for _, t in rows()]
    for k in range(0, len(many), 7):
        code, count, words = m.coded(m.pa.array(many, m.pa.string()).slice(k, 7))
        assert [words[c] for c in code] == [m.xxhash.xxh64_intdigest(w) for t in many[k : k + 7] for w in split(t)]


def test_probabilities_sum_to_about_one():
    c = np.array([400.0, 200.0, 200.0, 1.0])  # of a, b, c and the end; after a come b and c
    total = (10 ** m.log_probabilities(c, np.full(4, 400.0), np.array([0, 200.0, 200.0, 0]), 801, 4)).sum()
    assert 0.95 < total < 1.05


def test_empty_training_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", None)], "doc_id long, text string, chunk int, words string, row int")
    r = m.score(docs, "text", m.F.lit(False)).first()
    assert (r.row.chunk, r.row.words, r.row.row, r.n_tokens, r.n_known, r.base_score, r.score) == (5, "x", None, 3, 0, 0.0, 0.0)
    assert m.score(docs.limit(0), "text", m.F.lit(True)).count() == 0
    long = m.score(spark.createDataFrame([(1, "w " * 300_000), (2, "w")], "doc_id long, text string"), "text", m.F.lit(True)).collect()
    assert sorted(r.n_tokens for r in long) == [2, 300_001]
