import random

import numpy as np

from traceloom.llm import quality_crf as q
from traceloom.llm import toxicity as x


def test_pairs_weigh_more_than_their_parts():
    r = random.Random(1)
    texts, y = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join(["insult"] * a + ["group"] * b + [f"w{r.randrange(300)}" for _ in range(20)]))
        y.append(float(a and b))
    m = x.learn([x.hashed(t) for t in texts], np.array(y))
    s = m.score([x.hashed(t) for t in ("insult w1", "group w2", "INSULT, group!", "w1 w2")])
    assert s[2] > 0.5 > max(s[0], s[1], s[3])


def test_pairs_that_tell_nothing_alone():
    """One of two words is toxic, both or none are not: neither tells the classes apart alone."""
    r = random.Random(1)
    texts, y = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join(["insult"] * a + ["group"] * b + [f"w{r.randrange(300)}" for _ in range(20)]))
        y.append(float(a != b))
    m = x.learn([x.hashed(t) for t in texts[:1200]], np.array(y[:1200]))
    assert np.mean((m.score([x.hashed(t) for t in texts[1200:]]) > 0.5) == np.array(y[1200:])) > 0.97


def test_a_rare_word_counts_in_a_pair(monkeypatch):
    """As above, but one of the words is in 4 of 100 texts."""
    monkeypatch.setattr(x, "ROWS", 700)
    monkeypatch.setattr(x, "BLOCK", 50)
    r = random.Random(1)
    texts, y, rare = [], [], []
    for _ in range(5000):
        a, b = r.random() < 0.5, r.random() < 0.04
        texts.append(" ".join(["insult"] * a + ["group"] * b + [f"w{r.randrange(300)}" for _ in range(20)]))
        y.append(float(a != b))
        rare.append(b)
    m = x.learn([x.hashed(t) for t in texts[:4000]], np.array(y[:4000]))
    right = (m.score([x.hashed(t) for t in texts[4000:]]) > 0.5) == np.array(y[4000:])
    assert right[np.array(rare[4000:])].mean() >= 0.95 and right.mean() > 0.97


def test_a_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k % 9}") for k in range(50)] + [(2, "b"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    got = x.sample(docs, labels, "doc_id", "text", "toxic", 10)
    assert sorted((r.doc_id, r.y) for r in got.collect()) == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert x.sample(docs, labels, "doc_id", "text", "toxic", 2).count() <= 2


def test_scores_equal_a_sum_over_pairs():
    r = np.random.default_rng(3)
    m = x.Machine(0.3, np.sort(r.choice(1000, 60, replace=False)).astype(np.int32), r.normal(size=60), r.normal(size=(60, 3)) / 3)
    found = [np.sort(r.choice(1000, n, replace=False)).astype(np.int32) for n in (0, 1, 5, 200)]
    for h, got in zip(found, m.score(found)):
        at = [k for k, t in enumerate(m.terms) if t in h]
        z = m.bias + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for i in at for j in at if i < j)
        assert np.isclose(got, 1 / (1 + np.exp(-z)))


def test_clashing_names_long_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "bad insult " * 30_000, 1.0, "r", 3), (2, "fine", None, None, None), (2, "fine", None, None, None)], "doc_id long, text string, score double, row string, y int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    for module in (x, q):
        rows = module.score(docs, "text", module.train(docs, labels, "doc_id", "text", "toxic")).collect()
        assert sorted((r.row.doc_id, r.row.row, r.row.score) for r in rows if r.row.row) == [(1, "r", 1.0)] and len(rows) == 3
        assert all(0 <= r.score <= 1 for r in rows)
        none = docs.limit(0)
        assert {r.score for r in module.score(docs, "text", module.train(none, labels, "doc_id", "text", "toxic")).collect()} == {0.5}


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    none = x.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert [r.score for r in x.score(docs, "text", none).collect()] == [0.5] * 4
    some = x.train(docs, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int"), "doc_id", "text", "toxic")
    assert len(set(r.score for r in x.score(docs, "text", some).collect())) == 1


def test_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    count = np.array([3, 0, 1, 4])
    u, move = r.normal(size=8), r.normal(size=(2, 2))
    got, pairs, logz = q.marginals(u, move, count)
    at, want, total, all_pairs = 0, [], 0.0, np.zeros((2, 2))
    for n in count:
        if n:
            z, good, pr = 0.0, np.zeros(n), np.zeros((2, 2))
            for k in range(2**n):
                y = [k >> i & 1 for i in range(n)]
                w = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
                z += w
                good += w * np.array(y)
                for a, b in zip(y, y[1:]):
                    pr[a, b] += w
            want += list(good / z)
            all_pairs += pr / z
            total += np.log(z)
            at += n
    assert np.allclose(got, want) and np.allclose(pairs, all_pairs) and np.isclose(logz, total)


def test_lines_of_one_text_differ():
    """Documents are wholly good, wholly bad, or half bad and labelled bad; no line has a label."""
    r = random.Random(8)
    line = lambda tail: " ".join(f"w{r.randrange(500)}{tail}" for _ in range(15))
    text = lambda kinds: "\n".join(line("***" if k == "b" else "") for k in kinds)
    kinds = [r.choice(["gggggg", "gggggg", "bbbbbb", "gggbbb", "bbbggg"]) for _ in range(400)]
    f = q.learn(*q.measures([text(k) for k in kinds]), np.array([float("b" not in k) for k in kinds]))
    one, two = text("ggggbbbb"), text("bbbbgggg")
    x, lengths, count = q.measures([one, two])
    good = q.marginals(q.features(x, count) @ f.theta, f.move, count)[0].reshape(2, 8)
    assert good[0, :3].min() > 0.8 and good[0, 5:].max() < 0.2 and good[1, 5:].min() > 0.8 and good[1, :3].max() < 0.2
    s = q.quality([text("gggggg"), text("bbbbbb"), text("gggbbb")], f)
    assert s[0] > 0.9 and s[1] < 0.1 and s[2] < 0.3
    # a document's score is the curve at the length-weighted mean of its lines
    by_hand = (good[0] * lengths[:8]).sum() / lengths[:8].sum()
    assert np.isclose(q.aggregate(good.ravel(), lengths, count)[0], by_hand)
    z = f.slope * np.log(by_hand / (1 - by_hand)) + f.level
    assert np.isclose(q.quality([one], f)[0], 1 / (1 + np.exp(-z)))


def test_quality_learns_lines_and_meets_edges(spark):
    r = random.Random(3)
    good = lambda: "\n".join(" ".join(f"w{r.randrange(500)}" for _ in range(15)) for _ in range(6))
    bad = lambda: "\n".join(" ".join(f"w{r.randrange(500)}***" for _ in range(15)) for _ in range(6))
    texts = [good() if k % 3 else bad() for k in range(300)]
    f = q.learn(*q.measures(texts), np.array([float(k % 3 > 0) for k in range(300)]))
    s = q.quality([good(), bad(), None, "", " \n\n", "x " * 50_000], f)
    assert s[0] > 0.9 and s[1] < 0.2 and np.allclose(s[2:5], 2 / 3) and np.isfinite(s).all()
    docs = spark.createDataFrame([(1, None), (None, good()), (3, bad()), (3, bad())], "doc_id long, text string")
    assert q.score(docs, "text", f).count() == 4 and q.score(docs.limit(0), "text", f).count() == 0
    assert set(q.quality(["a"], q.train(docs, spark.createDataFrame([], "doc_id long, quality int"), "doc_id", "text", "quality"))) == {0.5}
