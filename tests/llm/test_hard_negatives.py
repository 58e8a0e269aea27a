import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import hard_negatives as h

ROWS = "vec_id long, embedding array<float>, label int, key string, low double"


def plain(rows, every=50, positives=5, negatives=3):
    ok = [(i, [math.floor(256 * x) for x in map(float, v)], l) for i, v, l, *_ in rows if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    by = lambda x: (-x[0], x[1] is None, x[1] or 0)
    anchors, out = [], []
    for a in ok:
        if a[0] is not None and a[0] % every == 0 and a not in anchors:
            anchors.append(a)
    for i, v, label in anchors:
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, l) for j, w, l in ok if j != i]
        for p, j, _ in sorted((x for x in scored if x[2] == label), key=by)[:positives]:
            fit = sorted((x for x in scored if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p), key=by)[:negatives]
            out += [(i, j, r, k, p, n) for r, (n, k, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows, parts=4, every=50, **more):
    got = h.mine(spark.createDataFrame(rows, ROWS).repartition(parts), F.col("id") % every == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(seed, n, dims, labels, hot=0.0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=dims)
    v = r.normal(size=(n, dims)) * np.linspace(2, 0.2, dims)
    near = r.random(n) < hot
    v[near] = centre + r.normal(size=(int(near.sum()), dims)) * 0.05
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(i, [float(np.float32(y)) for y in x], int(c), "clash", 1.0) for i, (x, c) in enumerate(zip(v, r.integers(0, labels, n), strict=True))]


@pytest.mark.parametrize(("dims", "labels", "hot"), [(16, 4, 0.0), (13, 3, 0.4), (3, 40, 0.0), (1, 2, 0.5)])
def test_mining_equals_all_pairs(spark, dims, labels, hot):
    rows = vectors(dims, 600, dims, labels, hot)
    assert mined(spark, rows) == plain(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", (3, 7))
    rows = vectors(9, 200, 20, 3, 0.3)
    assert mined(spark, rows, every=10, most=4) == plain(rows, 10)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, [1.0, 0.5 if i % 3 else -0.25, 0.125 * (i % 2)], i % 2, "k", None) for i in range(60)]  # many ties
    odd = [(100, None, 1, "k", 0.0), (150, [1.0, None, 1.0], 1, "k", 0.0), (200, [nan, 1.0, 0.0], 0, "k", 0.0), (201, [inf, 1.0, 0.0], 0, "k", 0.0), (250, [1.0, 1.0, 0.0], None, "k", 0.0)]
    odd += [(300, [], 1, "k", 0.0), (350, [0.0, 0.0, 0.0], 0, "k", 0.0), (400, [-1.0, 0.0, 0.0], 0, "k", 0.0), (None, [1.0, 0.1, 0.0], 1, "k", 0.0), (61, [1.0], 0, "k", 0.0), (62, [0.5, 0.5, 0.0, 9.0], 1, "k", 0.0)]
    odd += [(0, [1.0, -0.25, 0.0], 0, "repeat", 1.0), (7, [1.0, 0.5, 0.125], 1, "repeat", 1.0), (450, [3000.0, 2.0, -1.0], 1, "k", 0.0)]
    assert mined(spark, base + odd) == plain(base + odd)


def test_too_large_scores_are_an_error(spark):
    rows = [(0, [1e9], 1, "", 0.0), (1, [1e9], 1, "", 0.0)]
    with pytest.raises(Exception, match="2\\^53"):
        mined(spark, rows)


def test_empty_tables_and_few_rows(spark):
    assert mined(spark, []) == mined(spark, [(50, [1.0], 1, "", 0.0)]) == mined(spark, [(1, [1.0], 1, "", 0.0)]) == []


def test_the_join_misses_nothing_and_indexes_only_what_it_must():
    r = np.random.default_rng(4)
    for scale, least in ((1, 0.0), (0.2, 3000.0), (1, 9000.0), (1, 1e9)):
        q, x = (np.floor(256 * r.normal(size=(n, 21)) * np.linspace(1, 0.1, 21) * scale) for n in (17, 90))
        t = np.full(17, least) * r.uniform(0.8, 1.2, 17)
        a, b, s = h.reaching(q, h.tails(q), t, x, h.tails(x))
        want = q @ x.T
        assert sorted(zip(a.tolist(), b.tolist(), s.tolist(), strict=True)) == sorted((i, j, int(want[i, j])) for i, j in zip(*np.nonzero(want >= t[:, None]), strict=True))
