import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from traceloom.llm import lexical_search as s
from traceloom.llm.heaps import Heaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, n long, terms string", "item_id long, text string, score long"


def plain(docs, items, k=10):
    """Every document against every item."""
    words = [(i, TERM.findall((t or "").translate(FOLD))) for i, t, *_ in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    counts = [(i, Counter(w), len(w)) for i, w in words]
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t, *_ in items}:
        query, found = TERM.findall((text or "").translate(FOLD)), []
        for i, c, size in counts:
            if size:
                m = 25 + 75 * size * n // total
                found.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in query), i))
        found = sorted(((x, i) for x, i in found if x > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, i, x) for r, (x, i) in enumerate(found, 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, parts=5, **more):
    got = s.search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), **more)
    assert got.columns == ["item", "item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def case(seed=1, n=300):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "Éa", "x1", *(f"w{int(r.expovariate(0.1))}" for _ in range(6))])
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 60))), 9, "clash") for i in range(n)]
    docs += [(i, "same text of copies", 1, None) for i in range(1000, 1030)] + [(1000, "same text of copies", 1, None)] * 3
    docs += [(None, "the copies", 0, "a"), (2000, None, 0, "a"), (2001, "", 0, "a"), (2002, "_-!\0", 0, "a"), (2003, "LONG the_of " * 10_000, 0, "a"), (2004, "thé of-İ K", 0, "a")]
    items = [(k, " ".join(word() for _ in range(r.randrange(1, 12))), 5) for k in range(20)]
    return docs, items + [(50, "of the the THE copies", 1), (51, "nothingheld", 1), (52, None, 1), (53, "", 1), (54, "copies", 1), (54, "copies", 2), (None, "same İ", 0)]


def test_search_equals_every_document_against_every_item(spark):
    docs, items = case()
    assert ranked(spark, docs, items) == plain(docs, items)


def test_blocks_and_small_steps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(s, "CELLS", 64)
    docs, items = case(2, 80)
    assert ranked(spark, docs, items[:9], parts=2, block=150, k=3) == plain(docs, items[:9], 3)


def test_two_texts_under_one_id_are_ranked_apart(spark):
    docs = [(1, "a b", 0, ""), (2, "c c", 0, "")]
    assert ranked(spark, docs, [(7, "a", 0), (7, "c", 0)]) == plain(docs, [(7, "a"), (7, "c")])


def test_empty_tables(spark):
    docs, items = case(3, 5)
    assert ranked(spark, [], items) == ranked(spark, docs, []) == ranked(spark, [(1, "!", 0, "")], items) == []


def test_terms_are_those_of_the_pattern():
    texts = ["A b_C", "x y", "\x7f\x80 É1", None, "", "a" * 10_000, "İ k"]
    assert [[t.decode() for t in w] for w in s.terms_of(pa.array(texts))] == [TERM.findall((t or "").translate(FOLD)) for t in texts]
    assert [len(w) for w in s.terms_of(pa.array(texts).slice(5))] == [1, 2]


def test_heaps_keep_the_first_of_each_group():
    r = np.random.default_rng(3)
    rows = [(int(g), int(x), int(i), bool(b)) for g, x, i, b in zip(r.integers(0, 4, 500), r.integers(0, 9, 500), r.permutation(500), r.random(500) < 0.1, strict=True)]
    heaps = Heaps(4, 5)
    for k in range(0, 500, 37):
        heaps.add(*(np.array(c) for c in zip(*rows[k : k + 37], strict=True)))
    want = [x for g in range(4) for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[3], x[2]))[:5]]
    assert list(zip(heaps.group.tolist(), heaps.score.tolist(), heaps.id.tolist(), heaps.null.tolist(), strict=True)) == want
