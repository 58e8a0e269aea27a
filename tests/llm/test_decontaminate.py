import hashlib
import re

from traceloom.llm import decontaminate as d

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for k in range(max(len(v) - 10, 0) + 1 if v else 0):
            g = v[k : k + 10]
            for a in range(len(w) - len(g) + 1):
                if w[a : a + len(g)] == g:
                    hit |= set(range(a, a + len(g)))
                    ids |= {str(i)} - {"None"}
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, " ".join(f"q{i}" for i in range(25))), (10, "Short é-item"), (2, None), (3, "!!"), (7, " ".join(f"q{i}" for i in range(12))), (8, "a a a a a a a a a a a"), (None, "no id at all"), (None, "short é item"), (7, "q1")]
DOCS = [(0, None), (1, ""), (2, "x " + ", ".join(f"Q{i}" for i in range(25)) + " y"), (3, "SHORT\né item"), (4, "short éx item"), (5, "q0 q1 q2"), (6, "a " * 30), (7, " ".join(f"q{i}" for i in range(5, 16)) + " short é item"), (8, "İ" * 5 + " q1"), (9, "Here: no id, at all"), (9, "again no id at all"), (10, "filler " * 40_000 + "no id at all " + "filler " * 40_000)]


def test_equals_brute_force(spark, monkeypatch):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted((i, *brute(t, ITEMS)) for i, t in DOCS)
    for most, portion in ((d.SHARD_BYTES, d.PORTION), (400, 100), (30, d.PORTION)):  # one shard, and several
        monkeypatch.setattr(d, "PORTION", portion)
        monkeypatch.setattr(d.shards, "__defaults__", (most,))
        got = sorted(tuple(r) for r in d.contamination(docs, "doc_id", "text", items, "item_id", "text").collect())
        assert got == want
    assert sorted(r.doc_id for r in d.remove_contaminated(docs, items).collect()) == [w[0] for w in want if not w[5]]
    assert d.contamination(docs, "doc_id", "text", items.limit(0), "item_id", "text").filter("contaminated").count() == 0
    assert d.contamination(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_spans_point_into_the_original_text():
    t = "Oh:  Short, É-Item!"
    assert [t[a:b] for a, b in d.spans(t, [(1, 3)])] == ["Short, É-Item"]


def test_one_automaton_is_held_at_a_time(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(60)], "item_id long, text string")
    folders = d.shards(spark, d.windows(items, "item_id", "text"), 4_000)
    sizes = [sum(len(g) for g, _ in d.patterns(f)) for f in folders]
    assert len(folders) > 10 and max(sizes) < 12_000 and sum(sizes) > 40_000
    for f in folders:
        d._scanner(f)
        assert list(d._last) == [f]


def test_names_that_clash_are_kept(spark):
    docs = spark.createDataFrame([(1, "short é item", "a", 2, 3), (2, "fine", None, 4, 5)], "doc_id long, text string, row string, starts int, items int")
    items = spark.createDataFrame([(1, "short é item", 1)], "item_id long, text string, window int")
    got = d.remove_contaminated(docs, items)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "fine", None, 4, 5)]
