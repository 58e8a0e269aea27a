import re
from collections import Counter

from traceloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", "a b c a b c a b c", "x\ny\nx\n \n\n", "one  two\tthree four #*$", "w " * 4000, "a b a b a", " lead and trail ", "é" * 10 + "\n" + "é" * 10, "🙂 b c 🙂 b c d 🙂 b c"]


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.measure(docs, "text").collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_hosts_are_shrunk_and_join_back(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, "bad", "worst") for i in range(40)] + [(200, "bad", "tiny"), (201, good, None), (202, good, "worst")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = q.measure(docs, "text")
    assert m.columns[:2] == ["doc_id", "source"]
    v = {r.host: r for r in q.host_verdicts(m.select(m.source.alias("host"), q.failures(lambda k: m[k])["any"].alias("failed"))).collect()}
    assert v["worst"].host_ok is False and v["good"].host_ok is True and v[""].docs == 1
    assert v["tiny"].rate < 1.0 and 0 < v["good"].rate < 0.1
    kept = {r.doc_id for r in q.filter_documents(docs).collect()}
    assert kept == {*range(40), 201}  # 202 is good itself, its host isn't


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_words int, row int, kept string")
    assert q.filter_documents(docs).columns == docs.columns and q.filter_documents(docs).count() == 0
    one = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "a", 7, 8, "x")], docs.schema)
    assert q.filter_documents(one).collect() == one.collect()


def test_no_text_is_written_on_the_way(spark, tmp_path, monkeypatch):
    import os

    from traceloom import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(k, "s%d" % (k % 2), " ".join("w%d" % (k + j) for j in range(60))) for k in range(6)], "doc_id long, source string, text string")
    assert q.filter_documents(docs).count() == 6
    assert [d.split("-")[0] for d in os.listdir(tmp_path)] == ["hosts"]
