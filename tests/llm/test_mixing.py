import random

import numpy as np

from traceloom.llm import mixing as m


def docs_of(spark, n=600):
    r = random.Random(8)
    rows = [(i, "w " * r.randrange(1, 1500), r.choice(["a", "a", "b", "c"]), r.choice(["en", "en", "fr"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_marginals_meet_their_targets_as_a_plain_fit_does(spark):
    _, docs = docs_of(spark)
    seen = m.features(docs, docs.text, docs.source, docs.lang, None, docs.doc_id).drop("text").cache()
    cells = seen.groupBy(*(seen[f"f_{d}"].alias(d) for d in m.DIMENSIONS)).agg({"f_tokens": "sum"}).withColumnRenamed("sum(f_tokens)", "tokens")
    goal = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"en": 0.6, "fr": 0.4}}
    targets = {d: spark.createDataFrame(list(g.items()), "level string, share double") for d, g in goal.items()}
    got = m.rake(cells, targets).toPandas()
    w = {tuple(x): t for *x, t in cells.select(*m.DIMENSIONS, "tokens").collect()}
    total = sum(w.values())
    tops = {}
    for k, t in w.items():
        tops[k[2]] = tops.get(k[2], 0) + t
    z = sum(t**0.7 for t in tops.values())
    goal["topic"] = {k: t**0.7 / z for k, t in tops.items()}
    w = {k: t / total for k, t in w.items()}
    for _ in range(200):
        for j, d in enumerate(m.DIMENSIONS):
            now = {}
            for k, x in w.items():
                now[k[j]] = now.get(k[j], 0) + x
            w = {k: x * goal[d][k[j]] / now[k[j]] for k, x in w.items()}
    for r in got.itertuples():
        assert abs(r.weight - w[(r.source, r.lang, r.topic)]) < 0.01
    p = m.calibrate(m.rake(cells, targets), 0.5).toPandas()
    assert abs((p.share * p.probability).sum() - 0.5) < 1e-3 and p.probability.max() <= 1


def test_draw_is_stable_and_near_the_fraction(spark):
    rows, docs = docs_of(spark)
    kept = {r.doc_id for r in m.sample_documents(docs).collect()}
    assert kept == {r.doc_id for r in m.sample_documents(docs.repartition(7)).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    assert abs(sum(size[i] for i in kept) / sum(size.values()) - 0.8) < 0.08


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 5), (1, None, None, None, 5), (None, "a b", "s", "en", 6)], "doc_id long, text string, source string, lang string, f_draw int")
    got = m.sample_documents(docs, mix=m.Mix(fraction=1.0))
    assert got.columns == docs.columns and (None, "a b", "s", "en", 6) in [tuple(r) for r in got.collect()]
    assert m.sample_documents(docs.limit(0)).count() == 0
    none = {"lang": spark.createDataFrame([("fr", 1.0)], "level string, share double")}
    assert m.sample_documents(docs, targets=none).count() == 0
    assert np.isfinite(m.plan(m.features(docs.drop("f_draw"), docs.text, docs.source, docs.lang, None, docs.doc_id)).toPandas().f_probability).all()
