"""run() against plain Python, stage by stage."""

import random
import zlib

import numpy as np

import corpus_pipeline as c
from traceloom.llm import mixing, token_ids

from .test_decontaminate import brute as contamination
from .test_jaccard import brute as distinct
from .test_quality_rules import brute as measures


def rows():
    r = random.Random(9)
    text = lambda n: " ".join("w%d" % r.randrange(5000) for _ in range(n))
    out = [(i, text(r.randrange(55, 160)), r.choice(["en", "fr"]), r.choice("ab"), 0) for i in range(60)]
    out += [(100 + i, out[i][1], "en", "a", 0) for i in range(10)] + [(200 + i, "short", "en", "b", 0) for i in range(5)]
    for k in range(8):  # near copies, most of them more than three bits of a fingerprint away
        w = out[k][1].split()
        w[5 + 2 * k] = w[-7] = "changed"
        out.append((400 + k, " ".join(w), "fr", "b", 0))
    out += [(300, text(70) + " " + " ".join(f"q{i}" for i in range(12)) + " " + text(70), "en", "a", 0), (301, text(60) + " ### " * 40, "en", "a", 0), (302, None, None, None, None)]
    return out


def test_run_equals_brute_force(spark, tmp_path):
    docs = rows()
    items = [(1, " ".join(f"q{i}" for i in range(15)))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for d in docs:
        n, chars, sym, dup, rep = measures(d[1])
        lines = len([x for x in (d[1] or "").split("\n") if x.strip()])
        if not (n < 50 or 100 * rep > 50 * n or sym > 0.05 * chars or dup > 0.5 * lines):
            kept.append(d)
    stay = {i for i, _ in distinct([(d[0], d[1]) for d in kept])}
    assert len([i for i in stay if i >= 400]) < 8
    kept = [d for d in kept if d[0] in stay and not contamination(d[1], items)[4]]
    assert 0 < len(kept) < 68
    left = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(tuple(d) for d in mixing.sample_documents(left).collect())  # the draw is tested in test_mixing
    coder = token_ids.Encoder(token_ids.default_tokenizer()).tokenizer
    want, at = [], 0
    for d in kept:
        ids = [*coder.encode(d[1], add_special_tokens=False).ids, 0]
        want.append((d[0], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, c.run(spark, str(tmp_path)).collect())) == want
