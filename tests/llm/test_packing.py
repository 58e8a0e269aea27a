import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from traceloom.llm import packing as p
from traceloom.llm.token_ids import default_tokenizer

from .. import compare

DOCS = "doc_id long, text string, ids string, open boolean"


def case(n=150):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "x", "42,"]) for _ in range(int(r.expovariate(0.01)))), "clash", True) for i in range(n)]
    return rows + [(900, None, "", None), (901, "", "", None), (902, "one " * 9000, None, False), (None, "no id", "", True), (5, "again", "", True), (5, "again", "", True)]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def encoded(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, docs, size):
    """Pieces (doc_id, start, length, crc, total, sequence, offset) cut documents whole and lie gapless in sequences."""
    want, sequences = defaultdict(list), defaultdict(list)
    for i, text, *_ in docs:
        want[i].append(encoded(text))
    for i, start, length, crc, total, q, offset in pieces:
        assert length > 0 and any(len(ids) == total and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc for ids in want[i])
        sequences[q].append((offset, length))
    for i, ids in want.items():
        got = sorted((start, length) for j, start, length, *_ in pieces if j == i)
        assert sum(x for _, x in got) == sum(map(len, ids))
        if len(ids) == 1:
            assert [s for s, _ in got] == list(np.cumsum([0, *(x for _, x in got)])[:-1])
    used = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        used.append(at)
    return used


@pytest.mark.parametrize(("parts", "size", "most", "together"), [(1, 2048, 32, 2048), (7, 64, 4, 9), (5, 32, 2, 5)])
def test_every_id_lies_in_one_piece(spark, parts, size, most, together):
    docs = case()
    got = p.digests(p.pack(spark.createDataFrame(docs, DOCS).repartition(parts), size=size, most=most, together=together, slack=2))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    used = check([tuple(r) for r in got.collect()], docs, size)
    assert all(size - u <= 2 or u & (u - 1) == 0 for u in used)


def test_the_query_on_the_driver_s_table(spark):
    if not compare.there():
        pytest.skip("needs the driver's tables")
    docs = [tuple(r) for r in spark.read.parquet(f"{compare.SF}/documents.parquet").select("doc_id", "text").collect()]
    df = p.op12_packing(spark, compare.SF)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7
    rows = [tuple(r) for r in df.collect()]
    used = check(rows, docs, 2048)
    assert sum(2048 - u for u in used if u & (u - 1)) <= 0.004 * sum(used)
    whole = {len(encoded(t)) for _, t in docs}
    assert sum(r[2] == r[4] for r in rows) >= 0.8 * sum(x <= 2048 for x in whole)  # few that fit are cut


def test_best_fit_emits_the_fullest():
    packer = p.Packer(10, 2, 1)
    put = lambda i, n: [[x[0] for x in w] for w in packer.place(i, 0, np.arange(n, dtype="<u4"), n)]
    assert put(1, 6) == [] and put(2, 9) == []
    assert put(3, 3) == []  # in the window of 1, the only one with room
    assert put(4, 2) == [[1, 3]]  # none has room: the fullest goes, its gap is within the slack
    assert put(5, 25) == [[5], [5]]  # full windows, the rest fits beside 4
    assert [[x[0] for x in w] for w in packer.rest()] == [[2], [4, 5]]


def test_a_larger_gap_takes_the_head():
    packer = p.Packer(10, 1, 1)
    assert packer.place(1, 0, np.arange(6), 6) == []
    (window,) = packer.place(2, 0, np.arange(7), 7)
    assert [(x[0], x[1], len(x[2])) for x in window] == [(1, 0, 6), (2, 0, 4)]
    assert [(x[0], x[1], len(x[2])) for x in packer.rest()[0]] == [(2, 4, 3)]


def test_leftovers_end_in_powers_of_two():
    windows = [[(k, 0, np.arange(n), n)] for k, n in enumerate((900, 2000, 1, 2047, 133))]
    sizes = [sum(len(x[2]) for x in w) for w in p.filled(windows)]
    assert sum(sizes) == 5081 and sizes[:2] == [2048, 2048] and all(x & (x - 1) == 0 for x in sizes)


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], DOCS)).count() == 0
