import base64
import hashlib
import io
import random
import zlib

import numpy as np

from traceloom.llm import token_ids as t
from traceloom.llm import warc as w


def page_rows():
    r = random.Random(4)
    rows = [(i, f"http://a/{i}", "<html>" + " ".join("word%d" % r.randrange(200) for _ in range(200))) for i in range(120)]
    return rows + [(500 + k, "http://c", "same") for k in range(30)] + [(700, "u", None), (701, None, ""), (702, "x", "é🙂\r\n\r\n"), (710, "d", "twice"), (710, "d", "twice"), (None, "n", "same")]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    manifest, folder = w.archive(pages, "page_id", "url", "html", folder=f"file://{tmp_path}/a")
    got = [tuple(r) for r in w.read_archives(manifest, folder).collect()]
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    want, seen = [], set()
    for i, _, h in rows:
        b = (h or "").encode()
        first = i == least[h or ""] and (i, h) not in seen
        seen.add((i, h))
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else least[h or ""]))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    assert w.archive(pages.limit(0), "page_id", "url", "html", folder=f"file://{tmp_path}/b")[0].count() == 0


def test_dictionary_leads_the_file_and_records_stand_alone():
    r = random.Random(1)
    records = [w.record(i, "u", ("<p>boilerplate header</p>" + " ".join("t%d" % r.randrange(99) for _ in range(90))).encode(), "S", None, False) for i in range(400)]
    out = io.BytesIO()
    close = out.close
    out.close = lambda: None
    f = w.Writer(out)
    for x in records:
        f.add(x)
    f.close()
    data = out.getvalue()
    close()
    assert int.from_bytes(data[:4], "little") == w.SKIPPABLE and data[8:12] == b"\x37\xa4\x30\xec"
    for block in (7, 1 << 20):
        assert list(w.read(io.BytesIO(data), block)) == records


def test_words_round_trip():
    r = np.random.default_rng(1)
    for ids in ([], [0], [5] * 1000, [0] * 500, [2**64 - 1, 1, 2**60, 2**60 - 1, 0, 2**53 + 1] * 9, r.integers(0, 50257, 70_001), r.integers(0, 3, 999), 2 ** r.integers(0, 63, 5000)):
        a = np.array(ids, dtype=np.uint64)
        assert (t.unpack(t.pack(a)) == a).all()


TEXTS = ["", " ", "a", "Hello  world", "  lead", "tail  ", "a\n\nb", "a \n b", "x\ty z", "it's I'll", "\0 a\0 b", "<|endoftext|> x", "é 🙂  q　 w", "\r\n line", "1 23,4. 5", " \n \n", "a\x1c b\x85 c", "y" * 5000, "the the " * 300, "one, two. three., 4, é, x.y,z ., ,", "s, 's, a's. don't,"]


def test_pieces_encode_as_the_whole(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(t.default_tokenizer())
    whole.encode_special_tokens = True
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice(["a", "B", " ", " ", "\n", "\t", "'s", "1", ".", ",", "é", " ", "\0", "!"]) for _ in range(40)) for _ in range(3000)]
    coder = t.Encoder(t.default_tokenizer())
    monkeypatch.setattr(t, "KEPT", 50)  # generations change often
    got = [x for k in range(0, len(texts), 100) for x in coder.encode(texts[k : k + 100])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_slices_encode_as_their_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(t, "TEXTS", 60)
    texts = [*TEXTS, None, *TEXTS]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([x or "" for x in texts])], ["id", "text"])
    parts = list(t.parts_of(batch, 1))
    coder = t.Encoder(t.default_tokenizer())
    assert len(parts) > 5 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [x.tolist() for p in parts for x in coder.encode(p.column(1))] == [x.tolist() for x in coder.encode([x or "" for x in texts])]


def test_files_round_trip_in_order(spark, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(t.default_tokenizer())
    rows = [(k * 7 % 61, x) for k, x in enumerate(TEXTS * 3)] + [(3, None), (None, "no id"), (-5, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, t.tokenized(docs).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids[0] == -5 and ids[-1] is None and ids[:-1] == sorted(ids[:-1]) and len(got) == len(rows)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    crc = lambda x: zlib.crc32(np.array([*whole.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    assert sorted((i if i is not None else 10**9, crc(x)) for i, x in rows) == sorted((r[0] if r[0] is not None else 10**9, r[3]) for r in got)
    assert t.tokenized(docs.limit(0)).count() == 0
