import json
import random
import zlib

import numpy as np

from traceloom.llm import token_ids as t

from .test_files import TEXTS

MORE = ["a<|endoftext|>b", "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b\n\n<|endoftext|>,", "x,<|endoftext|>y. <|endoftext|>", "<|endof text|>", "<|endoftext|><|endoftext|>."]


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(t.default_tokenizer())


def test_ids_are_those_of_the_plain_call(spark):
    whole = plain()
    assert whole.encode(MORE[0], add_special_tokens=False).ids == [64, 50256, 65]
    rows = list(enumerate([*TEXTS, *MORE]))
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in t.tokenized(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = {i: [*whole.encode(x, add_special_tokens=False).ids, 0] for i, x in rows}
    assert got == {i: (len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in ids.items()}


def test_pieces_with_special_tokens(tmp_path, monkeypatch):
    from tokenizers import AddedToken, Tokenizer

    r = random.Random(7)
    texts = TEXTS + MORE + ["".join(r.choice(["a", " ", " ", "\n", "'s", "1", ".", ",", "é", "\0", "<|endoftext|>", "<|end", " |>"]) for _ in range(30)) for _ in range(2000)]
    monkeypatch.setattr(t, "KEPT", 50)
    wide = Tokenizer.from_file(t.default_tokenizer())
    wide.add_special_tokens([AddedToken("a 1", lstrip=True)])
    wide.save(f"{tmp_path}/wide.json")
    assert json.load(open(f"{tmp_path}/wide.json"))["added_tokens"][-1]["content"] == "a 1"
    for path in (t.default_tokenizer(), f"{tmp_path}/wide.json"):
        coder, whole = t.Encoder(path, special=True), Tokenizer.from_file(path)
        assert coder.whole == path.endswith("wide.json")
        got = [x for k in range(0, len(texts), 100) for x in coder.encode(texts[k : k + 100])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_what_ends_letters_is_encoded_apart_from_them(monkeypatch):
    """Known words with new ends: only the words are new to the tokenizer, and the ids stay those of whole texts."""
    coder = t.Encoder(t.default_tokenizer(), special=True)
    texts = ["Größe one$$$ two,three one. x9,8 3.14 ê.a don't áb,", "one,*** two$$$ one, two. Größe!! a-b.c one", "<|endoftext|>one.<|endoftext|>, ", "one\ttwo.\n,one ..., ,two"]
    learned = []
    plain = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda new: (learned.extend(new), plain(new))[1])
    for text in texts:
        got, = coder.encode([text])
        assert got.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert not {" one$$$", " two$$$", " Größe!!", " one."} & set(learned) and " one" in learned
