"""Token ids in binary files, packed with Simple-8b.

A 64-bit word is a 4-bit selector and 60 bits that hold 1 to 60 ids of equal width; an id of over 60 bits is an escape:
a word with selector 0, then the id as a word of its own. Ids are cut into blocks of `BLOCK`; a block starts at a word
whose offset the file's index names, so that blocks decode on their own, all words of a selector at once.

File: magic; words of all blocks; index: word offset of each block, then id, null flag and number of ids of each
document; three 64-bit numbers (blocks, documents, ids); magic. All numbers are little-endian.

Texts are dealt in ranges of the id, encoded and written in that order; a task's file goes into the shared folder
under a name of its own attempt, and only files of finished tasks are in the manifest.

Encoding: where a blank follows a character that is none, the byte-level tokenizer always starts a new piece, so a text
is cut there, and a piece that was met before is not encoded again (a bounded cache, `Encoder`). Special tokens in a
text are ids of their own, as the library has it by default.

Defined results: null text is empty and has the end id alone; null ids come last; equal ids are ordered by the text's
hash, then by the text; an empty table writes no file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, scratch_path, table

MAGIC = b"S8BTOK01"
BLOCK = 1 << 16
KEPT = 1_000_000
TOGETHER = 8_192  # pieces
TEXTS = 8_000_000  # bytes of texts at a time
#: Ids in a word and bits of each, by selector. Selector 0 is the escape, 1 is unused.
SELECTORS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}


_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)  # bits of small ids


def pack(ids: np.ndarray) -> np.ndarray:
    """Words of ids (unsigned). At each place the selector that takes the most ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return ids
    if ids.max() < len(_WIDTH):
        width = _WIDTH.take(ids.view(np.int64))
    else:
        width = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # bits; one too many above 2**53 does no harm
    best = np.where(width <= 60, 15, 0).astype(np.uint8)
    widest, reach = width.copy(), 1
    for s, (k, bits) in sorted(SELECTORS.items(), reverse=True)[1:]:
        if k > n:
            break
        while reach < k:
            np.maximum(widest[: n - reach], width[reach:], out=widest[: n - reach])
            reach += 1
        fits = widest[: n - k + 1] <= bits
        if not fits.any():
            break  # nor do more ids in fewer bits
        np.copyto(best[: n - k + 1], s, where=fits)
    taken = np.ones(16, dtype=np.uint8)
    for s, (k, _) in SELECTORS.items():
        taken[s] = k
    step = taken[best].tobytes()
    at, begins = 0, bytearray(n)
    while at < n:
        begins[at] = 1
        at += step[at]
    starts = np.flatnonzero(np.frombuffer(begins, dtype=bool))
    sel = best[starts]
    long = sel == 0
    place = np.arange(len(starts)) + np.cumsum(long) - long
    words = np.zeros(len(starts) + int(long.sum()), dtype=np.uint64)
    words[place[long] + 1] = ids[starts[long]]
    for s, (k, bits) in SELECTORS.items():
        on = np.flatnonzero(sel == s)
        if len(on):
            first = starts[on]
            held = ids[first] | np.uint64(s << 60)
            for j in range(1, k):
                held |= ids[first + j] << np.uint64(j * bits)
            words[place[on]] = held
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(sel == 0).tolist():
        if not raw[k]:
            raw[k + 1] = True
    count = np.zeros(16, dtype=np.int64)
    count[0] = 1
    for s, (k, _) in SELECTORS.items():
        count[s] = k
    each = np.where(raw, 0, count[sel])
    start = np.cumsum(each) - each
    out = np.zeros(int(each.sum()), dtype=np.uint64)
    long = np.flatnonzero((sel == 0) & ~raw)
    out[start[long]] = words[long + 1]
    for s, (k, bits) in SELECTORS.items():
        on = np.flatnonzero((sel == s) & ~raw)
        if len(on):
            shift = np.arange(k, dtype=np.uint64) * np.uint64(bits)
            out[start[on][:, None] + np.arange(k)] = (words[on][:, None] >> shift) & np.uint64((1 << bits) - 1)
    return out


#: Letters at the start of a piece; what follows them is a piece of its own to the tokenizer.
HEAD = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def rough(texts: pa.Array) -> pa.Array:
    """Texts (large_string) cut before each space and line feed, and before a comma or full stop behind an ASCII letter or
    digit, as lists; only where no blank comes before do the cuts at blanks hold."""
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
    marked = pc.replace_substring_regex(marked, "([A-Za-z0-9])([.,])", "\\1\0\\2")
    return pc.split_pattern(marked, "\0")


def pieces(text: str) -> list[str]:
    """text in pieces whose encodings make up that of text; only the last may end with a blank."""
    out: list[str] = []
    for p in re.split(r"(?=[ \n])", text):
        if out and out[-1][-1:].isspace():
            out[-1] += p
        elif p:
            out.append(p)
    return out


def ends_blank(texts: pa.Array, same: list[str]) -> np.ndarray:
    """Which texts (large_string, and the same as a list) are empty or end with a blank."""
    stop = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    out = np.diff(stop) == 0
    final = np.zeros(len(same), np.uint8)
    final[~out] = data[stop[1:][~out] - 1]
    for k in np.flatnonzero(~out & ((final <= 32) | (final >= 128))).tolist():
        out[k] = same[k][-1].isspace()
    return out


class Encoder:
    """Texts to ids (4 bytes each, little-endian).

    Encoded pieces are kept in two generations of KEPT each: when the younger is full, it becomes the older one, and
    the pieces that had not been met again since are forgotten. New pieces are encoded as one text, whose ids are dealt
    out by the bytes that they stand for. With `special`, special tokens in a text are told apart, as by the library's
    default; without it, they are text like any other. Where a special token could reach over a cut, texts are encoded
    whole.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder()
        self.whole = any(a.lstrip or a.rstrip or a.single_word or a.content[-1:] in ".," or any(c.isspace() for c in a.content) or re.search("[A-Za-z0-9][.,]", a.content) for a in added.values())
        self.heads = not any((m := HEAD.match(a.content)) and m.end() < len(a.content) for a in added.values())
        known = self.tokenizer.get_vocab()
        self.size = np.zeros(max(known.values(), default=0) + 1, dtype=np.int64)  # bytes that an id stands for
        for token, i in known.items():
            self.size[i] = len(added[i].content.encode()) if i in added else len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Pieces that start with a blank and don't end with one keep apart within one text."""
        apart = [p for p in new if p[0] not in " \n"]
        self.young.update(zip(apart, self._plain(apart), strict=True))
        new = [p for p in new if p[0] in " \n"]
        for k in range(0, len(new), TOGETHER):
            some = new[k : k + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            reach, ends = np.cumsum(self.size[ids]), np.cumsum(pc.binary_length(pa.array(some, pa.string())).to_numpy())
            cuts = np.searchsorted(reach, ends)
            if len(reach) and reach[-1] == ends[-1] and (reach[cuts] == ends).all():
                raw, stops = ids.tobytes(), (4 * (cuts + 1)).tolist()
                self.young.update(zip(some, (raw[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
            else:  # a tokenizer whose ids don't stand for the text's own bytes
                self.young.update(zip(some, self._plain(some), strict=True))

    def _meet(self, missing: list[str]) -> None:
        """Where letters end, and before a comma or full stop behind a letter or digit, the tokenizer starts a new piece, too."""
        young, old = self.young, self.old
        new, parted = set(), []
        for p in missing:
            if p in old:
                young[p] = old[p]
            elif p[1:].isalpha():
                new.add(p)
            else:
                m = HEAD.match(p) if self.heads else None
                k = m.end() if m else len(p)
                if k == len(p) > 1 and p[-1] in ".," and p[-2].isalnum():
                    k -= 1
                if k == len(p):
                    new.add(p)
                    continue
                parted.append((p, k))
                for part in (p[:k], p[k:]):
                    if part not in young:
                        if part in old:
                            young[part] = old[part]
                        else:
                            new.add(part)
        self._learn(list(new))
        for p, k in parted:
            young[p] = young[p[:k]] + young[p[k:]]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        ids_of = lambda raw: np.frombuffer(raw, dtype="<u4")
        if self.whole:
            return [ids_of(x) for x in self._plain(texts.to_pylist())]
        lists = rough(texts)
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        code, held = coded.indices.to_numpy(), pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string()))
        distinct = pc.binary_join(held, "\0")[0].as_py().split("\0") if len(coded.dictionary) else []
        bad = ends_blank(coded.dictionary, distinct)
        apart = np.zeros(len(texts), bool)  # texts with a cut that doesn't hold
        apart[np.searchsorted(ends, np.flatnonzero(bad[code]), side="right") - 1] = True
        apart |= pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        own = {k: pieces(texts[k].as_py()) for k in np.flatnonzero(apart).tolist()}
        needed = np.zeros(len(distinct), bool)
        needed[code[~np.repeat(apart, np.diff(ends))]] = True
        used = [p for p, on in zip(distinct, needed.tolist(), strict=True) if on]
        raw = list(map(self.young.get, used))
        unknown = [k for k, r in enumerate(raw) if r is None]
        missing = set().union(*(set(c) - self.young.keys() for c in own.values()))
        blank = [p for p in missing if p[-1].isspace()]  # none is in a text whose cuts all hold
        last = dict(zip(blank, self._plain(blank), strict=True))
        self._meet([*(p for p in missing if p not in last), *(used[k] for k in unknown)])
        young = self.young
        for k in unknown:
            raw[k] = young[used[k]]
        flat = ids_of(b"".join(raw))
        size, first = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        size[needed] = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        first[needed] = np.cumsum(size[needed]) - size[needed]
        each = size[code]  # 0 for a piece that only texts to do apart have
        each[np.repeat(apart, np.diff(ends))] = 0
        reach = np.cumsum(each)
        ids = flat[np.repeat(first[code] - (reach - each), each) + np.arange(int(reach[-1]) if len(reach) else 0)]
        stops = np.concatenate([[0], reach])[ends].tolist()
        out = [ids[a:b] for a, b in zip(stops, stops[1:], strict=False)]
        for k, c in own.items():
            out[k] = ids_of(b"".join(last[p] if p in last else young[p] for p in c))
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        return out


_encoders: dict[str, Encoder] = {}  # one in each worker process


class TokenFile:
    """Writes one file."""

    def __init__(self, out):
        self.out, self.held, self.n_held, self.offset, self.blocks, self.docs, self.ids = out, [], 0, 0, [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        n = sum(map(len, ids))
        self.docs.append((doc_id or 0, doc_id is None, n))
        self.ids += n
        self.held += ids
        self.n_held += n
        if self.n_held >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint64)
        while len(ids) >= least and len(ids):
            words = pack(ids[:BLOCK])
            self.blocks.append(self.offset)
            self.out.write(words.astype("<u8").tobytes())
            self.offset += len(words)
            ids = ids[BLOCK:]
        self.held, self.n_held = [ids], len(ids)

    def close(self) -> None:
        self._flush(1)
        self.out.write(np.array([*self.blocks, self.offset], dtype="<i8").tobytes())
        for k, kind in ((0, "<i8"), (1, "u1"), (2, "<i8")):
            self.out.write(np.array([d[k] for d in self.docs], dtype=kind).tobytes())
        self.out.write(struct.pack("<QQQ", len(self.blocks), len(self.docs), self.ids) + MAGIC)
        self.out.close()


def read_file(f) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file that can be sought: id and its ids."""
    size = f.size()
    f.seek(size - 32)
    tail = f.read(32)
    blocks, docs, total = struct.unpack("<QQQ", tail[:24])
    f.seek(0)
    if tail[24:] != MAGIC or f.read(8) != MAGIC:
        raise ValueError("not a token file")
    index = 8 * (blocks + 1) + 17 * docs
    f.seek(size - 32 - index)
    raw = f.read(index)
    offset = np.frombuffer(raw, "<i8", blocks + 1)
    at = 8 * (blocks + 1)
    doc_id, null, count = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "u1", docs, at + 8 * docs), np.frombuffer(raw, "<i8", docs, at + 9 * docs)
    held, block, seen = np.zeros(0, np.uint64), 0, 0
    for i, none, n in zip(doc_id.tolist(), null.tolist(), count.tolist(), strict=True):
        parts, have = [held], len(held)
        while have < n:
            f.seek(8 + 8 * int(offset[block]))
            parts.append(unpack(np.frombuffer(f.read(8 * int(offset[block + 1] - offset[block])), "<u8")))
            have += len(parts[-1])
            block += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield (None if none else i), held[:n]
        seen += n
        held = held[n:]
    if seen != total or len(held) or block != blocks:
        raise ValueError("a token file's index differs from its blocks")


def parts_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about TEXTS bytes or one text each."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64)
    starts = np.unique((np.cumsum(size) - size) // TEXTS, return_index=True)[1].tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=False):
        yield batch.slice(a, b - a)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes docs in order of id; returns the manifest (part, path, docs, ids; parts are in order) and the folder."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("h"))
    order = [F.col("id").asc_nulls_last(), F.col("h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("h")

    def write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        path = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.s8b"
        last = np.array([end], dtype="<u4")
        coder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer, special=True))
        out = None
        for batch in batches:
            for part in parts_of(batch, 1):
                out = out or TokenFile(store.open_output_stream(path))
                for i, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1)), strict=True):
                    out.add(i, ids, last)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([path]), pa.array([len(out.docs)], pa.int64()), pa.array([out.ids], pa.int64())], ["part", "path", "docs", "ids"])

    return checkpointed(rows.mapInArrow(write_batches, "part int, path string, docs long, ids long")), folder


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the manifest's files."""
    at, first = 0, {}
    for r in manifest.orderBy("part").collect():  # one row a task
        first[r.path] = at
        at += r.ids
    held = manifest.sparkSession.sparkContext.broadcast(first)
    kinds = [pa.int64()] * 4

    def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                start, rows = held.value[path], []
                with store.open_input_file(path) as f:
                    for i, ids in read_file(f):
                        rows.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path").repartition(max(len(first), 1), "path").mapInArrow(read_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes docs, then reads the files back."""
    return read_tokens(*write_tokens(docs, doc_id, text, tokenizer or default_tokenizer()))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
