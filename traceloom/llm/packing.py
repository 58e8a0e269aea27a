"""Documents packed into sequences of a fixed number of tokens, online and in bounded space.

Each task keeps at most `OPEN` windows open. What a document has beyond full windows goes into the fullest window with
room for it (best fit), or into a new one; if none has room and all are open, the fullest one is emitted. Its gap is
left as padding only up to `SLACK` tokens; a larger one takes the head of the document, whose rest is placed again. So
memory doesn't grow with the input, and nearly all documents that fit a window stay whole.

The windows left open at the end of each task meet in fewer tasks, `TOGETHER` a task, and are packed the same way, piece
by piece, until one task has the last of them: it fills windows one after another and cuts the remainder into sequences
of powers of two. Sequences are written to the shared folder: their ids (4 bytes each, little-endian) and pieces.

Defined results: null and empty texts are the end id alone; null ids and repeated rows are documents of their own; an
empty table gives no sequence; texts of any length are taken whole, in full windows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .token_ids import Encoder, _encoders, default_tokenizer, parts_of

SIZE = 2048
OPEN = 32
SLACK = 8
#: Open windows that meet in one task; over twice OPEN, so that rounds end.
TOGETHER = 2_048
_EMIT = 512  # sequences in a batch

PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int32()), ("doc_tokens", pa.int64())])
SEQUENCE = "sequence_id long, open boolean, ids binary, pieces array<struct<doc_id: long, start: long, length: int, offset: int, doc_tokens: long>>"

#: A piece: document id, its first token's place in the document, ids, tokens of the document.
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Windows that are open now; `place` returns those that are emitted."""

    def __init__(self, size: int = SIZE, most: int = OPEN, slack: int = SLACK):
        self.size, self.most, self.slack = size, most, slack
        self.room: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def place(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> list[list[Piece]]:
        out, at = [], 0
        while at < len(ids):
            left = len(ids) - at
            if left >= self.size:
                out.append([(doc, start + at, ids[at : at + self.size], total)])
                at += self.size
                continue
            k = bisect.bisect_left(self.room, (left, -1))
            if k < len(self.room):
                free, window = self.room.pop(k)
                take = left
            elif len(self.room) < self.most:
                free, window, take = self.size, self.made, left
                self.held[window] = []
                self.made += 1
            else:
                free, window = self.room.pop(0)
                take = free if free > self.slack else 0
            if take:
                self.held[window].append((doc, start + at, ids[at : at + take], total))
                at += take
            if take in (0, free):
                out.append(self.held.pop(window))
            else:
                bisect.insort(self.room, (free - take, window))
        return out

    def rest(self) -> list[list[Piece]]:
        """The open windows, fullest first; none is open afterwards."""
        out = [self.held[w] for _, w in self.room]
        self.room, self.held = [], {}
        return out


def filled(windows: list[list[Piece]], size: int = SIZE) -> list[list[Piece]]:
    """The pieces of windows in full ones, the remainder in ones of a power of two; pieces are cut where one ends."""
    left = sum(len(p[2]) for w in windows for p in w)
    out, now, room = [], [], 0
    for doc, start, ids, total in (p for w in windows for p in w):
        at = 0
        while at < len(ids):
            if not room:
                room = size if left >= size else 1 << (left.bit_length() - 1)
                now = []
                out.append(now)
            take = min(room, len(ids) - at)
            now.append((doc, start + at, ids[at : at + take], total))
            at, room, left = at + take, room - take, left - take
    return out


def _batch(windows: list[list[Piece]], first: int, opened: bool) -> pa.RecordBatch:
    flat = [p for w in windows for p in w]
    size = np.array([len(p[2]) for p in flat], np.int32)
    ends = np.cumsum([0, *map(len, windows)])
    reach = np.concatenate([[0], np.cumsum(size)])
    offset = reach[:-1] - np.repeat(reach[ends[:-1]], np.diff(ends))
    pieces = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.int64()), pa.array(size), pa.array(offset.astype(np.int32)), pa.array([p[3] for p in flat], pa.int64())], fields=list(PIECE))
    ids = pa.array([b"".join(p[2].tobytes() for p in w) for w in windows], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(windows))), pa.array([opened] * len(windows)), ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pieces)], ["sequence_id", "open", "ids", "pieces"])


def _packed(documents: Iterator[Piece], turn: int, last: bool, size: int, most: int, slack: int) -> Iterator[pa.RecordBatch]:
    """A task's sequences; with `last` none stays open. sequence_id: round, task, number."""
    packer, out, n = Packer(size, most, slack), [], (turn << 56) | (TaskContext.get().partitionId() << 32)
    for piece in documents:
        out += packer.place(*piece)
        if len(out) >= _EMIT:
            yield _batch(out, n, False)
            n, out = n + len(out), []
    rest = packer.rest()
    for windows, opened in ((out + filled(rest, size), False),) if last else ((out, False), (rest, True)):
        if windows:
            yield _batch(windows, n, opened)
            n += len(windows)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 1, size: int = SIZE, most: int = OPEN, slack: int = SLACK, together: int = TOGETHER) -> DataFrame:
    """sequence_id, ids (binary), pieces (doc_id, start, length, offset, doc_tokens) of sequences of at most `size`
    tokens; each document ends with the id `end`."""
    tokenizer = tokenizer or default_tokenizer()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        coder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer, special=True))
        last = np.array([end], "<u4")
        for batch in batches:
            for part in parts_of(batch, 1):
                for i, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1)), strict=True):
                    yield i, 0, np.concatenate([ids, last]), len(ids) + 1

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in batches:
            for raw, held in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                for p in held.as_py():
                    yield p["doc_id"], p["start"], ids[p["offset"] : p["offset"] + p["length"]], p["doc_tokens"]

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    packed = cut(rows.mapInArrow(lambda batches: _packed(documents(batches), 0, False, size, most, slack), SEQUENCE), "packed")
    done, turn = packed.filter("not open"), 0
    while left := (opened := packed.filter("open")).count():
        turn += 1
        tasks = -(-left // max(together, 2 * most))
        step = lambda batches, turn=turn, last=tasks == 1: _packed(pieces(batches), turn, last, size, most, slack)
        packed = cut(opened.select("ids", "pieces").repartition(tasks).mapInArrow(step, SEQUENCE), "packed")
        done = done.union(packed.filter("not open"))
    return done.drop("open")


def digests(sequences: DataFrame) -> DataFrame:
    """A row for each piece, its ids as their crc32."""
    each = F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].cast("long").alias("length"), F.crc32(F.col("ids").substr(4 * p["offset"] + 1, 4 * p["length"])).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), p["offset"].cast("long").alias("offset")))
    return sequences.select("sequence_id", F.explode(each).alias("p")).select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
