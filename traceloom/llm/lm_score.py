"""Language-model scores from a log-frequency Bloom filter.

The filter holds n-grams with quantised counts: an n-gram of level q is entered q times, as (n-gram, 1) ... (n-gram, q),
and its level is read back by probing (n-gram, 1), (n-gram, 2) ... until a probe fails; a level is a count to within a
quarter of a doubling. Every unigram and bigram of the training part is in it, however rare and however large the
corpus.

So the filter grows with the corpus, and no worker could hold it whole. It is split by the n-gram's hash into shards of
about `SHARD` training tokens each, and the probes travel: texts are read once and become chunks of word codes; each
chunk asks each shard for its distinct n-grams; a shard is built from the counts that come with the questions, probed,
and its levels, a byte each, go back to the chunk, which scores its texts.

    P(w) = (c(w) + 1) / (N + V + 1)
    P(w | h) = weight * c(h w) / c(h) + (1 - weight) * P(w), and P(w) where h was never seen

The base score takes exact counts, which a shard returns for words beside their levels. Words are known by their 64-bit
XXH64.

Defined results: null text is empty, has the end token alone, and is scored; a null id is in the training part; repeated
rows each count and are each scored; an empty training part gives N = V = 0 and a base score of 0; a text of any length
is in one chunk, which it may exceed; columns of any other name pass untouched in `row`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_crc, table

BASE = 2.0**0.25  # of the levels
BITS_EACH = 10  # of the filter, for each entry
PROBES = 5
WEIGHT = 0.3
CHUNK = 2_000_000  # tokens at a time
SHARD = 1_000_000  # tokens a shard
END = np.uint64(xxhash.xxh64_intdigest(b""))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _A + np.uint64(1)) ^ (w * _C + _B)


def level(count: np.ndarray) -> np.ndarray:
    """The level of counts of one or more."""
    return (1 + np.floor(np.log(count) / np.log(BASE) + 1e-9)).astype(np.int64)


def expected(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for level 0."""
    return np.where(level > 0, BASE ** (level - 0.5), 0.0)


@dataclass
class Filter:
    bits: np.ndarray  # uint8

    @classmethod
    def build(cls, grams: np.ndarray, counts: np.ndarray, bits_each: int = BITS_EACH) -> Filter:
        levels = level(counts)
        f = cls(np.zeros(max(1024, int(levels.sum()) * bits_each // 8 + 1), dtype=np.uint8))
        for j in range(1, int(levels.max(initial=0)) + 1):
            for at in f.places(grams[levels >= j], j):
                np.bitwise_or.at(f.bits, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        return f

    def places(self, grams: np.ndarray, j: int) -> Iterator[np.ndarray]:
        m = np.uint64(8 * len(self.bits))
        x = mix(grams + np.uint64(j * int(_A) % 2**64))
        step = mix(x) | np.uint64(1)
        for _ in range(PROBES):
            yield x % m
            x = x + step

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """By repeated probes; 0 for n-grams that aren't in."""
        found = np.zeros(len(grams), dtype=np.int64)
        live, j = np.arange(len(grams)), 0
        while len(live):
            j += 1
            ok = np.ones(len(live), bool)
            for at in self.places(grams[live], j):
                ok &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[ok]
            found[live] = j
        return found


def squeezed(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zstd.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), 1)


def unsqueezed(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstd.decompress(data), dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens of all texts, each text with its end; tokens per text; the words' hashes by code. Frequent
    words have small codes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")).cast(pa.large_string()))  # lowered before the cast: pyarrow 23 reads casts of slices wrongly
    ends, found = lists.offsets.to_numpy().astype(np.int64), lists.values.dictionary_encode()
    one = pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary.cast(pa.string()))
    words = pc.binary_join(one, " ")[0].as_py().encode().split(b" ") if len(found.dictionary) else []
    code = found.indices.to_numpy().astype(np.int64)
    word = np.array([len(w) > 0 for w in words], dtype=bool)[code]  # blanks at a text's ends leave empty ones
    before = np.concatenate([[0], np.cumsum(word)])[ends]
    count = np.diff(before) + 1
    out = np.full(int(count.sum()), len(words), dtype=np.int64)
    out[np.arange(int(word.sum())) + np.repeat(np.arange(len(count)), count - 1)] = code[word]
    times = np.bincount(out, minlength=len(words) + 1)
    order = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
    rank = np.zeros(len(times), dtype=np.int32)
    rank[order] = np.arange(len(order))
    hashes = np.array([*map(xxhash.xxh64_intdigest, words), int(END)], dtype=np.uint64)
    return rank[out], count, hashes[order]


def encoded(docs: DataFrame, text: str, train: Column) -> DataFrame:
    """Chunks of docs: chunk, rows (their structs without the text), n (tokens of each), train (of each), codes, words,
    tokens, trained (tokens to learn from)."""
    df = docs.select(F.struct(*(c for c in docs.columns if c != text)).alias("row"), F.col(text).alias("text"), train.alias("train"))

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64) // 6 + 1
            starts = np.unique((np.cumsum(size) - size) // CHUNK, return_index=True)[1].tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=False):
                piece = batch.slice(a, b - a)
                codes, count, words = coded(piece.column(1))
                on = piece.column(2).to_numpy(zero_copy_only=False).astype(bool)
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), whole(pa.concat_arrays([piece.column(0)])), whole(pa.array(count, pa.int64())), whole(pa.array(on, pa.bool_())), pa.array([squeezed(codes)], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([int(count.sum())], pa.int64()), pa.array([int(count[on].sum())], pa.int64())],
                    ["chunk", "rows", "n", "train", "codes", "words", "tokens", "trained"],
                )
                chunk += 1

    kinds = {"n": "array<long>", "train": "array<boolean>", "codes": "binary", "words": "binary", "tokens": "long", "trained": "long"}
    schema = df.select(F.lit(0).cast("long").alias("chunk"), F.array("row").alias("rows"), *(F.lit(None).cast(t).alias(k) for k, t in kinds.items())).schema
    return df.mapInArrow(encode_batches, schema)


@dataclass
class Chunk:
    """N-grams of a chunk: words, then bigrams; `order` deals them to shards, words first in each."""

    codes: np.ndarray
    count: np.ndarray
    before: np.ndarray  # code of the token before each one; before the first stands the end
    bigram: np.ndarray  # of each token
    hashes: np.ndarray
    words: int
    order: np.ndarray
    shard: np.ndarray

    @classmethod
    def read(cls, codes: bytes, words: bytes, count: np.ndarray, shards: int) -> Chunk:
        code, h = unsqueezed(codes, "<i4").astype(np.int64), np.frombuffer(words, dtype=np.uint64)
        before = np.roll(code, 1)
        before[np.cumsum(count) - count] = np.flatnonzero(h == END)[0]
        pairs, bigram = np.unique(before * len(h) + code, return_inverse=True)
        hashes = np.concatenate([h, pair(h[pairs // len(h)], h[pairs % len(h)])])
        shard = ((hashes >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        return cls(code, count, before, bigram, hashes, len(h), np.argsort(shard, kind="stable"), shard)


def questions(chunks: DataFrame, shards: int) -> DataFrame:
    """shard, chunk, words (how many of the hashes are words), hashes, counts: what each chunk asks each shard, and how
    often it has it in its training part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, codes, words = (batch.column(c)[k].as_py() for c in (0, 1, 2))
                count, on = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                x = Chunk.read(codes, words, count, shards)
                learn = np.repeat(on.astype(bool), count)
                times = np.concatenate([np.bincount(x.codes[learn], minlength=x.words), np.bincount(x.bigram[learn], minlength=len(x.hashes) - x.words)]).astype("<i4")
                ends = np.cumsum(np.bincount(x.shard, minlength=shards))
                own = np.bincount(x.shard[: x.words], minlength=shards)
                some = np.flatnonzero(np.diff(ends, prepend=0)).tolist()
                parts = [x.order[(ends[s - 1] if s else 0) : ends[s]] for s in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array(own[some], pa.int64()), pa.array([x.hashes[p].tobytes() for p in parts], pa.binary()), pa.array([times[p].tobytes() for p in parts], pa.binary())],
                    ["shard", "chunk", "words", "hashes", "counts"],
                )

    return chunks.select("chunk", "codes", "words", "n", "train").mapInArrow(ask, "shard long, chunk long, words long, hashes binary, counts binary")


def answers(asked: DataFrame, shards: int, bits_each: int = BITS_EACH) -> DataFrame:
    """chunk, shard, levels (a byte for each hash asked), counts (exact, of words); and, with a null chunk, the number of
    words that a shard has learned, as types."""

    def answer(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        chunk, shard, words = (group.column(c).to_pylist() for c in ("chunk", "shard", "words"))
        hashes, counts = ([np.frombuffer(x.as_buffer(), dtype=t) for x in group.column(c)] for c, t in (("hashes", np.uint64), ("counts", "<i4")))
        one, of = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate(counts), minlength=len(one)).astype(np.int64)
        learned = total > 0
        levels = Filter.build(one[learned], total[learned], bits_each).levels(one).astype(np.uint8)
        stop = np.cumsum([len(h) for h in hashes])
        parts = [of[b - len(h) : b] for b, h in zip(stop.tolist(), hashes, strict=True)]
        exact = [total[p[:n]] for p, n in zip(parts, words, strict=True)]
        known = np.unique(np.concatenate([p[:n] for p, n in zip(parts, words, strict=True)]))
        return pa.table({
            "chunk": pa.array([*chunk, None], pa.int64()), "shard": pa.array([*shard, shard[0]], pa.int64()),
            "levels": pa.array([*(levels[p].tobytes() for p in parts), b""], pa.binary()), "counts": pa.array([*(squeezed(x) if len(x) else b"" for x in exact), b""], pa.binary()),
            "types": pa.array([0] * len(chunk) + [int(learned[known].sum())], pa.int64()),
        })

    return asked.repartition(1 + shards // 4, "shard").groupBy("shard").applyInArrow(answer, "chunk long, shard long, levels binary, counts binary, types long")


def log_probabilities(count: np.ndarray, before: np.ndarray, joint: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """log10 P of tokens: counts of each, of the one before it, of both together."""
    p = (count + 1) / (tokens + types + 1)
    return np.log10(np.where(before > 0, WEIGHT * np.minimum(joint / np.maximum(before, 1e-9), 1.0) + (1 - WEIGHT) * p, p))


def score(docs: DataFrame, text: str, train: Column, bits_each: int = BITS_EACH) -> DataFrame:
    """docs without the text as the struct `row`, with n_tokens, n_known, train_tokens, base_score, score by the model of
    those rows for which train holds."""
    chunks = cut(encoded(docs, text, train), "chunks")
    tokens, trained = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    shards = 1 + tokens // SHARD
    found = cut(answers(questions(chunks, shards), shards, bits_each), "levels")
    types = found.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    back = found.filter("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("shard", "levels", "counts")).alias("found"))  # of one chunk
    joined = chunks.select("chunk", "rows", "codes", "words", "n").join(back, "chunk").select("rows", "codes", "words", "n", "found")
    log_all = float(np.log10(trained + types + 1))

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = Chunk.read(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].values.to_numpy(zero_copy_only=False), shards)
                got = sorted(batch.column(4)[k].as_py(), key=lambda r: r["shard"])
                levels, exact = np.zeros(len(x.hashes), np.int64), np.zeros(x.words, np.int64)
                levels[x.order] = np.frombuffer(b"".join(r["levels"] for r in got), dtype=np.uint8)
                exact[x.order[x.order < x.words]] = np.concatenate([unsqueezed(r["counts"], "<i8") for r in got if r["counts"]])
                c = expected(levels)
                n, text_of = len(x.count), np.repeat(np.arange(len(x.count)), x.count)
                sums = lambda v: np.bincount(text_of, v, n)
                own = exact[x.codes]
                logs = log_probabilities(c[x.codes], c[x.before], c[x.words + x.bigram], trained, types)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, pa.array(x.count, pa.int64()), pa.array(sums(own > 0).astype(np.int64)), pa.array([trained] * n, pa.int64()), pa.array(sums(np.log10(own + 1.0)) - x.count * log_all, pa.float64()), pa.array(sums(logs), pa.float64())],
                    ["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kinds = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    schema = joined.select(F.get("rows", F.lit(0)).alias("row"), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())).schema
    return joined.mapInArrow(score_batches, schema)


def isin(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(7)) == 2
    out = score(docs, "text", ~held_out).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
