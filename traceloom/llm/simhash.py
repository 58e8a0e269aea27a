"""Near duplicates by SimHash with deletion-variant signatures.

A fingerprint has 64 bits; two link at `BITS` (3) or fewer differing bits. Cut into two segments of 32 bits, one of
them differs by one bit at most. Each segment is indexed under its 32 variants with one bit left out (a wildcard), so
that two segments within one bit share a key; an equality join brings them together and the whole fingerprints are
compared. Nothing is enumerated but 64 keys for each distinct fingerprint.

Copies meet as one fingerprint before any join. Fingerprints under one key are linked to each other by a search that
gives a spanning tree of them, never all pairs; under a key with over `CROWD` of them, the search is first narrowed by
the same variants of the other segment's halves.

Defined results: null and empty text have fingerprint 0 and link like any other; texts of fewer words than a shingle
are one shingle; a null id never names a component unless all its ids are null; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_by_weight, table
from .components import components, contract

SHINGLE = 3
BITS = 3
CROWD = 4_096
_CHUNK = 200_000  # shingles at a time


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII blanks
    if len(w) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else []
    return [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(w[k:] for k in range(size)), strict=False)]


def majority(hashes: list[int], counts: list[int]) -> np.ndarray:
    """A fingerprint for each run of `counts` hashes: the bits set in over half of them."""
    n = np.array(counts, dtype=np.int64)
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_all(texts, size: int = SHINGLE) -> np.ndarray:
    out, hashes, counts = [], [], []
    for t in texts:
        h = shingle_hashes(t, size)
        hashes += h
        counts.append(len(h))
        if len(hashes) >= _CHUNK:
            out.append(majority(hashes, counts))
            hashes, counts = [], []
    return np.concatenate([*out, majority(hashes, counts)]).view(np.int64)


def fingerprints(docs: DataFrame, text: str, size: int = SHINGLE) -> DataFrame:
    """docs as the struct `row`, with fp (long)."""
    df = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprint_all((t.as_py() for t in batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["row", "fp"])

    return df.mapInArrow(batches_of, df.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def tree(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of fps within `bits` of each other: a search outward from one after another."""
    left = fps
    a, b = [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            x, front = front[0], front[1:]
            hit = near(left, x, bits)
            if hit.any():
                a.append(np.full(int(hit.sum()), x))
                b.append(left[hit])
                front = np.concatenate([front, left[hit]])
                left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def crowd_tree(fps: np.ndarray, segment: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As tree(), for many fingerprints that agree in a segment: one half of the other differs by one bit at most."""
    a, b = [], []
    other = (fps >> np.uint64(32 * (1 - segment))) & np.uint64(0xFFFFFFFF)
    for half in (0, 16):
        part = (other >> np.uint64(half)) & np.uint64(0xFFFF)
        for q in range(16):
            key = part & np.uint64(0xFFFF ^ (1 << q))
            order = np.argsort(key, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                x, y = tree(fps[run], bits)
                a.append(x)
                b.append(y)
        a, b = ([x] for x in contract(np.concatenate(a), np.concatenate(b)))
    return a[0], b[0]


def link_runs(key: np.ndarray, fps: np.ndarray, bits: int, crowd: int = CROWD) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints with equal keys; keys come sorted."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(start, len(key)))
    a, b = [fps[:0]], [fps[:0]]
    two = start[length == 2]
    on = two[near(fps[two], fps[two + 1], bits)]
    a.append(fps[on])
    b.append(fps[on + 1])
    for s, n in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
        run = fps[s : s + n]
        x, y = tree(run, bits) if n <= crowd else crowd_tree(run, int(key[s]) >> 37, bits)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """distinct: fp. Returns a, b: links that connect all fingerprints within `bits` (3 at most) of each other."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    k, one = F.col("k"), F.lit(1).cast("long")
    value = F.expr("shiftrightunsigned(fp, cast(32 * (k div 32) as int))").bitwiseAND(F.lit(0xFFFFFFFF))
    rest = value.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, cast(k % 32 as int))")))
    keys = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select((k.cast("long") * (2**32) * one + rest).alias("key"), "fp")

    def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        a, b = [], []

        def take(n: int) -> None:
            x, y = link_runs(key[:n], fps[:n], bits)
            a.append(x)
            b.append(y)

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(key) and (n := int(np.searchsorted(key, key[-1]))):  # the last key may go on
                take(n)
                key, fps = key[n:], fps[n:]
            if sum(map(len, a)) > 1_000_000:
                a, b = ([x] for x in contract(np.concatenate(a), np.concatenate(b)))
        if len(key):
            take(len(key))
        if a:
            x, y = contract(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(link_batches, "a long, b long")


def classes(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """prints: id, fp. Returns fp, copies (rows with it), component_id (the smallest id reachable); one row for each
    distinct fp."""
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "distinct")
    found = components(links(distinct.select("fp"), bits))
    linked = found.select(F.col("node").alias("fp"), "root").union(found.select(F.col("root").alias("fp"), "root").distinct())
    linked = linked.join(distinct, "fp")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    out = distinct.join(linked.join(lowest, "root").select("fp", "lowest"), "fp", "left")
    return cut(out.select("fp", "copies", F.coalesce("lowest", "least").alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id; a row for each of docs."""
    prints = cut(fingerprints(docs.select(doc_id, text), text, size).select(F.col(f"row.{doc_id}").alias("id"), "fp"), "prints")
    out = join_by_weight(prints, classes(prints, bits), "fp", "copies")
    return out.select(F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Of each component the row with the smallest id (of repeated rows any one), with the columns of docs."""
    prints = cut(fingerprints(docs.select(doc_id, text), text, size).select(F.col(f"row.{doc_id}").alias("id"), "fp"), "prints")
    member = join_by_weight(prints, classes(prints, bits), "fp", "copies").filter(F.col("id").eqNullSafe(F.col("component_id")))
    # equal ids under one component, or only null ones: the smallest fingerprint stays
    winner = member.groupBy(F.col("component_id").alias("winner")).agg(F.min("fp").alias("winner_fp"))
    nulls = member.filter("component_id is null").select("fp")
    rows = fingerprints(docs, text, size).withColumn("id", F.col(f"row.{doc_id}"))
    named = rows.join(winner.filter("winner is not null"), (F.col("id") == F.col("winner")) & (F.col("fp") == F.col("winner_fp")))
    bare = rows.filter("id is null").join(nulls.distinct(), "fp", "left_semi").withColumns({"winner": F.lit(None).cast(docs.schema[doc_id].dataType), "winner_fp": F.col("fp")})
    first = Window.partitionBy("winner", "winner_fp").orderBy(F.lit(0))
    kept = [x.withColumn("n", F.row_number().over(first)).filter("n = 1").select("row.*") for x in (named, bare.select(named.columns))]
    return kept[0].union(kept[1])


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
