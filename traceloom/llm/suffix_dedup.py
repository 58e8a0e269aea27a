"""Removal of byte strings that occur more than once, by suffix sorting.

Each byte that a string of `window` bytes covers which starts anywhere else, too, is removed; strings are judged on the
input, not on what is left. Equal texts are taken once, with their number. Then:

1. The windows of a text are cut into stretches that share the least hash of their 64-byte grams. Equal windows share
   it wherever they stand, so all that may be equal meets under one key, without any pair being formed.
2. Keys of one stretch alone are done. Of the others each distinct stretch is fetched from its text once.
3. A task takes whole keys of about `BATCH` bytes and sorts their suffixes by Lyndon-prefix groups (`suffixes`); what
   sorted neighbours share, byte by byte, tells which windows occur elsewhere.
4. A key with over `CROWD` distinct stretches is first cut up by longer grams, at last into windows. Pieces are kept
   as places in their stretch; only of those that may repeat the bytes are fetched, of each distinct one once.
5. The runs found go back to all places of their stretch, and each text is put together from what remains.

Texts are shuffled once, by their digest, and kept in the shared folder as a table in buckets of it.

Defined results: null text is empty, and an empty text has nothing removed; texts shorter than the window stay whole;
repeated rows count as places of their own; a text of any length is one value in a task, with about thirty bytes for each
of its own while it is cut; columns of any other name pass untouched in `row`.

Texts, and stretches under one key, are known by 128-bit hashes; all else is decided by the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, cut, table
from .suffixes import mix, regions, repeated

WINDOW = 400
GRAMS = (64, 256, 384)  # by level; the next is the window itself
BATCH = 1_000_000
CROWD = 1_024
STRETCH = "key long, stretch long"


def distinct_texts(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(docs as the struct `row`, with digest), (digest, data, copies)."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    digest = F.unhex(F.md5(data))
    rows = docs.select(F.struct(*(c for c in docs.columns if c != text)).alias("row"), digest.alias("digest"))
    whole = docs.select(digest.alias("digest"), data.alias("data")).groupBy("digest").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    return rows, bucketed(whole, "digest", "texts")


def places(texts: DataFrame, window: int) -> DataFrame:
    """key, stretch, digest, first, starts, copies, again (1 if the stretch may repeat itself): all stretches of all texts."""

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for d, data, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, stretch, first, starts, again = regions(np.frombuffer(data, dtype=np.uint8), window, min(GRAMS[0], window))
                for k, x in enumerate((key.view(np.int64), stretch.view(np.int64), [d] * len(key), first, starts, np.full(len(key), n), again)):
                    out[k].append(x)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for k, x in enumerate(out) if k != 2]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1]), pa.array([d for x in out[2] for d in x], pa.binary()), *(pa.array(x.astype(np.int64)) for x in flat[2:])], ["key", "stretch", "digest", "first", "starts", "copies", "again"])

    return texts.select("digest", "data", "copies").filter(F.length("data") >= window).mapInArrow(cut_batches, f"{STRETCH}, digest binary, first long, starts long, copies long, again long")


def contents(found: DataFrame, source: DataFrame, ids: list[str], window: int) -> DataFrame:
    """key, stretch, times, data: the distinct stretches of each key that has two places or more, in one stretch or not.
    found: where they stand; source: ids, data."""
    keys = found.groupBy("key").agg(F.sum("copies").alias("n"), F.max("again").alias("again")).filter("n > 1 or again > 0").select("key")
    each = found.join(keys, "key", "left_semi").groupBy("key", "stretch").agg(F.sum("copies").alias("times"), F.min(F.struct(*ids, "first", "starts")).alias("at"))
    wanted = each.groupBy(*(F.col(f"at.{c}").alias(c) for c in ids)).agg(F.collect_list(F.struct("key", "stretch", "times", "at.first", "at.starts")).alias("wanted"))  # within one text

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for data, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                whole = data.as_buffer()
                for w in wanted:
                    part = whole.slice(w["first"], w["starts"] + window - 1).to_pybytes()
                    rows.append((w["key"], w["stretch"], w["times"], part))
                    size += len(part)
                    if size > 16 * BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
            yield _batch(rows)

    return source.select(*ids, "data").join(wanted, ids).select("data", "wanted").mapInArrow(fetch, f"{STRETCH}, times long, data binary")


def _batch(rows: list) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "stretch": pa.int64(), "times": pa.int64(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def sort_and_compare(held: DataFrame, window: int) -> DataFrame:
    """key, stretch, runs: runs (first, end) of window starts that occur elsewhere under the key."""

    def compare(rows: list) -> pa.RecordBatch:
        runs = repeated([r[3] for r in rows], [r[2] for r in rows], window)
        out = [(r[0], r[1], [{"first": a, "end": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)]) for r, (x, y) in zip(rows, runs, strict=True) if len(x)]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["key", "stretch", "runs"])

    def compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and r[0] != last:
                    yield compare(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
                last = r[0]
        if rows:
            yield compare(rows)

    dealt = held.select("key", "stretch", "times", "data").repartition("key").sortWithinPartitions("key", "stretch")
    return dealt.mapInArrow(compare_batches, f"{STRETCH}, runs array<struct<first: long, end: long>>")


def marks(held: DataFrame, window: int, level: int = 0, crowd: int = CROWD) -> DataFrame:
    """As sort_and_compare; crowded keys are cut up by longer grams first, at last into windows, whose equality 128 bits
    of hashes tell."""
    crowded = cut(held.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowded")
    if crowded.isEmpty():
        return sort_and_compare(held, window)
    plain = sort_and_compare(held.join(crowded, "key", "left_anti"), window)
    gram = min([*GRAMS, window][level + 1], window)
    parents = {"of_key": "key", "of_stretch": "stretch"}

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "stretch", "of_key", "of_stretch", "first", "starts", "copies", "again"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for key, stretch, times, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, whole, first, starts, again = regions(np.frombuffer(data, dtype=np.uint8), window, gram)
                if gram == window:  # the windows of a stretch are one string, again and again
                    whole = np.array([int.from_bytes(hashlib.md5(data[f : f + window]).digest()[:8]) for f in first.tolist()], dtype=np.uint64)
                low = mix(low ^ np.uint64(key % 2**64))
                n = len(low)
                for x, y in zip(out, (low.view(np.int64), whole.view(np.int64), np.full(n, key), np.full(n, stretch), first, starts, np.full(n, times), again.astype(np.int64)), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names)

    pieces = held.join(crowded, "key", "left_semi").select("key", "stretch", "times", "data").mapInArrow(cut_batches, ", ".join(f"{c} long" for c in ("key", "stretch", *parents, "first", "starts", "copies", "again")))
    pieces = cut(pieces, "pieces")
    if gram == window:
        same = pieces.groupBy("key", "stretch").agg(F.sum(F.col("copies") * F.col("starts")).alias("n")).filter("n > 1").select("key", "stretch")
        back = pieces.join(same, ["key", "stretch"]).withColumn("runs", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("starts").alias("end"))))
    else:
        source = held.select(*(F.col(c).alias(k) for k, c in parents.items()), "data")
        below = marks(cut(contents(pieces, source, list(parents), window), "finer"), window, level + 1, crowd)
        back = below.join(pieces, ["key", "stretch"])
    back = back.select(*(F.col(k).alias(c) for k, c in parents.items()), F.transform("runs", lambda r: F.struct((r["first"] + F.col("first")).alias("first"), (r["end"] + F.col("first")).alias("end"))).alias("runs"))
    return plain.union(back)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed_spans(texts: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """digest, runs: byte runs (first, end) to remove, of texts with any; not merged."""
    found = cut(places(texts, window), "places")
    held = cut(contents(found, texts, ["digest"], window), "stretches")
    hit = marks(held, window, crowd=crowd)
    at = hit.join(found.select("key", "stretch", "digest", F.col("first").alias("f0")), ["key", "stretch"])
    at = at.select("digest", F.transform("runs", lambda r: F.struct((r["first"] + F.col("f0")).alias("first"), (r["end"] + F.col("f0") + (window - 1)).alias("end"))).alias("runs"))
    return at.groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # within one text


def dedup(docs: DataFrame, text: str, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """docs without the text as the struct `row`, with kept (binary), n_bytes, n_removed, n_spans, kept_sha256."""
    rows, texts = distinct_texts(docs, text)
    runs = removed_spans(texts, window, crowd)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, data, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = merged([(r["first"], r["end"]) for r in found or []])
                parts, at = [], 0
                for a, b in spans:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                out.append((d, kept, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            kinds = {"digest": pa.binary(), "kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], list(kinds))

    done = texts.select("digest", "data").join(runs, "digest", "left").select("digest", "data", "runs")
    done = done.mapInArrow(rest, "digest binary, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows.join(done, "digest").drop("digest")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, "text").select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
