"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A text's words, with one space
around each, are scanned once; a window of an item is a pattern of the automaton, with the ids of all items that hold
it. Matches are mapped to word numbers and, by `spans`, to character offsets of the original text.

Windows are dealt by hash into shards of about `SHARD_BYTES` of patterns, each a file in the shared folder; a small
benchmark has one. A task takes its texts in portions of `PORTION` bytes and holds a portion against one shard's
automaton after another, so it has one automaton in memory, however large the benchmark is.

Defined results: null or empty text has no words and no hit; items without words match nothing; repeated items share
their windows and each count; an item of fewer than `window` words is one window; the windows of an item with a null id
are hit like others, but add no id; repeated documents get a row each; texts of any length are scanned whole; other
columns are kept or ignored, whatever their names; empty tables give no row, or no hit.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table
from .token_ids import _store

WINDOW = 10
SHARD_BYTES = 8_000_000
PORTION = 32_000_000
#: Bytes of words stay, A-Z become a-z, all other ASCII becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(items: DataFrame, item_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """window (normalised words, one space around each), ids (sorted item ids as text); one row a window."""

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, ids = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(t)
                for k in range(max(len(w) - size, 0) + 1 if w else 0):
                    grams.append(b" " + b" ".join(w[k : k + size]) + b" ")
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array(ids, pa.string())], ["window", "id"])

    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut_items, "window binary, id string").groupBy("window").agg(F.sort_array(F.collect_set("id")).alias("ids"))  # nulls aside


def shards(spark: SparkSession, found: DataFrame, most: int = SHARD_BYTES) -> list[str]:
    """Folders of the windows' shards, of about `most` bytes each."""
    total = found.agg(F.sum(F.length("window") + 16 * F.size("ids"))).first()[0] or 0
    n, folder = -(-total // most), scratch_path(spark, "windows")
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(max(n, 1))))
    dealt.repartition(max(n, 1), "shard").write.partitionBy("shard").parquet(folder)
    return [f"{folder}/shard={k}" for k in range(n)]


def patterns(folder: str) -> Iterator[tuple[bytes, list[str]]]:
    store, path = _store(folder)
    try:
        held = pq.read_table(path, filesystem=store, columns=["window", "ids"], partitioning=None)
    except FileNotFoundError:  # no window fell to the shard
        return
    yield from zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True)


def scanner(patterns):
    """A function from a text's words, with one space around each, to (first word, last word, ids) of each occurrence."""
    import ahocorasick

    tree = ahocorasick.Automaton()
    for gram, ids in patterns:
        tree.add_word(gram.decode("latin-1"), (gram.count(b" ") - 1, ids))
    if len(tree):
        tree.make_automaton()

    def scan(text: bytes) -> list[tuple[int, int, list[str]]]:
        found = list(tree.iter(text.decode("latin-1"))) if len(tree) and text else []
        if not found:
            return []
        ends, at = [], 0
        for w in text.split():
            at += len(w) + 1
            ends.append(at)  # of the space behind the word
        return [(last - n + 1, last, ids) for end, (n, ids) in found if (last := bisect.bisect_left(ends, end)) >= 0]

    return scan


_last: dict[str, object] = {}  # the scanner that a worker process used last


def _scanner(folder: str):
    if folder not in _last:
        _last.clear()
        _last[folder] = scanner(patterns(folder))
    return _last[folder]


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in lists of about PORTION bytes of texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size > PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan_documents(docs: DataFrame, text: str, found: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs as the struct `row`, with n_words, starts and ends (arrays of first and last words of merged hit runs) and
    items (array of item ids)."""
    folders = shards(docs.sparkSession, found)
    ints = pa.list_(pa.int32())

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in portions(batches, 1):
            words = [b" " + b" ".join(w) + b" " if (w := words_of(t.as_py())) else b"" for batch in held for t in batch.column(1)]
            hits: dict[int, list] = {}
            for folder in folders:
                scan = _scanner(folder)
                for k, w in enumerate(words):
                    if seen := scan(w):
                        hits.setdefault(k, []).extend(seen)
            at = 0
            for batch in held:
                n_words, starts, ends, items = [], [], [], []
                for k in range(at, at + batch.num_rows):
                    runs = merged([(x, y) for x, y, _ in hits.get(k, ())])
                    n_words.append(max(words[k].count(b" ") - 1, 0))
                    starts.append([x for x, _ in runs])
                    ends.append([y for _, y in runs])
                    items.append(sorted({i for _, _, ids in hits.get(k, ()) for i in ids}))
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(starts, ints), pa.array(ends, ints), pa.array(items, pa.list_(pa.string()))], ["row", "n_words", "starts", "ends", "items"])

    df = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    none = F.lit(None)
    schema = df.select("row", none.cast("long").alias("n_words"), *(none.cast("array<int>").alias(c) for c in ("starts", "ends")), none.cast("array<string>").alias("items")).schema
    return df.mapInArrow(scan_batches, schema)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs of words; those that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(text: str | None, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    at = [m.span() for m in WORDS.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))]
    return [(at[a][0], at[b][1]) for a, b in runs]


def contamination(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row for each of docs."""
    seen = scan_documents(docs.select(doc_id, text), text, windows(items, item_id, item_text, size), size)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return seen.select(
        F.col("row")[doc_id].alias(doc_id), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of docs without any window of an item, with the columns of docs."""
    return scan_documents(docs, text, windows(items, item_id, item_text, size), size).filter(F.size("starts") == 0).select("row.*")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")

