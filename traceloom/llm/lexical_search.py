"""Ranked lexical search, reversed: the items' terms are the index, and documents stream through it.

The items are taken in blocks of `ITEM_BYTES`; a block's terms are broadcast. One pass over the texts keeps the counts
of a document's terms that an item has (`term_counts`, a table in the shared folder, much smaller than the texts); from
it come the numbers of documents and terms. A second pass runs these counts through the block's inverted index and
updates a bounded heap for each item in each task; the heaps are merged in two steps.

Defined results: null text and text without a term match nothing and are not counted; of items, exact repeats of (id,
text) count once, and different texts under one id are ranked apart; repeated documents are documents of their own;
equal scores are ordered by id, null ids last; an item without a matching document has no row; empty tables give none.
Texts of any length are taken whole; columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, table
from .heaps import Heaps, merged
from .token_ids import parts_of

#: Bytes of items' texts in a block, whose index is broadcast.
ITEM_BYTES = 1 << 20
#: Scores held at a time, and postings followed at a time.
CELLS = 1 << 21

#: By byte: what is no letter, digit or byte of a longer character parts terms; only A-Z are folded.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(texts: pa.Array) -> Iterator[list[bytes]]:
    """The terms of each text (string or large_string); null has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    stops = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    raw = texts.buffers()[2]
    folded = raw.slice(stops[0], stops[-1] - stops[0]).to_pybytes().translate(_FOLD) if raw else b""
    for a, b in zip(stops, stops[1:], strict=False):
        yield folded[a - stops[0] : b - stops[0]].split()


def blocks(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list]:
    """Items as (id, term counts) in lists of about `most` bytes of text; the driver holds one at a time."""
    held, size = [], 0
    for i, t in items.select(item_id, text).distinct().toLocalIterator():
        held.append((i, Counter(next(terms_of(pa.array([t], pa.string()))))))
        size += 4 * len(t or "")
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def term_counts(docs: DataFrame, doc_id: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """id, n, terms, tf of each document with a term: n counts all its terms, terms and tf those that have a number."""
    known = docs.sparkSession.sparkContext.broadcast(number)
    ints = pa.list_(pa.int32())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            for part in parts_of(batch, 1):
                n, terms, tfs = [], [], []
                for found in terms_of(part.column(1)):
                    c = Counter(found)
                    held = c.keys() & number.keys()
                    n.append(len(found))
                    terms.append([number[t] for t in held])
                    tfs.append([c[t] for t in held])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(terms, ints), pa.array(tfs, ints)], ["id", "n", "terms", "tf"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(count, "id long, n long, terms array<int>, tf array<int>").filter("n > 0")


class Index:
    """Items by term: of term t, items item[start[t]:start[t + 1]] with the term's weight times its repeats there."""

    def __init__(self, items: list, number: dict[bytes, int], weight: list[int]):
        rows = sorted((number[t], k, weight[number[t]] * q) for k, (_, c) in enumerate(items) for t, q in c.items())
        self.start = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(len(number) + 1))
        self.item = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.int64)
        self.items = len(items)

    def scores(self, m: np.ndarray, first: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Documents by items; document d has length measure m[d] and the terms and tf from first[d] to first[d + 1]."""
        doc = np.repeat(np.arange(len(m)), np.diff(first))
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        n = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = np.zeros(len(m) * self.items, np.int64)
        np.add.at(out, np.repeat(doc * self.items, n) + self.item[at], np.repeat(part, n) * self.weight[at])
        return out.reshape(len(m), self.items)


def _ranked(counts: DataFrame, index: Index, ids: pa.Array, kind: str, base: int, k: int, total: tuple[int, int]) -> DataFrame:
    """Each task's heaps: item (its number), item_id, id, score."""
    held = counts.sparkSession.sparkContext.broadcast((index, ids))
    n_docs, n_terms = total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = held.value
        heaps = Heaps(index.items, k)
        for batch in batches:
            doc, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            lists = batch.column(2)
            first = lists.offsets.to_numpy().astype(np.int64)
            terms, tf = (batch.column(c).values.to_numpy().astype(np.int64) for c in (2, 3))
            follow = np.concatenate([[0], np.cumsum(index.start[terms + 1] - index.start[terms])])[first]
            a = 0
            while a < len(m):
                b = max(a + 1, min(a + CELLS // index.items, int(np.searchsorted(follow, follow[a] + CELLS, side="right")) - 1))
                s = index.scores(m[a:b], first[a : b + 1] - first[a], terms[first[a] : first[b]], tf[first[a] : first[b]])
                least = np.maximum(heaps.floor, 1)
                if b - a > k:
                    least = np.maximum(least, np.partition(s, b - a - k, axis=0)[b - a - k])
                d, i = np.nonzero(s >= least)
                heaps.add(i, s[d, i], doc[a + d], null[a + d])
                a = b
        out = [pa.array(base + heaps.group), ids.take(pa.array(heaps.group)), pa.array(heaps.id, mask=heaps.null), pa.array(heaps.score)]
        yield pa.RecordBatch.from_arrays(out, ["item", "item_id", "id", "score"])

    return counts.mapInArrow(run, f"item long, item_id {kind}, id long, score long")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10, block: int = ITEM_BYTES) -> DataFrame:
    """The k highest-scoring documents of each item: item (a number), item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    found, base = None, 0
    for some in blocks(items, item_id, item_text, block):
        number: dict[bytes, int] = {}
        for _, c in some:
            for t in c:
                number.setdefault(t, len(number))
        counts = cut(term_counts(docs, doc_id, text, number), "term-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each of the block's terms
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(number))]
        ranked = _ranked(counts, Index(some, number, weight), pa.array([i for i, _ in some], to_arrow_type(kind)), kind.simpleString(), base, k, (n_docs, n_terms))
        found = ranked if found is None else found.union(ranked)
        base += len(some)
    if found is None:
        found = spark.createDataFrame([], f"item long, item_id {kind.simpleString()}, id long, score long")
    return merged(found, ["item"], k, F.coalesce("id", F.lit(0))).select("item", "item_id", "rank", F.col("id").alias("doc_id"), "score")


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")
