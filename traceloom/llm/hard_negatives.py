"""Hard negatives for embeddings, by threshold joins of anchors with all rows.

A join finds all pairs whose inner product reaches the anchor's threshold. Rows come in blocks; a row's dimensions
are indexed from the first on, up to where the norm of the others times the largest anchor's is below the smallest
threshold: a pair that meets only there can't reach it. Lists of dimensions are followed for many anchors at a time,
`STEP` dimensions at a time; after each, a pair whose partial score and remaining norms stay below the threshold is
dropped. What is left of a pair, dimensions that are not indexed included, is added last. Thresholds start high, and
those of anchors whose windows aren't full yet are lowered round by round, at last to where nothing is left out.

First each anchor's positives are found, then for each positive the negatives whose scores lie in its window. A task
keeps only a bounded heap for each window, and raises an anchor's threshold when its heaps are full. Anchors go to the
tasks in broadcasts of at most `ANCHORS` rows; every row is held against every anchor, in blocks.

Components are scaled and rounded down to integers, so scores are exact.

Defined results: rows with a null label, a null vector, a null or non-finite component take no part; a shorter vector
ends in zeros; rows with the anchor's own id are neither its positives nor its negatives; exact repeats of an anchor
are one anchor, other repeated rows count each; null ids come last among equal scores; a positive with a negative score
has an empty window; an empty table gives no row. Scores of 2^53 or more are an error. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .heaps import Heaps, merged

#: Anchors in a broadcast; with 1,000 dimensions 65 MB in 8 bytes each.
ANCHORS = 8_192
#: Anchors and rows in a block; their scores are held at once.
BLOCK = (256, 4_096)
STEP = 8
#: Thresholds of the rounds: shares of the anchor's squared norm for positives, of the way through the window for negatives.
POSITIVE_ROUNDS = (0.4, 0.25, 0.1, 0.0)
NEGATIVE_ROUNDS = (0.9, 0.5, 0.0)
EXACT = float(1 << 53)


def integers(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch (its third column: list of double) take part, and their vectors, as whole numbers."""
    lists = batch.column(2)
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    flat = lists.values.slice(lists.offsets[0].as_py(), int(size.sum())) if len(lists) else pa.array([], pa.float64())
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    bad = np.zeros(len(size), bool)
    bad[row[~np.isfinite(x)]] = True
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = np.where(np.isfinite(x), x, 0)
    with np.errstate(over="ignore"):
        out = np.floor(scale * out)
    return ~bad, out


def tails(v: np.ndarray) -> np.ndarray:
    """Of each row, the norm of the dimensions from the first, STEP-th, ... on, a little too large; the last is 0."""
    squares = np.add.reduceat(np.square(v, dtype=np.float64), np.arange(0, v.shape[1], STEP), axis=1)
    return np.sqrt(np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(v), 1))], axis=1)) * (1 + 1e-9)


def reaching(q: np.ndarray, q_tail: np.ndarray, least: np.ndarray, x: np.ndarray, x_tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (a, r, score) with score = q[a] . x[r] >= least[a]."""
    steps = q_tail.shape[1] - 1
    needed = (x_tail * q_tail[:, 0].max() >= least.min()).sum(axis=1)  # indexed steps, where the last tail may add one
    needed = np.minimum(needed, steps)
    order = np.argsort(-needed, kind="stable")
    needed = needed[order]
    n = int(np.searchsorted(-needed, 0))
    x, x_tail, needed = x[order[:n]], x_tail[order[:n]], needed[:n]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = np.searchsorted(-needed, -np.arange(steps), side="left")  # rows in the lists of a step
    a = r = np.zeros(0, np.int64)
    part = np.zeros((len(q), n), q.dtype)
    at = steps
    for k in range(steps):
        m = int(lists[k])
        on = slice(STEP * k, STEP * (k + 1))
        part[:, :m] += q[:, on] @ x[:m, on].T
        rest = np.take_along_axis(x_tail, np.minimum(needed, k + 1)[:, None], axis=1)[:, 0]
        if q_tail[:, k + 1].mean() * rest.mean() < least.mean() / 2 or k == steps - 1:  # else few pairs can be dropped
            bound = part + q_tail[:, k + 1][:, None] * rest if (needed > k).all() else part + np.take_along_axis(q_tail, np.minimum(needed, k + 1)[None, :], axis=1) * rest
            alive = bound >= least[:, None]
            if k == steps - 1 or np.count_nonzero(alive) * 16 < alive.size:
                a, r = np.nonzero(alive)
                at = k + 1
                break
    score, done = part[a, r], np.minimum(needed[r], at)
    for k in range(int(done.min(initial=steps)), steps):
        on = slice(STEP * k, STEP * (k + 1))
        more = np.flatnonzero(done <= k)
        score[more] += np.einsum("ij,ij->i", q[a[more], on], x[r[more], on])
        kept = (done > k + 1) | (score + q_tail[a, k + 1] * x_tail[r, k + 1] >= least[a])
        a, r, score, done = a[kept], r[kept], score[kept], done[kept]
    kept = score >= least[a]
    return a[kept], order[r[kept]], score[kept].astype(np.int64)


@dataclass
class Anchors:
    """A block of anchors, and the windows of each: scores from low to high of rows of the same label or of others."""

    key: list[tuple]
    label: np.ndarray  # codes
    codes: dict[str, int]
    v: np.ndarray
    least: np.ndarray
    low: np.ndarray  # anchors by windows; a window that isn't there is empty
    high: np.ndarray

    def heaps(self, batches: Iterator[pa.RecordBatch], k: int, same: bool, scale: float) -> Heaps:
        dims = self.v.shape[1]
        order = np.argsort(-np.square(self.v).mean(axis=0), kind="stable")
        v, norms = self.v[:, order], np.sqrt(np.square(self.v).sum(axis=1))
        ids = np.array([i for i, _ in self.key], np.int64)
        q_tail, least, windows = tails(v), self.least.copy(), self.low.shape[1]
        heaps = Heaps(len(v) * windows, k)
        for batch in batches:
            ok, x = integers(batch, scale)
            doc, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            label = np.array([self.codes.get(s, -1) for s in batch.column(1).to_pylist()], np.int64)
            x = np.pad(x[:, :dims], ((0, 0), (0, max(0, dims - x.shape[1]))))[:, order]
            largest = norms.max() * np.sqrt(np.square(x[ok]).sum(axis=1).max(initial=0))
            if not largest < EXACT:
                raise ValueError("scores of 2^53 or more can't be told apart exactly")
            kind = np.float32 if largest < 1 << 24 else np.float64
            groups = [(np.flatnonzero(ok & (label == c)), np.flatnonzero(self.label == c)) for c in np.intersect1d(label[ok], self.label)] if same else [(np.flatnonzero(ok), np.arange(len(v)))]
            for rows, own in groups:
                own = own[np.argsort(-least[own], kind="stable")]
                for i in range(0, len(rows), BLOCK[1]):
                    some = rows[i : i + BLOCK[1]]
                    xs, x_tail = x[some].astype(kind), tails(x[some])
                    for j in range(0, len(own), BLOCK[0]):
                        by = own[j : j + BLOCK[0]]
                        a, r, score = reaching(v[by].astype(kind), q_tail[by], least[by], xs, x_tail)
                        a, r = by[a], some[r]
                        other = null[r] | (doc[r] != ids[a])
                        if not same:
                            other &= label[r] != self.label[a]
                        a, r, score = a[other], r[other], score[other]
                        for w in range(windows):
                            fit = (score >= self.low[a, w]) & (score <= self.high[a, w])
                            heaps.add(a[fit] * windows + w, score[fit], doc[r[fit]], null[r[fit]])
                        full = np.where(self.low <= self.high, heaps.floor.reshape(-1, windows), np.iinfo(np.int64).max).min(axis=1)
                        least = np.maximum(least, np.where(full < np.iinfo(np.int64).max, full, least))
        return heaps


def _anchor_blocks(anchors: DataFrame, most: int) -> Iterator[Anchors]:
    """anchors: id, key, label, v (binary of doubles), least, low, high (arrays); the driver holds one block at a time."""
    held: list = []

    def block() -> Anchors:
        codes: dict[str, int] = {}
        label = np.array([codes.setdefault(r.label, len(codes)) for r in held], np.int64)
        vs = [np.frombuffer(r.v, np.float64) for r in held]
        v = np.zeros((len(vs), max(1, *map(len, vs))))
        for k, x in enumerate(vs):
            v[k, : len(x)] = x
        windows = max(len(r.low) for r in held)
        low, high = np.ones((len(vs), windows), np.int64), np.zeros((len(vs), windows), np.int64)
        for k, r in enumerate(held):
            low[k, : len(r.low)], high[k, : len(r.high)] = r.low, r.high
        return Anchors([(r.id, r.key) for r in held], label, codes, v, np.array([r.least for r in held], np.float64), low, high)

    for r in anchors.select("id", "key", "label", "v", "least", "low", "high").toLocalIterator():
        held.append(r)
        if len(held) == most:
            yield block()
            held = []
    if held:
        yield block()


def threshold_join(rows: DataFrame, anchors: DataFrame, k: int, same: bool, scale: float, most: int = ANCHORS) -> DataFrame:
    """anchor, key, window (from 0), id, score, rank: the first k of each window among rows whose score reaches the
    anchor's `least`."""
    spark, found = rows.sparkSession, None
    for block in _anchor_blocks(anchors, most):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            heaps = block.heaps(batches, k, same, scale)
            at, w = np.divmod(heaps.group, block.low.shape[1])
            key = [block.key[i] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in key], pa.int64()), pa.array([x[1] for x in key], pa.int64()), pa.array(w.astype(np.int32)), pa.array(heaps.id, mask=heaps.null), pa.array(heaps.score)], ["anchor", "key", "window", "id", "score"])

        some = rows.mapInArrow(run, "anchor long, key long, window int, id long, score long")
        found = some if found is None else found.union(some)
    if found is None:
        found = spark.createDataFrame([], "anchor long, key long, window int, id long, score long")
    return merged(found, ["anchor", "key", "window"], k, F.coalesce("id", F.lit(0)))


def _rounds(rows: DataFrame, anchors: DataFrame, least: list[Column], k: int, same: bool, scale: float, most: int) -> DataFrame:
    """What threshold_join finds, each anchor by the first of the thresholds that fills all of its windows, or by the last."""
    parts, opened = None, anchors
    for turn, t in enumerate(least):
        got = cut(threshold_join(rows, opened.withColumn("least", t), k, same, scale, most), "found")
        if turn < len(least) - 1:
            filled = got.groupBy(F.col("anchor").alias("id"), "key").agg(F.count("*").alias("n")).join(opened.select("id", "key", (F.size("low") * k).alias("all")), ["id", "key"]).filter("n = all").select("id", "key")
            filled = cut(filled, "filled")
            got = got.join(filled.withColumnRenamed("id", "anchor"), ["anchor", "key"], "left_semi")
            opened = cut(opened.join(filled, ["id", "key"], "left_anti"), "opened")
        parts = got if parts is None else parts.union(got)
        if opened.isEmpty():
            break
    return parts


def mine(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, most: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each row that `anchor` (a condition
    on id) chooses and each of its first `positives` others of the same label, the first `negatives` of another label
    with scores of low to high percent of the positive's."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).filter("label is not null and v is not null")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = integers(batch, scale)
            ok &= np.isfinite(x).all(axis=1)
            kept = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array([v.tobytes() for v in x[ok]], pa.binary()), pa.array(np.square(x[ok]).sum(axis=1))], ["id", "label", "v", "norm2"])

    chosen = rows.filter(anchor).mapInArrow(whole, "id long, label string, v binary, norm2 double").distinct()
    anchors = cut(chosen.withColumn("key", F.xxhash64("label", "v")), "anchors")
    longs = lambda x: F.array(F.lit(x).cast("long"))
    all_scores = anchors.withColumns({"low": longs(0), "high": longs(2**62)})  # a positive below 0 has no window
    found = _rounds(rows, all_scores, [F.lit(f) * F.col("norm2") for f in POSITIVE_ROUNDS], positives, True, scale, most)
    found = cut(found.select("anchor", "key", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("w.positive_score")
    windows = found.groupBy(F.col("anchor").alias("id"), "key").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("w"))
    whole_div = lambda s: ((s - F.pmod(s, F.lit(100))) / 100).cast("long")
    windows = anchors.join(windows, ["id", "key"]).withColumns({"low": F.transform(score, lambda s: whole_div(low * s + 99)), "high": F.transform(score, lambda s: whole_div(high * s))})
    last = F.array_min("low").cast("double")
    least = [last + f * (F.array_min("high") - last) for f in NEGATIVE_ROUNDS]
    near = _rounds(rows, windows, least, negatives, False, scale, most)
    near = near.select("anchor", "key", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, ["anchor", "key", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.withColumn("label", label), F.col("id") % 50 == 0)
