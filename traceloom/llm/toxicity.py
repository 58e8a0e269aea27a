"""Toxicity by a factorization machine over hashed terms.

A text is the set of the hashes of its words and of their beginnings. The score is the logistic of a bias, a weight for
each term and, for each pair of terms, the inner product of their factors: a pair (an insult and a mention of a group)
can weigh more than its parts, or less.

The machine is fitted on the driver to at most `Fit.rows` labelled rows (those with the smallest hash of the id), of
which only the terms' hashes go there. It keeps the terms that tell the classes apart, alone or in pairs; the 2^20
values of the hash bound what is broadcast.

Defined results: null and empty text have no terms and score the bias; rows without a label or with a null one are
not learned from; of several labels of one id the largest counts; without any labelled row all texts score 0.5;
repeated rows each count; a text of any length is the set of its terms; columns of any other name pass untouched in
`row`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_crc, table
from .decontaminate import words_of

BITS = 20
ROWS, BLOCK = 500, 256  # of the matrices of pairs


@dataclass(frozen=True)
class Fit:
    rows: int = 12_000  # labelled rows to learn from
    least: int = 4  # rows with a term
    alone: float = 2.5  # standard deviations by which a term tells the classes apart
    together: float = 5.0  # and by which a pair does beyond its two terms
    paired: float = 0.01  # share of the rows that a term is in, to be looked at in pairs
    factors: int = 4
    steps: int = 400
    rate: float = 0.05
    l2: float = 4e-5
    seed: int = 11


@dataclass
class Machine:
    bias: float
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    factors: np.ndarray

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        """Of texts given as arrays of distinct hashes."""
        out = np.full(len(found), self.bias)
        for k, h in enumerate(found):
            if len(h) and len(self.terms):
                at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
                at = at[self.terms[at] == h]
                if len(at):
                    v = self.factors[at]
                    out[k] += self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def hashed(text: str | None) -> np.ndarray:
    """Hashes of the words and, as many words are forms of one, of the first five bytes of longer ones."""
    mask = (1 << BITS) - 1
    words = set(words_of(text))
    words |= {w[:5] + b"*" for w in words if len(w) > 5}
    return np.array(sorted({zlib.crc32(w) & mask for w in words}), dtype=np.int32)


def telling_pairs(row: np.ndarray, term: np.ndarray, labels: np.ndarray, share: float, fit: Fit) -> np.ndarray:
    """Terms that tell the classes apart with another one: the share of toxic rows among those with both lies far from
    what the two shares add up to. Of terms in `paired` of the rows; numbers of rows are products of 0-1 matrices, made
    for `BLOCK` terms against all at a time."""
    n = len(labels)
    often = np.flatnonzero(np.bincount(term, minlength=1 << BITS) >= max(fit.paired * n, fit.least)).astype(np.int32)
    if len(often) < 2:
        return often[:0]
    at = np.minimum(np.searchsorted(often, term), len(often) - 1)
    on = often[at] == term
    row, at = row[on], at[on]
    seen = np.bincount(at, minlength=len(often))
    rate = (np.bincount(at, weights=labels[row], minlength=len(often)) / seen).astype(np.float32)
    found = np.zeros(len(often), bool)
    starts = np.searchsorted(row, np.arange(0, n + ROWS, ROWS))
    for b in range(0, len(often), BLOCK):
        block = slice(b, b + BLOCK)
        both = toxic = np.float32(0)
        for k, (i, j) in enumerate(zip(starts, starts[1:], strict=False)):
            x = np.zeros((ROWS, len(often) - b), np.float32)  # pairs with terms before the block were looked at there
            later = at[i:j] >= b
            x[row[i:j][later] - k * ROWS, at[i:j][later] - b] = 1
            y = np.zeros(ROWS, np.float32)
            y[: len(labels[k * ROWS : (k + 1) * ROWS])] = labels[k * ROWS : (k + 1) * ROWS]
            own = x[:, :BLOCK].T
            both, toxic = both + own @ x, toxic + (own * y) @ x
        wanted = np.clip(rate[block, None] + rate[None, b:] - np.float32(share), 0, 1)
        z = np.where(both >= fit.least, np.abs(toxic - wanted * both) / np.sqrt(share * (1 - share) * np.maximum(both, 1)), 0)
        np.fill_diagonal(z, 0)
        found[block] |= (z > fit.together).any(1)
        found[b:] |= (z > fit.together).any(0)
    return often[found]


def learn(found: list[np.ndarray], labels: np.ndarray, fit: Fit = Fit()) -> Machine:
    """Adam on the logistic loss of all rows. Terms are screened: those stay whose share among the toxic rows lies far
    from that among all, and those that tell the classes apart in a pair."""
    none = Machine(0.0, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, fit.factors)))
    if not len(labels):
        return none
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    flat, row = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
    seen = np.bincount(flat, minlength=1 << BITS)
    toxic = np.bincount(flat, weights=labels[row], minlength=1 << BITS)
    z = np.where(seen >= fit.least, np.abs(toxic - share * seen) / np.sqrt(share * (1 - share) * np.maximum(seen, 1)), 0)
    terms = np.union1d(np.flatnonzero(z > fit.alone), telling_pairs(row, flat, labels, share, fit)).astype(np.int32)
    bias = float(np.log(share / (1 - share)))
    if not len(terms):
        return Machine(bias, terms, np.zeros(0), np.zeros((0, fit.factors)))
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    on = terms[at] == flat
    row, at = row[on], at[on]
    n, m, k = len(found), len(terms), fit.factors
    rng = np.random.default_rng(fit.seed)
    p = np.concatenate([[bias], np.zeros(m), rng.normal(0, 0.02, m * k)])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, fit.steps + 1):
        w, v = p[1 : m + 1], p[m + 1 :].reshape(m, k)
        sums = np.stack([np.bincount(row, v[at, f], n) for f in range(k)], 1)
        own = np.bincount(row, (v**2).sum(1)[at], n)
        y = p[0] + np.bincount(row, w[at], n) + 0.5 * ((sums**2).sum(1) - own)
        g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels) / n
        gw = np.bincount(at, g[row], m)
        gv = np.stack([np.bincount(at, g[row] * sums[row, f], m) for f in range(k)], 1) - gw[:, None] * v
        grad = np.concatenate([[g.sum()], gw + fit.l2 * w, (gv + fit.l2 * v).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        p = p - fit.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Machine(float(p[0]), terms, p[1 : m + 1], p[m + 1 :].reshape(m, k))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """docs of at most `rows` labelled ids, those with the smallest hash, one row an id; with the label as y."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(doc_id), doc_id).limit(rows)
    one = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.xxhash64(text), text))  # of an id on several texts
    return docs.join(F.broadcast(chosen), doc_id).withColumn("_one", one).filter("_one = 1").drop("_one")  # `rows` rows at most


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fit: Fit = Fit()) -> Machine:
    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([hashed(t.as_py()) for t in batch.column(0)], pa.list_(pa.int32()))], ["y", "terms"])

    picked = sample(docs.select(doc_id, text), labels, doc_id, text, label, fit.rows).select(text, "y")
    got = picked.mapInArrow(hash_batches, "y double, terms array<int>").toArrow()  # fit.rows rows at most
    return learn([np.asarray(x.values, dtype=np.int32) for x in got.column("terms")], got.column("y").to_numpy(), fit)


def score(docs: DataFrame, text: str, machine: Machine) -> DataFrame:
    """docs as the struct `row`, with score."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    df = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.score([hashed(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["row", "score"])

    out = df.drop("text").withColumn("score", F.lit(0.0)).schema
    return df.mapInArrow(score_batches, out)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0
    machine = train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out), "doc_id", "text", "toxic")
    rows = score(docs, "text", machine).select("row.doc_id", "score")
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
