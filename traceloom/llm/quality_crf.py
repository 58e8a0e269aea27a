"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its features are its own and those of the lines before and behind it. Forward-backward
gives each line's probability of being good; a document's quality is their mean, weighted by the lines' lengths, put
through a logistic curve fitted to the labels.

Lines have no labels of their own: a document's label only says that the weighted mean of its lines is high or low. The
field begins with every line on its own, labelled as its document, then alternates: expected labels and moves are taken under the
field itself, shifted document by document just as far as the mean demands, and the field is fitted to them. So lines
of a bad document that look good become good, as long as enough of it is bad.

The field is fitted on the driver to at most `Fit.rows` labelled documents (those with the smallest hash of the id), of
which only the lines' measures go there (nine numbers and a length each).

Defined results: null and empty text, and text without words, score the share of good rows; rows without a label are
not learned from; of several labels of one id the largest counts; without labelled rows all score 0.5; lines without a
word are left out; repeated rows each count; a text of any length is scored whole, line by line; columns of any other
name pass untouched in `row`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, table
from .toxicity import sample

SYMBOLS, UPPER, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
OWN = 9  # features of a line
CHUNK = 1_000  # documents at a time


@dataclass(frozen=True)
class Fit:
    rows: int = 3_000
    steps: int = 60  # with lines labelled as their documents
    rounds: int = 10  # of expected labels
    each: int = 12  # steps in a round
    rate: float = 0.1
    l2: float = 1e-3
    good: float = 0.9  # least mean of a good document
    bad: float = 0.5  # greatest mean of a bad one


@dataclass
class Field:
    theta: np.ndarray  # score of a good line, by feature
    move: np.ndarray  # 2 x 2: from bad, good to bad, good
    slope: float
    level: float
    share: float  # for documents without lines


def lines_of(text: str | None) -> tuple[list[list[float]], list[int]]:
    """Features and length in bytes of each line with a word."""
    out, lengths, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        w = line.split()
        if not w:
            continue
        n, chars = len(w), len(line)
        distinct = len(set(w))
        out.append([
            (chars - len(line.translate(None, SYMBOLS))) / n,
            min(line.count(b"|") / n, 1.0),
            (chars - len(line.translate(None, UPPER))) / chars,
            line.count(b"!") / n,
            1 - distinct / n,
            float(n >= 12 and distinct < 0.6 * n),
            float(line in seen),
            (chars - len(line.translate(None, DIGITS))) / chars,
            float(n < 4),
        ])
        lengths.append(chars)
        seen.add(line)
    return out, lengths


def measures(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of all lines of all texts, lines per text."""
    rows, lengths, count = [], [], []
    for t in texts:
        a, b = lines_of(t)
        rows += a
        lengths += b
        count.append(len(b))
    return np.array(rows, dtype=np.float64).reshape(-1, OWN), np.array(lengths, dtype=np.float64), np.array(count, dtype=np.int64)


def features(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows of (1, own, before, behind) for all lines."""
    first = np.zeros(len(x), bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    before, behind = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first] = 0
    behind[np.roll(first, -1)] = 0
    return np.hstack([np.ones((len(x), 1)), x, before, behind])


def marginals(unary: np.ndarray, move: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected moves (2 x 2), log of the partition sum. All texts advance together, line by
    line; those that have ended drop out."""
    live = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[live]
    length = count[live]
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    pot = np.stack([np.ones_like(unary), np.exp(np.clip(unary, -30, 30))], 1)
    turn = np.exp(move)
    a, scale = np.zeros_like(pot), np.ones(len(unary))
    steps = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps + 1)]  # with more than t lines
    for t in range(steps):
        i = start[: active[t]] + t
        v = pot[i] if t == 0 else (a[i - 1] @ turn) * pot[i]
        scale[i] = v.sum(1)
        a[i] = v / scale[i][:, None]
    b = np.ones_like(pot)
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        i = start[: active[t]] + t
        r = pot[i] * b[i] / scale[i][:, None]
        pairs += turn * (a[i - 1].T @ r)
        b[i - 1] = r @ turn.T
    return (a * b)[:, 1], pairs, float(np.log(scale).sum())


def aggregate(good: np.ndarray, lengths: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Length-weighted mean of each text; nan without lines."""
    text = np.repeat(np.arange(len(count)), count)
    total = np.bincount(text, lengths, len(count))
    return np.where(total > 0, np.bincount(text, lengths * good, len(count)) / np.maximum(total, 1), np.nan)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def shifts(unary: np.ndarray, move: np.ndarray, lengths: np.ndarray, count: np.ndarray, labels: np.ndarray, fit: Fit) -> np.ndarray:
    """How far each document's lines must be shifted, so that their mean is at least `good` or at most `bad`, by
    halving; 0 where it is already."""
    goal = np.where(labels > 0.5, fit.good, fit.bad)
    sign = np.where(labels > 0.5, 1.0, -1.0)
    mean = lambda by: np.nan_to_num(aggregate(marginals(unary + np.repeat(by, count), move, count)[0], lengths, count), nan=0.5)
    need = sign * (goal - mean(np.zeros(len(count)))) > 0
    low, high = np.zeros(len(count)), np.full(len(count), 20.0)
    for _ in range(8):
        middle = (low + high) / 2
        short = sign * (goal - mean(sign * middle)) > 0
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return np.where(need, sign * high, 0.0)


def learn(x: np.ndarray, lengths: np.ndarray, count: np.ndarray, labels: np.ndarray, fit: Fit = Fit()) -> Field:
    """The lines' measures, their lengths, lines per document, labels of the documents."""
    if not len(labels):
        return Field(np.zeros(1 + 3 * OWN), np.zeros((2, 2)), 0.0, 0.0, 0.5)
    x = features(x, count)
    y = np.repeat(labels, count).astype(np.float64)
    same = np.repeat(np.arange(len(count)), count)
    inner = same[1:] == same[:-1]
    observed = np.zeros((2, 2))
    for k in (0, 1):
        observed[k, k] = (inner & (y[1:] == k)).sum()
    n = max(len(y), 1)
    p = np.zeros(x.shape[1] + 4)
    m1, m2, step = np.zeros_like(p), np.zeros_like(p), 0
    for k in range(fit.rounds + 1):
        if k:
            unary, move = x @ p[:-4], p[-4:].reshape(2, 2)
            y, observed, _ = marginals(unary + np.repeat(shifts(unary, move, lengths, count, labels, fit), count), move, count)
        for _ in range(fit.each if k else fit.steps):
            step += 1
            good, pairs, _ = marginals(x @ p[:-4], p[-4:].reshape(2, 2), count)
            grad = np.concatenate([x.T @ (good - y) / n, (pairs - observed).ravel() / n]) + fit.l2 * p
            if not k:
                grad[1 + OWN :] = 0
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            p = p - fit.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    theta, move = p[:-4], p[-4:].reshape(2, 2)
    q = aggregate(marginals(x @ theta, move, count)[0], lengths, count)
    on = ~np.isnan(q)
    z, t = logit(q[on]), labels[on]
    slope, level = 1.0, 0.0
    for _ in range(50):  # Newton steps on the curve's two numbers
        s = 1 / (1 + np.exp(-np.clip(slope * z + level, -30, 30)))
        r, h = s - t, s * (1 - s)
        g = np.array([(r * z).sum() + 0.1 * slope, r.sum()])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        slope, level = slope - d[0], level - d[1]
        if np.abs(d).max() < 1e-6:
            break
    return Field(theta, move, float(slope), float(level), float(labels.mean()))


def quality(texts: list, field: Field) -> np.ndarray:
    out = []
    for k in range(0, len(texts), CHUNK):
        x, lengths, count = measures(texts[k : k + CHUNK])
        q = aggregate(marginals(features(x, count) @ field.theta, field.move, count)[0], lengths, count)
        s = 1 / (1 + np.exp(-np.clip(field.slope * logit(np.nan_to_num(q, nan=0.5)) + field.level, -30, 30)))
        out.append(np.where(np.isnan(q), field.share, s))
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fit: Fit = Fit()) -> Field:
    def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lengths, count = measures(batch.column(0).to_pylist())
            ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(OWN * ends), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), own, pa.ListArray.from_arrays(pa.array(ends), pa.array(lengths, pa.int32()))], ["y", "own", "lengths"])

    picked = sample(docs.select(doc_id, text), labels, doc_id, text, label, fit.rows).select(text, "y")
    got = picked.mapInArrow(measure_batches, "y double, own array<float>, lengths array<int>").toArrow().combine_chunks()  # fit.rows rows at most
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy().astype(np.float64)
    count = np.array([len(x) for x in got.column("lengths")], dtype=np.int64)
    return learn(flat("own").reshape(-1, OWN), flat("lengths"), count, got.column("y").to_numpy(), fit)


def score(docs: DataFrame, text: str, field: Field) -> DataFrame:
    """docs as the struct `row`, with score."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    df = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(quality(batch.column(1).to_pylist(), held.value), pa.float64())], ["row", "score"])

    return df.mapInArrow(score_batches, df.drop("text").withColumn("score", F.lit(0.0)).schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    field = train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out), "doc_id", "text", "quality")
    rows = score(docs, "text", field).select("row.doc_id", "score")
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
