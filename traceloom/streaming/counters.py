"""Cumulative token counters turned into requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("input", "cached", "output", "reasoning")
SCHEMA = "source_path string, source_order long, ts long, input long, cached long, output long, reasoning long, mixed boolean"
Four = tuple[int, int, int, int]
NONE: Four = (0, 0, 0, 0)
#: A total that is among so many of the latest ones is a replay.
LATEST = 64


def plus(a: Four, b: Four) -> Four:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3])


def reaches(a: Four, b: Four) -> bool:
    return a[0] >= b[0] and a[1] >= b[1] and a[2] >= b[2] and a[3] >= b[3]


def lift(total: Four, paid: Four, top: Four) -> Four:
    """By part, how far a total exceeds all that is paid and, unless it lies below it, the highest total so far."""
    return tuple(max(0, t - max(p, h if t >= h else 0)) for t, p, h in zip(total, paid, top, strict=True))  # type: ignore[return-value]


# What a line bills. Each rule has the line's total and request, what is paid, the highest total by part, and whether
# the totals so far have been the sums of what was billed.


def request_alone(total: None, request: Four, paid: Four, top: Four, agree: bool) -> Four:
    """No total: the request is billed as it stands."""
    return request


def total_alone(total: Four, request: None, paid: Four, top: Four, agree: bool) -> Four:
    """No request: what the total adds, in one stream or in several."""
    return lift(total, paid, top)


def one_stream(total: Four, request: Four, paid: Four, top: Four, agree: bool) -> Four:
    """The total has only grown: what it has grown by, if totals can be trusted and the request isn't less; else the request."""
    grown = lift(total, NONE, top)
    return grown if agree and reaches(request, grown) else request


def several_streams(total: Four, request: Four, paid: Four, top: Four, agree: bool) -> Four:
    """The file mixes streams: the request, but by part no more than lifts the total over all that is paid."""
    return tuple(map(min, request, lift(total, paid, top)))  # type: ignore[return-value]


def fold(lines: Iterable[tuple], ground: Four | None = None) -> Iterator[tuple[Four, bool]]:
    """What each line of one file bills, and whether several streams share the file by then.

    A line: total and request (four numbers or None), replayed (its total is one of its parent's), inherited (its total
    is the ground that a fork starts from: it is met, not billed). ground: the totals that a fork begins with.
    """
    paid, top, met, agree, mixed = NONE, ground or NONE, deque(maxlen=LATEST), True, False
    for total, request, replayed, inherited in lines:
        bill = NONE
        if total is None:
            if request is not None and not inherited:
                bill = request_alone(total, request, paid, top, agree)
                paid = plus(paid, bill)
                top = tuple(map(max, top, paid))
        elif inherited or not (replayed or total in met):
            if not inherited:
                mixed = mixed or not reaches(total, top)
                rule = total_alone if request is None else several_streams if mixed else one_stream
                bill = rule(total, request, paid, top, agree)
                paid = plus(paid, bill)
                agree = agree and total == paid
            top = tuple(map(max, top, total))
            if not met or met[-1] != total:
                met.append(total)
        yield bill, mixed


def deltas(totals: DataFrame, keep: list[str] = ()) -> DataFrame:
    """totals: source_path, source_order, ts and the four sums (null where a line has none); also, if there are such
    columns, last_* (the four numbers of the last request), base_* (what a fork starts from), inherited (ground that a
    fork took over) and replayed. One row a request; `mixed` once several streams share the file. Columns in keep come
    through from the request's line.

    The order of a file's lines decides, and no window can say it. Files are dealt and sorted by Spark; a task reads
    them line by line and holds one file's sums, however long a file is.
    """
    have = set(totals.columns)
    opt = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    names = [*FIELDS, *(f"last_{f}" for f in FIELDS), *(f"base_{f}" for f in FIELDS)]
    rows = totals.select("source_path", F.col("source_order").cast("long").alias("source_order"), F.col("ts").cast("long").alias("ts"), *(opt(c, "long") for c in names), opt("inherited", "boolean"), opt("replayed", "boolean"), *keep)
    ahead = len(rows.columns) - len(keep)

    four = lambda x: tuple(v or 0 for v in x) if any(x) else None

    def read(batches: Iterator[pa.RecordBatch], row: dict) -> Iterator[tuple]:
        for batch in batches:
            for k, (path, order, ts, *rest) in enumerate(zip(*(x.to_pylist() for x in batch.columns[:ahead]), strict=True)):
                row |= {"batch": batch, "at": k, "key": (path, order, ts), "ground": None if all(v is None for v in rest[8:12]) else tuple(v or 0 for v in rest[8:12])}
                yield path, (four(rest[:4]), four(rest[4:8]), bool(rest[13]), bool(rest[12]))

    def bill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row: dict = {}  # the line that is being read
        batch, out, at = None, [], []
        kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_()]

        def billed() -> pa.RecordBatch:
            kept = [batch.column(ahead + k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)), *kept], ["source_path", "source_order", "ts", *FIELDS, "mixed", *keep])

        for _, lines in groupby(read(batches, row), key=lambda x: x[0]):
            first = next(lines)
            for took, mixed in fold((x[1] for x in chain([first], lines)), row["ground"]):
                if row["batch"] is not batch:
                    if out:
                        yield billed()
                    batch, out, at = row["batch"], [], []
                if any(took):
                    out.append((*row["key"], *took, mixed))
                    at.append(row["at"])
        if out:
            yield billed()

    schema = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in totals.select(*keep).schema) if keep else ""
    return rows.repartition("source_path").sortWithinPartitions("source_path", "source_order").mapInArrow(bill, SCHEMA + schema)


def inherited(children: DataFrame, parents: DataFrame, values: list[str]) -> DataFrame:
    """What a fork starts from: the largest of each of its parent's totals up to the time of the fork. children:
    source_order, parent_id, fork_ts; parents: session_id, ts, values. One running maximum over both together."""
    none: list[Column] = [F.lit(None).cast(parents.schema[v].dataType).alias(v) for v in values]
    both = parents.select(F.col("session_id").alias("parent_id"), "ts", F.lit(None).cast(children.schema["source_order"].dataType).alias("source_order"), F.lit(0).alias("_fork"), *values).union(
        children.select("parent_id", F.col("fork_ts").alias("ts"), "source_order", F.lit(1).alias("_fork"), *none)
    )
    w = Window.partitionBy("parent_id").orderBy("ts", "_fork").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select("source_order", "_fork", F.sum(1 - F.col("_fork")).over(w).alias("_rows"), *(F.max(v).over(w).alias(v) for v in values))
    return seen.filter("_fork = 1 and _rows > 0").groupBy("source_order").agg(*(F.max(v).alias(v) for v in values))


def replays(children: DataFrame, parents: DataFrame) -> DataFrame:
    """source_path, source_order of children's totals that their parent had reached by the time of the fork. children:
    source_path, source_order, parent_id, fork_ts, FIELDS; parents: session_id, ts, FIELDS."""
    first = parents.groupBy(F.col("session_id").alias("parent_id"), *FIELDS).agg(F.min("ts").alias("_first"))
    return children.join(first, ["parent_id", *FIELDS]).filter(F.col("_first") <= F.col("fork_ts")).select("source_path", "source_order").distinct()
