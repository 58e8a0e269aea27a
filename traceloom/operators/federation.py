"""Several sources or machines as one, where some of them may fail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Counters that add up when diagnostics are merged; maps add up by key.
SUMS = ("malformed_json_lines", "non_object_json_lines", "orphan_tool_results", "duplicate_tool_calls", "encrypted_reasoning_dropped", "truncated_tool_inputs", "truncated_tool_outputs")
MAPS = ("unknown_top_level_types", "unknown_semantic_types")


@dataclass
class Answers:
    """What came of a number of parts: rows of those that answered, warnings (part, message) of the others."""

    rows: DataFrame | None = None
    warnings: list[tuple[str, str]] = field(default_factory=list)
    answered: list[str] = field(default_factory=list)


def gather(parts: dict[str, Callable[[], DataFrame]], name: str | None = None) -> Answers:
    """Runs each part by itself and keeps its rows in the shared folder, so that one that fails, at whatever row, costs
    only its own. With `name`, a column of that name says which part a row is from."""
    out = Answers()
    for part, scan in parts.items():
        try:
            df = cut(scan(), "part")
        except Exception as error:  # noqa: BLE001  whatever a source's files hold
            out.warnings.append((part, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
            continue
        out.answered.append(part)
        df = df.withColumn(name, F.lit(part)) if name else df
        out.rows = df if out.rows is None else out.rows.unionByName(df)
    return out


def machines(named: list[str], known: list[str], local: str = "local") -> list[str]:
    """Which machines are asked: those named, each once, in order; all known ones and the local one if none is named.
    An unknown one is an error."""
    wanted = list(dict.fromkeys(n.strip() for n in named if n.strip())) or [local, *(k for k in known if k != local)]
    unknown = [n for n in wanted if n != local and n not in known]
    if unknown:
        raise ValueError(f"unknown machine: {', '.join(unknown)}")
    return wanted


def views(query: str, more: list[str]) -> list[str]:
    """A query's views: trimmed, without empty ones, each once, in order."""
    return list(dict.fromkeys(q.strip() for q in (query, *more) if q.strip()))


def own_keys(keys: DataFrame, machine: str) -> DataFrame:
    """source, session_id of the keys (machine, source, session_id) of one machine."""
    return keys.filter(F.col("machine") == machine).select("source", "session_id")


def latest(parts: dict[str, Callable[[], DataFrame]], limit: int, order: list[str], ts: str = "ts") -> Answers:
    """The latest rows of all machines. Each machine cuts its own list to `limit` rows first, so that no more than that
    many rows of each are ever ordered together. order: what decides among equal times."""
    by = [F.desc(ts), *order]
    got = gather({m: (lambda scan=scan: scan().orderBy(*by).limit(limit)) for m, scan in parts.items()}, "machine")
    if got.rows is None:
        raise RuntimeError("all machines failed: " + "; ".join(f"{m}: {w}" for m, w in got.warnings))
    got.rows = got.rows.orderBy(F.desc(ts), *order, "machine").limit(limit)
    return got


def activity(parts: dict[str, Callable[[], DataFrame]], keys: DataFrame | None, bucket: str, value: str) -> Answers:
    """Counts of all machines by bucket and source; with keys (machine, source, session_id), each machine counts its own
    sessions only. parts give source, session_id, the bucket and a value."""

    def one(machine: str, scan: Callable[[], DataFrame]) -> DataFrame:
        df = scan()
        df = df if keys is None else df.join(own_keys(keys, machine).distinct(), ["source", "session_id"], "left_semi")
        return df.groupBy(bucket, "source").agg(F.sum(value).alias(value))

    got = gather({m: (lambda m=m, scan=scan: one(m, scan)) for m, scan in parts.items()}, "machine")
    if got.rows is not None:
        got.rows = got.rows.groupBy(bucket, "source").agg(F.sum(value).alias(value))
    return got


def merge_diagnostics(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row of counters (a row a value of `by`): numbers are added up, maps by key."""
    sums = parts.groupBy(*by).agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in SUMS if c in parts.columns))
    for m in (m for m in MAPS if m in parts.columns):
        each = parts.select(*by, F.explode(m).alias("k", "n")).groupBy(*by, "k").agg(F.sum("n").cast("long").alias("n"))
        held = each.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(m))
        none = F.create_map().cast("map<string,bigint>")
        sums = sums.join(held, list(by), "left") if by else sums.join(held)  # one row each
        sums = sums.withColumn(m, F.coalesce(m, none))
    return sums


def first_by_session(hits: DataFrame, order: list, session: str = "session_id") -> DataFrame:
    """Each session's first hit; hits without a session stay."""
    n = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return hits.withColumn("_n", n).filter((F.col("_n") == 1) | F.col(session).isNull()).drop("_n")


def distinct_page(search: Callable[[int], DataFrame], wanted: int, order: list, session: str = "session_id", first: int | None = None) -> DataFrame:
    """A page of `wanted` different sessions: search(n) gives the first n hits, and n doubles until their first hits
    fill the page or the hits run out."""
    n = first or wanted
    while True:
        hits = cut(search(n), "hits")
        page = first_by_session(hits, order, session).orderBy(*order).limit(wanted)
        if page.count() >= wanted or hits.count() < n:
            return page
        n *= 2

