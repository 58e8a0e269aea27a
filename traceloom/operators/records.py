"""Filters, order and paging of records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("turn_id", "ts", "doc_id")
#: Older labels of a source that a filter by its name takes in.
LABELS = {"codex": ("codex", "codex-session", "codex-history")}


@dataclass(frozen=True)
class Filter:
    """All given parts must hold; both ends of the time range are inside."""

    project: str | None = None
    role: str | None = None
    tool: str | None = None
    sources: tuple[str, ...] = ()
    session: str | None = None
    since: int | None = None
    until: int | None = None
    extra: list[Column] = field(default_factory=list)

    def condition(self) -> Column:
        c = F.lit(True)
        for name, value in (("project", self.project), ("role", self.role), ("tool_name", self.tool), ("session_id", self.session)):
            if value is not None:
                c &= F.col(name) == value
        if self.sources:
            c &= F.col("source").isin(*(x for s in self.sources for x in LABELS.get(s, (s,))))
        if self.since is not None:
            c &= F.col("ts") >= self.since
        if self.until is not None:
            c &= F.col("ts") <= self.until
        for x in self.extra:
            c &= x
        return c


def in_scope(records: DataFrame, scope: DataFrame) -> DataFrame:
    """Records of the sessions in scope (source, session_id, source_path); an empty scope has none."""
    return records.join(scope.select("source", "session_id", "source_path").distinct(), ["source", "session_id", "source_path"], "left_semi")


def embeddable(records: DataFrame) -> DataFrame:
    return records.filter(F.col("role").isin("user", "assistant") & (F.col("text") != ""))


def recent(records: DataFrame, n: int, where: Filter = Filter()) -> DataFrame:
    return records.filter(where.condition()).orderBy(F.desc("ts"), "doc_id").limit(n)


def top_per_session(hits: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The best n hits of each (machine, source, session), paths together."""
    keys = [c for c in ("machine", "source", "session_id") if c in hits.columns]
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc("ts"), "doc_id")
    return hits.withColumn("rank_in_session", F.row_number().over(w)).filter(F.col("rank_in_session") <= n)


def session_page(records: DataFrame, session_id: str, offset: int, limit: int, source_path: str | None = None) -> DataFrame:
    """One page in order of turn, with the session's total, its time range and the next offset (null at the end)."""
    own = records.filter(F.col("session_id") == session_id)
    if source_path is not None:
        own = own.filter(F.col("source_path") == source_path)
    total, first, last = own.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
    page = own.orderBy(*ORDER).offset(offset).limit(limit)
    about = {"total": F.lit(total), "first_ts": F.lit(first), "last_ts": F.lit(last), "next_offset": F.lit(offset + limit if total > offset + limit else None).cast("int")}
    return page.withColumns({k: v if k == "next_offset" else v.cast("long") for k, v in about.items()})


#: Roles of tools' records, and of thoughts.
TOOL_ROLES, THOUGHT_ROLES = ("tool_use", "tool_result"), ("reasoning",)


def visible(records: DataFrame, show_tools: bool = False, show_reasoning: bool = False) -> DataFrame:
    """What a preview shows: tools' records and thoughts only if they are wanted."""
    hidden = (() if show_tools else TOOL_ROLES) + (() if show_reasoning else THOUGHT_ROLES)
    return records.filter(~F.col("role").isin(*hidden)) if hidden else records


def fields(df: DataFrame, names: list[str]) -> DataFrame:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return df.select(*names)


def order_hits(hits: DataFrame, by: str = "score", limit: int | None = None) -> DataFrame:
    first = [F.desc("score"), F.desc("ts")] if by == "score" else [F.desc("ts"), F.desc("score")]
    out = hits.orderBy(*first, "doc_id")
    return out if limit is None else out.limit(limit)


def candidates(limit: int, views: int = 1, scoped: bool = False, hybrid: bool = False) -> int:
    """Hits to fetch before fusing, grouping or filtering."""
    if hybrid:
        return min(max(5 * limit, 50), 500)
    return max(5 * limit, limit + 10) if views > 1 or scoped else limit
