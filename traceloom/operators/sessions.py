"""The session table and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.projects import repo_project

KEYS = ("source", "session_id", "source_path")


def roll_up(records: DataFrame, arrival: str = "doc_id") -> DataFrame:
    """One row a session: started_at, last_at, message_count, project.

    The project is the first record's, until a later-arriving record that is no older than all before it names one.
    """
    before = F.max("ts").over(Window.partitionBy(*KEYS).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    seen = records.withColumn("_named", (before.isNull() | (F.col("ts") >= before)) & (F.col("project") != ""))
    return seen.groupBy(*KEYS).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_at"), F.count("*").alias("message_count"),
        F.coalesce(F.max_by("project", F.when(F.col("_named"), F.col(arrival))), F.min_by("project", arrival)).alias("project"),
    )


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Roll-ups of two flushes: earliest start, latest end, all messages, the newer project."""
    both = stored.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.groupBy(*KEYS).agg(F.min("started_at").alias("started_at"), F.max("last_at").alias("last_at"), F.sum("message_count").alias("message_count"), F.max_by("project", "_age").alias("project"))


def query(sessions: DataFrame, sources: list[str] = (), since: int | None = None, until: int | None = None, project: str | None = None, by_repo: bool = False, limit: int | None = None) -> DataFrame:
    """Sessions by source, last use (both ends inside) and project, the last used first."""
    c = F.lit(True)
    if sources:
        c &= F.col("source").isin(*sources)
    if since is not None:
        c &= F.col("last_at") >= since
    if until is not None:
        c &= F.col("last_at") <= until
    if project is not None:
        c &= (repo_project(F.col("repo_project"), F.col("project")) if by_repo else F.col("project")) == project
    out = sessions.filter(c).orderBy(F.desc("last_at"), "source", "session_id", "source_path")
    return out if limit is None else out.limit(limit)


def under(root: str) -> Column:
    """The session's working folder is root or below it, or root is its repository."""
    root = root.rstrip("/") or "/"
    low, r = F.lower("cwd"), root.lower()
    return (low == r) | low.startswith(r.rstrip("/") + "/") | (F.col("git_root") == root)


def projects(sessions: DataFrame, by_repo: bool = False) -> DataFrame:
    name = repo_project(F.col("repo_project"), F.col("project")) if by_repo else F.col("project")
    return sessions.select(name.alias("project")).filter("project <> ''").distinct().orderBy("project")


def timeline(sessions: DataFrame) -> DataFrame:
    """project, sessions, last_at, times (ascending)."""
    return sessions.groupBy("project").agg(F.count("*").alias("sessions"), F.max("last_at").alias("last_at"), F.sort_array(F.collect_list("last_at")).alias("times"))


def group_hits(hits: DataFrame, key: str = "session_id", order: str = "ord") -> DataFrame:
    """Hits by session, given their order: count, last time, top score, project and source of the first hit, path of
    the last hit with the top score, snippet of the last such hit that has one."""
    top = F.max("score").over(Window.partitionBy(key))
    h = hits.withColumn("_top", F.col("score") == top)
    return h.groupBy(key).agg(
        F.count("*").alias("hits"), F.max("ts").alias("last_ts"), F.max("score").alias("top_score"), F.min_by("project", order).alias("project"), F.min_by("source", order).alias("source"),
        F.max_by("source_path", F.when(F.col("_top"), F.col(order))).alias("source_path"), F.max_by("snippet", F.when(F.col("_top") & (F.col("snippet") != ""), F.col(order))).alias("snippet"),
    )


def with_repo_project(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """records, their project replaced by their session's repository where it has one."""
    side = sessions.select(*KEYS, F.col("repo_project").alias("_repo"))
    return records.join(side, list(KEYS), "left").withColumn("project", repo_project(F.col("_repo"), F.col("project"))).drop("_repo")
