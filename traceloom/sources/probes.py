"""What a file's first lines tell about its session, and where a session was at work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name
from . import claude, lines

#: Lines that a probe looks at.
FIRST = 64
_HEAD = "type string, sessionId string, session_id string, cwd string, isSidechain boolean, payload struct<id: string, cwd: string, forked_from_id: string, source: string>"


def discovered(path: Column, root: str, include_agents: bool = False) -> Column:
    """Which files below the first dialect's root are transcripts: those in a project's folder; deeper ones only below
    a subagents folder, and agents' files only if they are wanted."""
    below = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    agent = F.element_at(F.split(path, "/"), -1).startswith("agent-")
    nested = path.contains("/subagents/")
    deep = F.size(F.split(below, "/")) > 2
    wanted = F.when(nested, agent & F.lit(include_agents)).otherwise(~deep & (~agent | F.lit(include_agents)))
    return path.startswith(root.rstrip("/") + "/") & path.endswith(".jsonl") & wanted


def _read(heads: DataFrame) -> DataFrame:
    return heads.filter(F.col("line_no") < FIRST).withColumn("_e", F.from_json("value", _HEAD)).filter(F.col("_e").isNotNull())


def probe_claude(heads: DataFrame) -> DataFrame:
    """heads: the first lines of files. source_path, session_id, parent_session_id, cwd, project, conversation_kind: what
    has been said by the first line with both a folder and a session, or by the last line looked at."""
    df = _read(heads)
    x = F.col("_e")
    whole = F.when(x["cwd"].isNotNull() & x["sessionId"].isNotNull(), F.col("line_no"))
    ends = df.groupBy("source_path").agg(F.coalesce(F.min(whole), F.lit(FIRST)).alias("_end"))
    seen = df.join(ends, "source_path").filter(F.col("line_no") <= F.col("_end"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    side = F.max_by(F.coalesce(x["isSidechain"], F.lit(False)), F.col("line_no"))
    found = seen.groupBy("source_path").agg(last(x["sessionId"]).alias("_session"), last(x["cwd"]).alias("cwd"), side.alias("_side"), F.max_by(x["sessionId"], "line_no").alias("_own"))
    files = heads.select("source_path").distinct().join(found, "source_path", "left")
    path = F.col("source_path")
    agent = ~claude.kept(path)
    return files.select(
        "source_path", F.coalesce("_session", lines.session_from_path(path)).alias("session_id"), F.when(agent, F.col("_own")).alias("parent_session_id"), "cwd",
        F.coalesce(file_name(F.col("cwd")), claude.project_of(path)).alias("project"), F.when(agent, "subagent").when(F.coalesce("_side", F.lit(False)), "sidechain").otherwise("main").alias("conversation_kind"),
    )


def probe_codex(heads: DataFrame) -> DataFrame:
    """The same of the second dialect, from the head of the session."""
    df = _read(heads).filter("_e.type = 'session_meta'")
    meta = df.groupBy("source_path").agg(F.max_by("_e.payload", "line_no").alias("p"))
    p = F.col("p")
    files = heads.select("source_path").distinct().join(meta, "source_path", "left")
    return files.select(
        "source_path", F.coalesce(p["id"], lines.session_from_path(F.col("source_path"))).alias("session_id"), p["forked_from_id"].alias("parent_session_id"), p["cwd"].alias("cwd"),
        F.coalesce(F.nullif(file_name(p["cwd"]), F.lit("")), F.lit("codex")).alias("project"),
        F.when(F.coalesce(p["source"].contains("subagent"), F.lit(False)), "subagent").when(p["forked_from_id"].isNotNull(), "fork").otherwise("main").alias("conversation_kind"),
    )


def session_folders(sessions: DataFrame, files: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """sessions (source, session_id, source_path) with cwd: where a sidecar names one, that (see sidecar_folders); else
    what the first line says that names the session's own folder, or its head; else the first folder in the file.
    files: lines with source_path, line_no, value."""
    df = files.filter(F.col("value").contains('"cwd"')).withColumn("_e", F.from_json("value", _HEAD)).select("source_path", "line_no", "_e").filter(F.col("_e").isNotNull())
    x = F.col("_e")
    j = sessions.select("source", "session_id", "source_path").distinct().join(df, "source_path")
    own = F.coalesce(x["sessionId"], x["session_id"]) == F.col("session_id")
    head = F.when((F.col("source") == "codex") & (x["type"] == "session_meta"), x["payload"]["cwd"])
    certain = F.coalesce(F.when(own | (F.col("source").isin("pi", "openclaw") & (x["type"] == "session")), x["cwd"]), head)
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    found = j.groupBy("source", "session_id", "source_path").agg(F.coalesce(first(certain), first(x["cwd"])).alias("cwd"))
    out = sessions.join(found, ["source", "session_id", "source_path"], "left")
    if sidecars is None:
        return out
    side = sidecars.select(F.col("folder").alias("_folder"), F.col("cwd").alias("_cwd"))
    folder = F.when(F.col("source") == "copilot", F.regexp_extract("source_path", r"^(.*)/[^/]*$", 1))
    return out.withColumn("_folder", folder).join(side, "_folder", "left").withColumn("cwd", F.coalesce("_cwd", "cwd")).drop("_cwd", "_folder")


def sidecar_folders(files: DataFrame) -> DataFrame:
    """folder, cwd from the lines of workspace.yaml files (source_path, line_no, value): the top level's last cwd, else
    its last git root; a value loses its quotes."""
    line = F.trim(F.regexp_replace("value", r"\s+$", ""))
    key = F.trim(F.regexp_extract(line, r"^([^:]*):", 1))
    value = F.nullif(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)), '^"+|"+$', ""), "^'+|'+$", ""), F.lit(""))
    top = files.filter(~F.col("value").rlike(r"^\s") & ~F.col("value").startswith("#")).select(F.regexp_extract("source_path", r"^(.*)/[^/]*$", 1).alias("folder"), "line_no", key.alias("k"), value.alias("v")).filter("v is not null")
    last = lambda *names: F.max_by("v", F.when(F.col("k").isin(*names), F.col("line_no")))
    return top.groupBy("folder").agg(F.coalesce(last("cwd"), last("gitRoot", "git_root")).alias("cwd")).filter("cwd is not null")
