"""Which repository a folder belongs to, from a table of known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name


def ancestors(path: Column) -> Column:
    """The path and all folders above it, as an array."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    start = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.concat(start, F.array_join(F.slice(parts, 1, k), "/")))


def worktree_project(path: Column) -> Column:
    """The name of the folder that holds .claude/worktrees above the path, the innermost one; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"^(?:.*/)?([^/]+)/\.claude/worktrees(?:/.*)?$", 1), F.lit(""))


def common_dir_project(path: Column) -> Column:
    """The name that a repository's common folder gives: that of the folder around .git, else its own."""
    bare = F.regexp_replace(path, r"/+$", "")
    return F.nullif(file_name(F.regexp_replace(bare, r"/\.git$", "")), F.lit(""))


def nearest(rows: DataFrame, repositories: DataFrame, cwd: str = "cwd") -> DataFrame:
    """rows with git_root, git_common_dir, repo_project and resolution_status. repositories: root, common_dir. The
    deepest root that is the folder or lies above it counts: each distinct folder is joined by its ancestors, by
    equality, so no pair of paths is compared. Without one, the path itself may tell."""
    folders = rows.select(F.col(cwd).alias("_cwd")).filter("_cwd is not null").distinct()
    known = repositories.groupBy(F.regexp_replace("root", r"(?<=.)/+$", "").alias("_above")).agg(F.min("common_dir").alias("_common"))
    above = folders.select("_cwd", F.explode(ancestors(F.col("_cwd"))).alias("_above")).join(known, "_above")
    best = above.groupBy("_cwd").agg(F.max_by(F.struct(F.col("_above").alias("root"), F.col("_common").alias("common")), F.length("_above")).alias("_r"))
    out = rows.join(best, rows[cwd] == best["_cwd"], "left")
    root, common = F.col("_r.root"), F.col("_r.common")
    name = F.coalesce(common_dir_project(common), F.nullif(file_name(root), F.lit("")), worktree_project(F.col(cwd)))
    status = F.when(name.isNull() & root.isNull(), "not-git").when(name.isNull(), "git-partial").when(root.isNull() & common.isNull(), "path-fallback").otherwise("ok")
    return out.select(*rows.columns, root.alias("git_root"), common.alias("git_common_dir"), name.alias("repo_project"), status.alias("resolution_status"))
