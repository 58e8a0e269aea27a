"""Names of projects from paths, slugs and remotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_key(project: Column) -> Column:
    """Lower case, the part behind the last / \\ or :, without .git; slugs of home folders lose their first two parts."""
    low = F.lower(F.trim(project))
    tail = F.regexp_replace(F.element_at(F.split(F.regexp_replace(low, r"[/\\:]+$", ""), r"[/\\:]"), -1), r"\.git$", "")
    return F.when(tail.rlike(r"^-?(users|home)-[^-]+-.+"), F.regexp_replace(tail, r"^-?(users|home)-[^-]+-", "")).otherwise(tail)


def same_project(project: Column, wanted: str) -> Column:
    w = F.lit(wanted)
    return (F.lower(F.trim(project)) == F.lower(F.trim(w))) | (project_key(project) == project_key(w))


def repo_project(repo: Column, project: Column) -> Column:
    """The repository's name if there is one, else the project."""
    return F.coalesce(F.nullif(repo, F.lit("")), project)


#: Folders that hold projects.
COMMON = ("projects", "code", "repos", "src", "dev", "work", "documents")


def _parts(slug: Column) -> Column:
    return F.filter(F.split(slug, "-"), lambda x: x != "")


def decode_slug(slug: Column) -> Column:
    """A project's name from the name of its log folder: -Users-ann-src-app -> app. The folder of home folders goes;
    what common folders are left out, and the user before them; a user without a common folder behind stays."""
    drive = F.when(F.length(slug) > 10, F.regexp_replace(slug, r"^-[A-Za-z]--(?i:users)-", "")).otherwise(slug)
    parts = _parts(F.regexp_replace(drive, r"(?i)^-(home|mnt-c-users|users)-", ""))
    common = lambda x: F.lower(x).isin(*COMMON)
    user = F.exists(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), common)
    kept = F.filter(parts, lambda x, i: ~common(x) & ~((i == 0) & user))
    return F.when(F.size(kept) > 0, F.array_join(kept, "-")).otherwise(slug)


def display_project(slug: Column) -> Column:
    """How a project is shown: of a slug of a path below a home folder, what lies behind one common folder; ~/app where
    that is one part; any other name as it is."""
    bare = F.regexp_replace(slug, "^-+|-+$", "")
    parts = _parts(bare)
    users = F.array_position(F.transform(parts, F.lower), "users").cast("int")
    first = F.when(F.lower(F.get(parts, F.lit(0))) == "home", 3).when(users > 0, users + 2)
    tail = F.slice(parts, F.coalesce(first, F.lit(1)), F.greatest(F.size(parts), F.lit(1)))
    shown = F.when(F.size(tail) == 1, F.concat(F.lit("~/"), F.get(tail, F.lit(0)))).when(F.lower(F.get(tail, F.lit(0))).isin(*COMMON), F.array_join(F.slice(tail, 2, F.greatest(F.size(tail), F.lit(1))), "-")).otherwise(F.array_join(tail, "-"))
    below = F.lower(bare).rlike("^(users|home)-|-users-") & (F.size(parts) >= 3) & first.isNotNull() & (F.size(tail) > 0)
    return F.when(below, shown).otherwise(slug)
