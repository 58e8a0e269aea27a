"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column, longest: int = 255) -> Column:
    """Lower-case runs of letters and digits; over-long ones are dropped."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: (t != "") & (F.length(t) <= longest))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def summarize(text: Column, most: int) -> Column:
    """White space collapsed; beyond `most` characters the first most - 3 and '...'."""
    c = collapse(text)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(most - 3, 0)), F.lit("...")))


def snippet(text: Column, most: int) -> Column:
    """White space collapsed; beyond `most` characters the first most - 1 and an ellipsis."""
    c = collapse(text)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, max(most - 1, 0)), F.lit("…")))


def query_terms(query: Column, in_bytes: bool = True) -> Column:
    """Words of a query without outer punctuation, of two bytes (or characters) at least, lower-case, each once."""
    size = F.octet_length if in_bytes else F.length
    bare = F.transform(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.array_distinct(F.filter(bare, lambda w: size(w) >= 2))


def compact_count(n: Column) -> Column:
    """1234 -> 1.2k, 5600000 -> 5.6M."""
    d = n.cast("double")
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.1fB", d / 1e9)).when(n >= 1_000_000, F.format_string("%.1fM", d / 1e6))
        .when(n >= 1_000, F.format_string("%.1fk", d / 1e3)).otherwise(n.cast("string"))
    )


def shell_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def resume_command(template: str, session_id: Column, cwd: Column) -> Column:
    """Fills {session_id} and {cwd}, quoted for a shell."""
    return F.replace(F.replace(F.lit(template), F.lit("{session_id}"), shell_quote(session_id)), F.lit("{cwd}"), shell_quote(F.coalesce(cwd, F.lit("."))))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
