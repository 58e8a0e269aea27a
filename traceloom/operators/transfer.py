"""Conversations made ready to be carried to another tool."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["source", "session_id"]


def drop_repeats(messages: DataFrame, order: list = ("turn_id", "ts", "doc_id")) -> DataFrame:
    """Without messages that equal the one before in role and text."""
    w = Window.partitionBy(*KEYS).orderBy(*order)
    same = (F.lag("role").over(w).eqNullSafe(F.col("role"))) & (F.lag("text").over(w).eqNullSafe(F.col("text")))
    numbered = messages.withColumns({"_same": same, "_at": F.row_number().over(w)})
    return numbered.filter((F.col("_at") == 1) | ~F.col("_same")).drop("_same", "_at")


def compact_pairs(messages: Iterable[tuple[str, str]], least: int = 3) -> Iterator[tuple[str, str, int]]:
    """(role, text, times): a pair of messages that comes `least` times in a row or more is told once. No more than
    `least` pairs are held, however long a row of them is."""
    left, held = iter(messages), deque()

    def holds(n: int) -> bool:
        held.extend(islice(left, n - len(held)) if len(held) < n else ())
        return len(held) >= n

    while holds(1):
        if holds(2 * least) and all(held[k] == held[k % 2] for k in range(2, 2 * least)):
            pair, times = (held[0], held[1]), 0
            while holds(2) and (held[0], held[1]) == pair:
                held.popleft(), held.popleft()
                times += 1
            yield from ((*m, times) for m in pair)
        else:
            yield (*held.popleft(), 1)


def compact(messages: DataFrame) -> DataFrame:
    """source, session_id, at, role, text, times: repeats dropped, then repeated pairs told once, by session. Spark sorts
    the messages; a task reads them one by one and holds a few."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out, size = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()], [], 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["source", "session_id", "at", "role", "text", "times"])
        for key, own in groupby(rows_of(batches), key=lambda r: r[:2]):
            for at, told in enumerate(compact_pairs(r[2:] for r in own)):
                out.append((*key, at, *told))
                size += len(told[1] or "")
                if size > 1 << 22:
                    yield make()
                    out, size = [], 0
        yield make()

    order = ["turn_id", "ts", "doc_id"]
    kept = drop_repeats(messages).select(*KEYS, "role", "text", *order).repartition(*KEYS).sortWithinPartitions(*KEYS, *order)
    return kept.select(*KEYS, "role", "text").mapInArrow(fold, "source string, session_id string, at long, role string, text string, times long")


def stats(messages: DataFrame) -> DataFrame:
    """Title (the first text of the user's), messages, tool calls and results of each session."""
    said = (F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return messages.groupBy(*KEYS).agg(
        F.substring(F.min_by("text", F.when(said, F.struct("turn_id", "ts", "doc_id"))), 1, 120).alias("title"), F.count("*").alias("messages"),
        F.count_if(F.col("role") == "tool_use").alias("tool_calls"), F.count_if(F.col("role") == "tool_result").alias("tool_results"),
    )


def tag_value(text: Column, tag: str) -> Column:
    """What stands between the first <tag> and the next </tag>, in any case, with white space collapsed; empty without them."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1), r"(?U)\s+", " "))


def _labelled(label: str, value: Column) -> Column:
    return F.when(value == "", F.lit(label)).otherwise(F.concat(F.lit(label + " "), value))


#: How a user's text begins that a tool has wrapped, with what it is told as, and the tag that is kept.
WRAPPED = (("<task-notification>", "[Task notification]", "summary"), ("<local-command-stdout>", "[Local command stdout]", "local-command-stdout"), ("<local-command-caveat>", "[Local command caveat]", "local-command-caveat"))
#: What stands for a wish to go on, and parts of an assistant's text that tell of an error.
GO_ON = ("continue", "contiue")
ERRORS = (("you've hit your org's monthly usage limit", "[Assistant error] Usage limit reached"), ("operation aborted", "[Assistant error] Operation aborted"))


def compact_text(role: Column, text: Column) -> Column:
    """Texts of users and assistants as they are told to another tool: wrapper tags and errors in short; null where
    nothing is left. Texts of other roles stay."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    low = F.lower(F.regexp_replace(raw, r"(?U)\s+", " "))
    command, message = tag_value(raw, "command-name"), tag_value(raw, "command-message")
    named = F.when(command == "", F.lit("[Local command]")).when(message == "", F.concat(F.lit("[Local command] "), command)).otherwise(F.concat(F.lit("[Local command] "), command, F.lit(": "), message))
    user = F.when(low.isin(*GO_ON), "[User requested continuation]").when(low.startswith("<command-name>"), named)
    for start, label, tag in WRAPPED:
        user = user.when(low.startswith(start), _labelled(label, tag_value(raw, tag)))
    assistant = None
    for part, label in ERRORS:
        assistant = F.when(low.contains(part), label) if assistant is None else assistant.when(low.contains(part), label)
    return F.nullif(F.when(role == "user", user.otherwise(raw)).when(role == "assistant", assistant.otherwise(raw)).otherwise(text), F.lit(""))


def title_of(text: Column, most: int = 120) -> Column:
    """The first line, trimmed; of a longer one the first `most` characters and dots."""
    first = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"^([^\r\n]*)", 1))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most), F.lit("..."))).otherwise(first)


def argument_hash(arguments: Column) -> list[Column]:
    """argument_sha256, argument_bytes of a tool call; null without arguments."""
    return [F.sha2(arguments, 256).alias("argument_sha256"), F.octet_length(arguments).cast("long").alias("argument_bytes")]


def tool_note(name: Column, text: Column) -> Column:
    return F.format_string("[%s] %s", name, text)
