"""Neighbourhoods of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

MOST = 1000


def latest_copies(records: DataFrame, identity: str = "record_id") -> DataFrame:
    """One row for each identity: the greatest (ts, turn_id, doc_id)."""
    w = Window.partitionBy(identity).orderBy(F.desc("ts"), F.desc("turn_id"), F.desc("doc_id"))
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def around(records: DataFrame, anchors: Column, before: int, after: int, identity: str = "doc_id") -> DataFrame:
    """Rows of the anchors' sessions from `before` rows ahead to `after` behind, in (turn, ts, doc) order, with the
    anchor, the signed distance and the relation. Each anchor gets a window of its own."""
    if not (0 <= before <= MOST and 0 <= after <= MOST):
        raise ValueError(f"a window has {MOST} records at most on either side")
    keys = ["source", "session_id"]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("turn_id", "ts", "doc_id"))
    picked = records.filter(anchors).select(*keys).distinct()
    own = records.join(picked, keys, "left_semi").withColumn("_at", at)
    a = own.filter(anchors).select(*keys, F.col(identity).alias("anchor"), F.col("_at").alias("_anchor"))
    d = F.col("_at") - F.col("_anchor")
    out = own.join(a, keys).filter(d.between(-before, after))
    return out.withColumns({"distance": d, "relation": F.when(d < 0, "before").when(d > 0, "after").otherwise("anchor")}).drop("_at", "_anchor")


def single_anchor(records: DataFrame, anchors: Column, identity: str = "doc_id"):
    """The one record that anchors picks; none or several are an error that names them."""
    found = [r[0] for r in records.filter(anchors).select(identity).distinct().orderBy(identity).limit(11).collect()]
    if len(found) != 1:
        raise ValueError("no record matches the anchor" if not found else f"the anchor is ambiguous: {found[:10]}")
    return found[0]


def near_matches(records: DataFrame, match: Column, reach: int = 1) -> DataFrame:
    """Rows at most `reach` places from a match in their session; overlapping neighbourhoods appear once."""
    order = Window.partitionBy("source", "session_id").orderBy("turn_id", "ts", "doc_id")
    r = records.withColumn("is_match", match)
    return r.withColumn("_near", F.max("is_match").over(order.rowsBetween(-reach, reach))).filter("_near").drop("_near")


def tail(records: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("source", "session_id").orderBy(F.desc("turn_id"), F.desc("ts"), F.desc("doc_id"))
    return records.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def last_user_turns(records: DataFrame, n: int) -> DataFrame:
    """All from the n-th last message of the user on; whole sessions that have fewer."""
    back = Window.partitionBy("source", "session_id").orderBy(F.desc("turn_id"), F.desc("ts"), F.desc("doc_id"))
    user = (F.col("role") == "user").cast("int")
    behind = F.coalesce(F.sum(user).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return records.withColumn("_behind", behind).filter(F.col("_behind") < n).drop("_behind")


def fill_forward(rows: DataFrame, value: str, into: str, keys: list[str], order: list) -> DataFrame:
    """The last value that is not null, up to this row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(value, ignorenulls=True).over(w))


def closure(edges: DataFrame, seeds: DataFrame, node: str = "record_id", identifier: str = "identifier") -> DataFrame:
    """record ids that share an identifier with a seed, directly or through others. edges: node, identifier.

    Rounds of joins until no record is added. A round starts from the records and identifiers that the last one added,
    and is written out, so that the plan stays that of one round.
    """
    found = new = cut(seeds.select(node).distinct(), "closure")
    used = None
    while True:
        names = edges.join(new, node, "left_semi").select(identifier).distinct()
        names = cut(names if used is None else names.join(used, identifier, "left_anti"), "identifiers")
        new = cut(edges.join(names, identifier, "left_semi").select(node).distinct().join(found, node, "left_anti"), "closure")
        if new.isEmpty():
            return found
        found, used = found.union(new), names if used is None else used.union(names)


def identifiers(records: DataFrame, node: str = "doc_id") -> DataFrame:
    """node, identifier: the ids by which records refer to each other. A parent session is none of them."""
    names = ["event_id", "parent_event_id", "logical_parent_event_id", "parent_tool_use_id", "source_tool_use_id", "source_tool_assistant_uuid"]
    return records.select(node, F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("identifier")).filter("identifier <> ''")
