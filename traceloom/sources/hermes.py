"""Sessions with totals and, beside them, sums by model: usage only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import parse_source_ts
from ..operators.usage import disjoint_buckets, total_tokens
from ..schema import USAGE_EVENTS, columns

COUNTS = ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens")
_SUMS = ", ".join(f"{c} long" for c in COUNTS)
_SESSION = f"id string, model string, started_at string, ended_at string, billing_provider string, actual_cost_usd double, estimated_cost_usd double, cwd string, {_SUMS}"
_MODEL = f"session_id string, model string, billing_provider string, task string, first_seen string, last_seen string, actual_cost_usd double, estimated_cost_usd double, {_SUMS}"


def usage(rows: DataFrame) -> DataFrame:
    """rows: sqlite.rows() of sessions and session_model_usage. A session's model rows take from its totals, in
    order, until those are used up; what is left over is a row of its own."""
    s = rows.filter("table = 'sessions'").select("source_path", F.from_json("value", _SESSION).alias("s"))
    s = s.select("source_path", F.col("s.id").alias("session_id"), *(F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(f"t_{c}") for c in COUNTS), F.col("s.model").alias("s_model"), F.col("s.billing_provider").alias("s_provider"), F.col("s.cwd").alias("project"),
                 F.greatest(parse_source_ts(F.col("s.ended_at")), parse_source_ts(F.col("s.started_at"))).alias("s_ts"), F.col("s.actual_cost_usd").alias("s_actual"), F.col("s.estimated_cost_usd").alias("s_estimate"))
    m = rows.filter("table = 'session_model_usage'").select("source_path", "line_no", F.from_json("value", _MODEL).alias("m"))
    m = m.select("source_path", "line_no", F.col("m.session_id").alias("session_id"), F.col("m.model").alias("model"), F.col("m.billing_provider").alias("provider"), F.coalesce("m.task", F.lit("")).alias("task"),
                 *(F.coalesce(F.col(f"m.{c}"), F.lit(0)).alias(c) for c in COUNTS), F.greatest(parse_source_ts(F.col("m.last_seen")), parse_source_ts(F.col("m.first_seen"))).alias("m_ts"), F.coalesce("m.actual_cost_usd", "m.estimated_cost_usd").alias("cost"), F.col("m.actual_cost_usd").isNotNull().alias("final"))
    keys = ["source_path", "session_id"]
    w = Window.partitionBy(*keys).orderBy("model", "provider", "task", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = {c: F.sum(c).over(w) for c in COUNTS}
    j = m.join(s, keys)
    j = j.withColumns({f"c_{c}": (F.least(F.col(f"t_{c}"), run[c]) - F.least(F.col(f"t_{c}"), run[c] - F.col(c))).cast("long") for c in COUNTS})
    named = j.select(*keys, "project", F.coalesce("model", "s_model").alias("model"), F.coalesce("provider", "s_provider").alias("provider"), F.greatest("m_ts", "s_ts").alias("timestamp_ms"), "cost", "final", F.concat_ws(":", "session_id", "model", "task").alias("rid"), *(F.col(f"c_{c}").alias(c) for c in COUNTS), F.col("line_no").cast("long").alias("source_order"))
    used = j.groupBy(*keys).agg(*(F.sum(f"c_{c}").alias(f"u_{c}") for c in COUNTS), F.sum("cost").alias("u_cost"))
    left = s.join(used, keys, "left")
    total = F.coalesce("s_actual", "s_estimate")
    rest = left.select(*keys, "project", F.col("s_model").alias("model"), F.col("s_provider").alias("provider"), F.col("s_ts").alias("timestamp_ms"), F.when(total.isNotNull(), F.greatest(total - F.coalesce("u_cost", F.lit(0.0)), F.lit(0.0))).alias("cost"), F.col("s_actual").isNotNull().alias("final"),
                       F.concat("session_id", F.lit(":rest")).alias("rid"), *(F.greatest(F.col(f"t_{c}") - F.coalesce(f"u_{c}", F.lit(0)), F.lit(0)).alias(c) for c in COUNTS), F.lit(2**40).alias("source_order"))
    df = named.unionByName(rest)
    df = df.withColumns({
        **disjoint_buckets(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens"), F.col("output_tokens")), "source": F.lit("hermes"), "source_record_id": F.col("rid"), "request_id": F.lit(None).cast("string"),
        "message_id": F.lit(None).cast("string"), "cache_write_1h": F.lit(0).cast("long"), "reasoning": F.col("reasoning_tokens"), "source_cost_usd": F.col("cost"), "cost_authoritative": F.col("final"), "conservative_undercount": F.lit(False),
        "cache_chain_excluded": F.lit(True), "sidechain": F.lit(False), "dedupe_confidence": F.lit("strong"),
    })
    return df.filter((total_tokens() > 0) | (F.col("cost") > 0)).select(*columns(USAGE_EVENTS))
