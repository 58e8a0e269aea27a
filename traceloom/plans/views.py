"""The engine's tables over the driver's: transcript records from conversations, usage events from events.

Each view has a DataFrame form and the same in SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1_704_067_200_000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    return c.select(
        F.when(conv % 3 == 0, "claude").when(conv % 3 == 1, "codex").otherwise("pi").alias("source"),
        (conv * 1000 + turn).alias("doc_id"),
        (BASE_MS + (conv % 90) * 86_400_000 + conv * 1000 + turn * 60_000 - F.when(turn % 4 == 3, 150_000).otherwise(0)).alias("ts"),
        F.when(turn % 3 == 2, "").otherwise(F.concat(F.lit("proj-"), ((conv + turn) % 7).cast("string"))).alias("project"),
        F.concat(F.lit("conv-"), conv.cast("string")).alias("session_id"),
        turn.alias("turn_id"), "role", "text",
        F.concat(F.lit("/home/u"), (conv % 5).cast("string"), F.lit("/logs/"), conv.cast("string"), F.lit(".jsonl")).alias("source_path"),
    )


RECORDS_SQL = f"""
SELECT CASE conv_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'pi' END AS source,
       conv_id * 1000 + turn AS doc_id,
       {BASE_MS} + (conv_id % 90) * 86400000 + conv_id * 1000 + turn * 60000 - CASE WHEN turn % 4 = 3 THEN 150000 ELSE 0 END AS ts,
       CASE WHEN turn % 3 = 2 THEN '' ELSE 'proj-' || CAST((conv_id + turn) % 7 AS VARCHAR) END AS project,
       'conv-' || CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_id, role, text,
       '/home/u' || CAST(conv_id % 5 AS VARCHAR) || '/logs/' || CAST(conv_id AS VARCHAR) || '.jsonl' AS source_path
FROM conversations"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    v = F.floor(F.col("value") * 1000).cast("long")
    e = e.withColumns({"k": k, "v": v, "u": F.col("user_id")})
    read = F.when(F.col("k") % 5 == 0, F.lit(0).cast("long")).otherwise(F.expr("v * (k % 11) div 10"))
    return e.select(
        F.when(F.col("event_type") == "click", "claude").when(F.col("event_type") == "view", "codex").when(F.col("event_type") == "signup", "opencode").otherwise("pi").alias("source"),
        F.concat(F.lit("/u/"), (F.col("u") % 40).cast("string"), F.lit(".jsonl")).alias("source_path"),
        F.concat(F.lit("r"), (F.col("event_id") % 9000).cast("string")).alias("source_record_id"),
        F.concat(F.lit("s"), (F.col("u") % 40).cast("string")).alias("session_id"),
        F.concat(F.lit("q"), (F.col("event_id") % 8500).cast("string")).alias("request_id"),
        F.when(F.col("k") % 17 != 0, F.concat(F.lit("m"), (F.col("event_id") % 8000).cast("string"))).alias("message_id"),
        F.concat(F.lit("proj-"), (F.col("u") % 6).cast("string")).alias("project"),
        F.when(F.col("k") % 4 == 0, "anthropic").when(F.col("k") % 4 == 1, "openai").otherwise("").alias("provider"),
        F.when(F.col("k") % 4 == 0, "claude-sonnet-4-5").when(F.col("k") % 4 == 1, "gpt-5-2025-08-07").when(F.col("k") % 4 == 2, "Claude-Opus-4-1-20250805").otherwise("unknown-model").alias("model"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.col("v").alias("raw_input"), F.col("v").alias("uncached_input"), read.alias("cache_read"),
        F.expr("case when k % 3 = 0 then v div 4 else 0 end").cast("long").alias("cache_write"), F.expr("case when k % 6 = 0 then v div 8 else 0 end").cast("long").alias("cache_write_1h"),
        F.expr("v div 20 + k").cast("long").alias("output"), (F.col("k") % 10).alias("reasoning"),
        F.when(F.col("k") % 8 == 0, F.col("value") / 1000).alias("source_cost_usd"),
        (F.col("k") % 16 == 1).alias("cost_authoritative"), (F.col("k") % 29 == 0).alias("conservative_undercount"), (F.col("k") % 31 == 0).alias("cache_chain_excluded"),
        (F.col("k") % 13 == 0).alias("sidechain"), F.lit("exact").alias("dedupe_confidence"), F.col("event_id").alias("source_order"),
    )


USAGE_SQL = """
SELECT CASE event_type WHEN 'click' THEN 'claude' WHEN 'view' THEN 'codex' WHEN 'signup' THEN 'opencode' ELSE 'pi' END AS source,
       '/u/' || CAST(user_id % 40 AS VARCHAR) || '.jsonl' AS source_path, 'r' || CAST(event_id % 9000 AS VARCHAR) AS source_record_id,
       's' || CAST(user_id % 40 AS VARCHAR) AS session_id, 'q' || CAST(event_id % 8500 AS VARCHAR) AS request_id,
       CASE WHEN k % 17 <> 0 THEN 'm' || CAST(event_id % 8000 AS VARCHAR) END AS message_id, 'proj-' || CAST(user_id % 6 AS VARCHAR) AS project,
       CASE k % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE '' END AS provider,
       CASE k % 4 WHEN 0 THEN 'claude-sonnet-4-5' WHEN 1 THEN 'gpt-5-2025-08-07' WHEN 2 THEN 'Claude-Opus-4-1-20250805' ELSE 'unknown-model' END AS model,
       epoch_us(ts) // 1000 AS timestamp_ms, v AS raw_input, v AS uncached_input, CASE WHEN k % 5 = 0 THEN 0 ELSE v * (k % 11) // 10 END AS cache_read,
       CASE WHEN k % 3 = 0 THEN v // 4 ELSE 0 END AS cache_write, CASE WHEN k % 6 = 0 THEN v // 8 ELSE 0 END AS cache_write_1h,
       v // 20 + k AS output, k % 10 AS reasoning, CASE WHEN k % 8 = 0 THEN value / 1000 END AS source_cost_usd,
       k % 16 = 1 AS cost_authoritative, k % 29 = 0 AS conservative_undercount, k % 31 = 0 AS cache_chain_excluded, k % 13 = 0 AS sidechain,
       event_id AS source_order
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 1000) AS BIGINT) AS v FROM events)"""
