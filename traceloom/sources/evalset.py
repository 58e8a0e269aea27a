"""Judged queries and requests for pages, with their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import QRELS

REQUEST_BYTES, REQUEST_LINE, REQUESTS, PAGE = 8 * 1024 * 1024, 1024 * 1024, 32, 500


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Cases with an id; a case has either a query or queries, and something relevant; ids are unique."""
    df = spark.read.schema(QRELS).json(path)
    bad = (F.col("query").isNotNull() == (F.size(F.coalesce("queries", F.array())) > 0)) | (F.size(F.coalesce("relevant", F.array())) == 0)
    if not df.filter(bad).isEmpty():
        raise ValueError("a case needs a query or queries, and relevant results")
    if not df.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("ids of cases are unique")
    views = F.when(F.col("query").isNotNull(), F.array("query")).otherwise(F.col("queries"))
    return df.withColumns({"id": F.coalesce("id", F.sha2(F.array_join(views, "\u0001"), 256)), "views": F.array_distinct(F.transform(views, lambda v: F.trim(v)))})


def qrels(cases: DataFrame) -> DataFrame:
    """query_id and what is relevant, relevance 1 if not said."""
    r = cases.select(F.col("id").alias("query_id"), F.explode("relevant").alias("r"))
    return r.select("query_id", "r.machine", "r.source", "r.session_id", "r.source_path", "r.doc_id", "r.record_id", F.coalesce("r.relevance", F.lit(1.0)).alias("relevance"))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Page requests: at most 32 lines of a megabyte, limits of 1 to 500."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    n, longest, size = raw.agg(F.count("*"), F.max(F.octet_length("value")), F.sum(F.octet_length("value"))).first()
    if n > REQUESTS or (longest or 0) > REQUEST_LINE or (size or 0) > REQUEST_BYTES:
        raise ValueError("too many or too long requests")
    r = raw.select(F.from_json("value", "machine string, session_id string, source_path string, offset long, limit long").alias("r")).select("r.*")
    r = r.withColumns({"source_path": F.coalesce("source_path", F.lit("")), "offset": F.coalesce("offset", F.lit(0))})
    if not r.filter("session_id is null or limit is null or limit < 1 or offset < 0 or limit > 500").isEmpty():
        raise ValueError("a request names a session and a limit of 1 to 500")
    return r


def hydrate(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The requested pages of all sessions at once, in order of turn."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id", "_path").orderBy("turn_id", "ts", "doc_id")
    q = wanted.select("session_id", F.col("source_path").alias("_path"), "offset", "limit")
    j = records.join(F.broadcast(q), "session_id").filter((F.col("_path") == "") | (F.col("_path") == F.col("source_path")))
    return j.withColumn("_n", F.row_number().over(w) - 1).filter((F.col("_n") >= F.col("offset")) & (F.col("_n") < F.col("offset") + F.col("limit"))).drop("_path", "_n", "offset", "limit")
