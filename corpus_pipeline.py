"""A corpus through five of the operators; each stage's result is written as Parquet and read as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import decontaminate, jaccard, mixing, quality_rules, simhash, token_ids
from traceloom.llm.common import cut, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule or their host's verdict rejects go."""
    return quality_rules.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays. SimHash with deletion variants links texts within three
    bits, as op3 does; an exact comparison (five-word shingles, Jaccard similarity 0.8) links what lies further apart."""
    return jaccard.keep_one(docs, bits=simhash.BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their target weights, as far as there are tokens."""
    return mixing.sample_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_ids.tokenized(docs)


STAGES = [("quality_rules", rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mix), ("token_ids", tokens)]

#: Shingle hashes, raking and the tokenizer can't be written in DuckDB's SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
