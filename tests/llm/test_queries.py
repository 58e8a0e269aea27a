import zlib

import pytest

from traceloom.llm import catalog

from .. import compare

pytestmark = pytest.mark.skipif(not compare.there(), reason="needs the driver's tables and DuckDB")

#: Queries without SQL: columns and types that their contracts name, and the share of ids that is held out.
CONTRACTS = {
    "op2_lm_scoring": ("doc_id bigint held_out boolean n_tokens bigint n_known bigint train_tokens bigint base_score double score double", (7, 2)),
    "op3_simhash_near_dedup": ("doc_id bigint fingerprint string component_id bigint", None),
    "op4_suffix_array_dedup": ("doc_id bigint n_bytes bigint n_removed bigint n_spans bigint kept_sha256 string", None),
    "op5_quality_classifier": ("doc_id bigint held_out boolean score double predicted int", (4, 2)),
    "op6_mixing": ("doc_id bigint weight double probability double sampled boolean", None),
    "op8_toxicity": ("doc_id bigint held_out boolean score double predicted int", (5, 0)),
    "op10_token_ids": ("doc_id bigint start bigint n_tokens bigint ids_crc32 bigint", None),
}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare.same(spark, catalog.queries()[name], compare.oracle(), catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_keeps_its_contract(spark, name):
    columns, held = CONTRACTS[name]
    df = catalog.queries()[name](spark, compare.SF)
    kinds = columns.split()
    assert dict(zip(kinds[::2], kinds[1::2], strict=True)).items() <= dict(df.dtypes).items()
    rows = df.collect()
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{compare.SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in rows) == ids
    if held:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % held[0] == held[1]) for r in rows)
    if "predicted" in df.columns:
        least = 0.7 if name.startswith("op5") else 0.5
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in rows)
    if name == "op6_mixing":
        assert all(0 <= r.probability <= 1 for r in rows) and 0 < sum(r.sampled for r in rows) < len(rows)
