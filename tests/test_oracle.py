"""Named queries equal their SQL on the same files."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import differences

ONE_PER_AREA = ["src_validate", "src_dedup_in_scope", "src_manifest_match", "txt_section_carry", "chunk_finalize", "txt_block_assembly", "idx_term_stats",
                "ret_evidence_items", "ret_dense_topk", "clm_extract_json", "ver_drop_reasons", "nrm_money", "cfl_status", "unc_reasons", "run_cache_lookup",
                "obs_stage_log", "str_latest_status"]


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("CORROBORA_ALL") else ONE_PER_AREA)
def test_query_equals_sql(spark, name):
    problem, rows, _ = differences(spark, name, "sf0.001")
    assert problem == "" and rows > 0


def test_catalog_is_consistent():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 100


def test_flagship(spark):
    rows = entry(spark).collect()
    assert len(rows) == 160 and {r.state for r in rows} <= {"HIGH", "MEDIUM", "LOW", "CONFLICT", "INSUFFICIENT"}
    assert any(r.state != "INSUFFICIENT" for r in rows)
