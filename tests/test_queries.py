"""A cross-section of the registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm

BASE = "/root/testdata/sf0.001"
SAMPLE = (
    "F1_repair_text", "F8_heading_level", "F16_party_scores", "F25_plan_tree_levels", "F45_encrypt_decrypt",
    "W1_group_words_into_lines", "W3_assemble_paragraphs", "W5_sliding_word_windows", "C20_normalize_extraction",
    "C21_adversarial_chunks", "C22_hierarchical_chunks", "C16_strategy_router", "C6_build_cluster_plan", "C9_build_structural_tree",
    "C11_summarize", "T2_match_nodes_batch_owner", "T3_retrieve_context", "J13_descendants", "G16_synthesize_root",
    "V2_validate_tree", "V4_validate_uploads", "J10_apply_status_updates", "S6_replace_document_nodes",
    "S7_delete_document_nodes", "R1_status_stream", "R2_incremental_ingest", "W16_stage_progress", "C15_answer_flow",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, BASE)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    where = [names.index(c) for c in columns]
    assert mine == sorted(tuple(norm(r[i]) for i in where) for r in result.fetchall())
    assert mine


def test_entry(spark):
    assert entry.entry(spark).count() > 0
