"""Named queries against their SQL.  VEILWORK_ALL=1 runs every query, else one per family."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
FAMILIES = ["r1_phone_text", "r7_zip_text", "r10_address", "r14_cardinal_text", "r16_ignore", "d2_group_only",
            "d3_patterns_in_sequence", "d5_phrase_table_join", "d12_model_spans", "d17_overlap_exclusion",
            "d18_run_global_numbers", "d18_run_conversation_numbers", "e4_index_zero_reissue",
            "e6_conversation_index", "i3_repeat_number", "f1_aliases_tokens_and_suppression", "f13_restore",
            "n_money_text", "n_ccard_voice", "g7_clean_chain", "g9_number_to_words", "a1_csv_all_text",
            "a6_row_numbers_and_chunks", "b2_gathered_files", "h3_match_report", "m4_audit_stream",
            "nu1_custom_detector"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("VEILWORK_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["row_id", "text"]
