"""Registered queries against their SQL. PRESSLINE_ALL=1 runs every query."""

import os

import pytest
import sqlcheck

import __spark_entry__ as entry

FOLDER = os.environ.get("PRESSLINE_DATA", "/root/testdata/sf0.001")
DEFAULT = """
a8_mention_calendar a10_source_health a11_notification_stats a16_mean_vector c5_match_active c6_match_revival c7_assign_batch c12_synthesis_payload
c13_apply_synthesis c14_split_contaminated d2_title_dups d4_dedupe_plan_transitive d5_match_existing e2_resolve_canonical e3_create_entities
f1_latest_for_users f9_video_visibility j9_thread_tree l2_page m3_clean_corpus n3_digest_detail n7_schedule_articles n10_breaking_audience
q2_fts_search q6_cascade_search r1_article_score r4_top_reads r7_read_next_for_articles r7_read_next_for_users r8_related r9_suggested_next_reads
s2_extract_articles s5_write_csv_flattened s8_upsert st2_exactly_once st7_view_velocity st9_video_session_upsert t1_clean_text t2_normalize_url
u1_union_ranked v2_validate_analysis va2_video_analytics w3_rank_articles_for_entity w5_gap_sessions w7_queue_position x15_listing_links
""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PRESSLINE_ALL") else DEFAULT


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return sqlcheck.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    problem, _ = sqlcheck.compare(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name])
    assert problem == ""


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark, duck):
    assert len(entry.queries()["r4_top_reads"](spark, FOLDER).collect()) > 0
