"""The plans that queries get: no products of tables, pruned scans, bounded sorts."""

import os

import pytest

from lectern.plans import chat_queries, corpus_queries, eval_queries, more_queries, registry, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
BATCH = sorted(n for n in registry.QUERIES if not n.startswith("stream_"))


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_query_multiplies_tables(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["longest_rows", "first_per_domain", "recent_jobs", "events_after", "keyset_page", "search_snippet"])
def test_limits_do_not_sort_everything(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


@pytest.mark.parametrize("name", ["event_tail", "log_tails", "claim_next", "settings_upsert"])
def test_rows_per_key_are_limited_before_the_exchange(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_scans_read_what_is_used(spark):
    assert "ReadSchema: struct<source:string>" in plan(spark, "domain_counts_gate")
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,4321)]" in plan(spark, "events_after")
